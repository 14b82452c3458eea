"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_ids(labelled: DataFrame, bound: int, key: str = "doc_id") -> DataFrame:
    """Distinct ids of ``labelled``, all of them or a share chosen by a hash of the id.

    The share aims at nine tenths of ``bound``, and the first ``bound`` by hash are the limit, so the
    result is never larger. It depends on the ids alone, not on the partitions they lie in.
    """
    ids = labelled.select(key).where(F.col(key).isNotNull()).distinct()
    n = ids.count()
    place = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30))
    if n > bound:
        ids = ids.where(place < int(0.9 * bound / n * (1 << 30)))
    return ids.orderBy(place, key).limit(bound)


def bounded_per_group(labelled: DataFrame, bound: int, group: str, key: str = "doc_id") -> DataFrame:
    """Distinct (key, group) pairs of ``labelled``, ``bound`` at most over all groups: each group
    gives an equal share of them, or all it has if that is less, chosen by a hash of the key.

    The share aims at nine tenths of the bound, and the first ``bound`` by hash are the limit, so the
    result is never larger. No group is ranked, so one that holds most rows is no hot spot; one row
    per group is joined back.
    """
    pairs = labelled.select(key, group).where(F.col(key).isNotNull() & F.col(group).isNotNull()).distinct()
    counts = pairs.groupBy(group).agg(F.count("*").alias("n"))
    groups = counts.count()
    place = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30))
    share = counts.select(group, F.least(F.lit(1.0), F.lit(0.9 * bound / max(1, groups)) / F.col("n")).alias("share"))
    return pairs.join(share, group).where(place < F.col("share") * (1 << 30)).orderBy(place, key, group).limit(bound).select(key, group)
