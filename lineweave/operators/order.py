"""The global order of lines, its range partitions, and ranks without a one-task window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.grammar import ORDER
from lineweave.sources.shared import Scratch

#: Lines that splitters are sampled from.
SAMPLE = 4096


def sort_lines(parsed: DataFrame) -> DataFrame:
    """All lines by (string part, number, line): one range exchange of sampled splitters, then a
    sort of each range. Equal lines are identical bytes, so the result is unique."""
    return parsed.orderBy(*ORDER)


def ranges(parsed: DataFrame, n: int | None = None) -> DataFrame:
    """Lines in n range partitions (Spark's setting if None), each sorted; ``slice`` is the partition."""
    dealt = parsed.repartitionByRange(n, *ORDER) if n else parsed.repartitionByRange(*ORDER)
    return dealt.sortWithinPartitions(*ORDER).withColumn("slice", F.spark_partition_id())


def ranked(parsed: DataFrame, *ties: str) -> DataFrame:
    """Adds ``rank`` (from 1) in the global order, ties by further columns.

    One range exchange deals lines by all sort columns (and, as the last one, by where they were
    read, so that even equal lines spread over the ranges); each range is sorted and written once
    with its rows' numbers. A running sum over the ranges' counts, one row for each range, gives
    their offsets; no window has a row per line.
    """
    numbered = parsed.withColumn("_read", F.monotonically_increasing_id())
    keys = [*ORDER, *ties, "_read"]
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_read")
    # written, as a range exchange may draw other borders when it is computed again
    placed = Scratch(parsed.sparkSession, "ranked").table(dealt, "lines")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    return placed.join(base, "_range").withColumn("rank", F.col("_base") + inside + 1).drop("_at", "_range", "_base")


@dataclass(frozen=True)
class Slices:
    """Bytes and rows of each range partition."""

    rows: list[int]
    bytes: list[int]

    @property
    def imbalance(self) -> float:
        """Largest over smallest slice in bytes; infinite if one is empty."""
        if not self.bytes:
            return 1.0
        return max(self.bytes) / min(self.bytes) if min(self.bytes) else float("inf")

    @property
    def non_empty(self) -> int:
        return sum(1 for b in self.bytes if b)


def slice_stats(sliced: DataFrame) -> DataFrame:
    """slice, rows, slice_bytes, output_offset, first_key, last_key of a partitioned relation."""
    key = F.struct(*ORDER)
    stats = sliced.groupBy("slice").agg(
        F.count("*").alias("rows"), F.sum(F.octet_length("line") + 1).alias("slice_bytes"), F.min(key).alias("first_key"), F.max(key).alias("last_key")
    )
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("output_offset", F.coalesce(F.sum("slice_bytes").over(before), F.lit(0)))


def balance(sliced: DataFrame, n: int) -> Slices:
    """Balance over n slices, empty ones included."""
    found = {r["slice"]: r for r in slice_stats(sliced).select("slice", "rows", "slice_bytes").collect()}
    return Slices(*([found[k][c] if k in found else 0 for k in range(n)] for c in ("rows", "slice_bytes")))


def ordered_slices(sliced: DataFrame) -> bool:
    """Whether every slice ends below the next one's start, equal lines apart."""
    w = Window.orderBy("slice")
    bad = slice_stats(sliced).withColumn("before", F.lag("last_key").over(w)).where("before > first_key")
    return bad.isEmpty()


def splitters(parsed: DataFrame, n: int) -> DataFrame:
    """The n - 1 order statistics that cut the relation into n equal shares: slice, rank, line."""
    total = parsed.count()
    wanted = [(k, k * total // n + 1) for k in range(1, n) if total]
    spark = parsed.sparkSession
    places = spark.createDataFrame(wanted, "slice int, rank long")
    return ranked(parsed).join(F.broadcast(places), "rank").select("slice", "rank", "line")


def sampled_splitters(parsed: DataFrame, n: int, sample: int = SAMPLE) -> DataFrame:
    """slice, line: n - 1 lines that cut the relation into about equal shares, from a bounded sample.

    The sample is the ``sample`` distinct lines of least md5, the same on every run and in any
    partitioning; tasks keep heaps of that size. Fewer distinct lines than slices give fewer splitters.
    """
    chosen = parsed.select(*ORDER).distinct().orderBy(F.md5("line"), "line").limit(sample)
    placed = chosen.withColumn("_r", F.row_number().over(Window.orderBy(*ORDER)) - 1)  # at most `sample` rows
    total = chosen.count()
    wanted = sorted({k * total // n: k for k in range(n - 1, 0, -1) if k * total // n}.items())
    places = parsed.sparkSession.createDataFrame([(k, r) for r, k in wanted], "slice int, _r int")
    return placed.join(F.broadcast(places), "_r").select("slice", "line")


def bit_reversed(n: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a number in reverse order: 0, 1, 2 ... spread evenly over the range."""
    return F.conv(F.reverse(F.lpad(F.bin(n), bits, "0")), 2, 10).cast("long")


def top(parsed: DataFrame, k: int) -> DataFrame:
    """The first k lines: a bounded heap per task, no full sort."""
    return parsed.orderBy(*ORDER).limit(k)


def between(parsed: DataFrame, low: Column, high: Column) -> DataFrame:
    """Lines whose string part is in [low, high)."""
    return parsed.where((F.col("string_part") >= low) & (F.col("string_part") < high))
