"""Packing documents into fixed windows by non-negative least squares over length combinations."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.bpe import MEMO, Encoder, kept, tokenizer_json
from lineweave.llm.common import Scratch, small_batches

#: Rows ranked together; there are as many groups as keep to about this size.
RANKED_ROWS = 20_000
#: Above every rank; a length and a rank make one search key.
BIG = 1 << 44


def combinations(window: int) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill a window exactly.

    All pairs; triples with any first length and a few second ones, and all triples on a lattice of
    1/128 of the window; quadruples of three equal lengths and one other.
    """
    found = {(a, window - a) for a in range(1, window // 2 + 1)}
    for a in range(1, window // 3 + 1):
        rest = window - a
        for b in (a, rest // 4, rest // 3, 2 * rest // 5, rest // 2):
            found.add(tuple(sorted((a, b, rest - b))))
    step = max(1, window // 128)
    for a in range(step, window // 3 + 1, step):
        for b in range(a, (window - a) // 2 + 1, step):
            found.add((a, b, window - a - b))
    for a in range(1, (window - 1) // 3 + 1):
        found.add(tuple(sorted((a, a, a, window - 3 * a))))
    return sorted(c for c in found if min(c) > 0)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the columns (multisets of lengths) with least squared distance of
    their summed histogram from ``target``, by accelerated projected gradient steps."""
    if not columns:
        return np.zeros(0)
    row = np.array([length for c in columns for length in c])
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    size, n = len(target), len(columns)
    apply = lambda x: np.bincount(row, x[col], size)
    back = lambda r: np.bincount(col, r[row], n)
    v = np.ones(n)
    for _ in range(30):  # the largest eigenvalue sets the step
        v = back(apply(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y + back(target - apply(y)) / (1.05 * top))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of every kind of sequence; together they use the histogram exactly.

    ``histogram[k]`` counts remainders of k tokens, 1 <= k < window. Solves for repeats of the
    exact combinations, rounds down, keeps them within what is there, and packs what is left
    greedily: the longest remainder first, then the longest that still fits. All work is on the
    histogram, whose size is that of the window, not of the data.
    """
    left = histogram.astype(np.int64).copy()
    columns = [c for c in combinations(window) if all(left[k] > 0 for k in c)]
    repeats = np.floor(nnls(columns, left.astype(float)) + 1e-6).astype(np.int64)
    out: list[tuple[tuple[int, ...], int]] = []
    for i in np.argsort(-repeats, kind="stable"):
        use = Counter(columns[i])
        m = min(int(repeats[i]), *(int(left[k]) // c for k, c in use.items()))
        if m > 0:
            out.append((columns[i], m))
            for k, c in use.items():
                left[k] -= m * c
    lengths = [int(k) for k in np.flatnonzero(left)]
    while lengths:
        chosen, room, use = [], window, Counter()
        at = len(lengths)
        while room > 0 and (at := bisect_right(lengths, room, hi=at)) > 0:
            k = lengths[at - 1]
            if use[k] < left[k]:
                use[k] += 1
                chosen.append(k)
                room -= k
            else:
                at -= 1
        m = min(int(left[k]) // c for k, c in use.items())
        out.append((tuple(chosen), m))
        for k, c in use.items():
            left[k] -= m * c
            if not left[k]:
                lengths.remove(k)
    return out


def slots(kinds: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted search keys (length, first rank), and for each key the first sequence and the offset.

    The document of rank r among those of one length goes to the slot with the last key at or below
    (length, r): its sequence is the slot's first one plus the ranks passed since the key.
    """
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, m in kinds:
        offset = 0
        for k in lengths:
            rows.append((k * BIG + used[k], sequence, offset))
            used[k] += m
            offset += k
        sequence += m
    rows.sort()
    key, first, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return key, first, offset, sequence


def measured(docs: DataFrame, tokenizer: str, end_id: int, window: int, memo: int = MEMO) -> DataFrame:
    """doc_id, doc_tokens (with the end id) and the crc32 of each run of ``window`` ids."""
    spec = tokenizer_json(tokenizer)
    end = struct.pack("<I", end_id)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(Encoder, spec, memo)
        for batch in batches:
            n, crcs = [], []
            for text in encoder.texts(batch.column("text")):
                ids = memoryview(text + end)
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"]
            )

    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, memo: int = MEMO) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A document of n ids gives n // window full sequences and one remainder. Texts are tokenised
    once and do not move; what is shuffled is a few numbers per document. The remainders' histogram
    (fewer than ``window`` counts) goes to the driver, which plans sequences on it. Documents find
    their place by their rank among remainders of the same length. Ranks are counted in salted
    groups, so neither a frequent length nor any number of equal rows makes a hot key: a rank is the
    group's offset plus the rank in it. Groups are drawn by the rows' numbers.

    Null texts are empty and have the end id alone; null or repeated doc_ids are documents like
    others; an empty table gives no piece.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    # rows are numbered where they are written, so that rows alike in all else can be told apart
    sizes = scratch.table(measured(docs, tokenizer, end_id, window, memo).withColumn("row", F.monotonically_increasing_id()), "sizes")
    sizes = sizes.withColumn("rest", F.col("doc_tokens") % window).withColumn("full", F.floor(F.col("doc_tokens") / window))
    counted = sizes.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()  # at most `window` rows
    histogram = np.zeros(window + 1, np.int64)
    for r in counted:
        histogram[r["rest"]] = r["n"]
    full_total, rows = sum(r["full"] for r in counted), int(histogram.sum())
    histogram[0] = 0
    key, first, shift, _ = slots(plan(histogram, window))

    salts = max(16, -(-rows // RANKED_ROWS))
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    groups = salted.groupBy("salt", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("full"))
    # offsets: of a length over the salts before; of full sequences over the groups before, in two steps
    per_salt = groups.groupBy("salt").agg(F.sum("full").alias("f"))
    before = Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per_salt = per_salt.select("salt", F.coalesce(F.sum("f").over(before), F.lit(0)).alias("full_base"))
    by_rest = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("salt", "rest", F.coalesce(F.sum("n").over(by_rest), F.lit(0)).alias("rank_base")).join(per_salt, "salt")
    order = ["doc_id", "doc_tokens", "row"]
    in_group = Window.partitionBy("salt", "rest").orderBy(*order)
    in_salt = Window.partitionBy("salt").orderBy("rest", *order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        salted.withColumn("full_at", F.coalesce(F.sum("full").over(in_salt), F.lit(0)))
        .withColumn("rank", F.row_number().over(in_group) - 1)
        .join(offsets, ["salt", "rest"])
        .select("doc_id", "doc_tokens", "crcs", "rest", (F.col("rank") + F.col("rank_base")).alias("rank"), (F.col("full_at") + F.col("full_base")).alias("full_at"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("doc_tokens").to_numpy().astype(np.int64)
            rest, rank, full_at = (batch.column(c).to_numpy().astype(np.int64) for c in ("rest", "rank", "full_at"))
            full = n // window
            pieces = full + (rest > 0)
            doc = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            whole = nth < full[doc]
            sequence, offset = full_at[doc] + nth, np.zeros(len(doc), np.int64)
            wanted = rest[doc][~whole] * BIG + rank[doc][~whole]
            slot = np.searchsorted(key, wanted, side="right") - 1
            sequence[~whole] = full_total + first[slot] + (wanted - key[slot])
            offset[~whole] = shift[slot]
            crcs = batch.column("crcs")
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(doc)),
                "start": pa.array(nth * window),
                "length": pa.array(np.where(whole, window, rest[doc])),
                "ids_crc32": crcs.flatten(),
                "doc_tokens": pa.array(n[doc]),
                "sequence_id": pa.array(sequence),
                "offset": pa.array(offset),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return ranked.mapInArrow(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
