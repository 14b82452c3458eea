"""Verification that a file is a valid sort of another, from one scan of each."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions.grammar import DEFAULT_MAX_LINE, ORDER, PREVIEW_BYTES, parse, strip_cr
from lineweave.functions.hashing import fnv1a64, fnv1a64_column, unsigned_sum
from lineweave.operators.malformed import MalformedLine
from lineweave.sources.lines import edges, raw_lines
from lineweave.sources.shared import Scratch


@dataclass(frozen=True)
class Report:
    lines: int
    bytes: int
    hash: int


@dataclass(frozen=True)
class Verdict:
    """outcome: Verified, OrderViolation, OutputNotTerminated, CountMismatch or HashMismatch."""

    outcome: str
    input: Report
    output: Report
    detail: str = ""
    violation_line: int | None = None


def scan_report(lines: DataFrame) -> DataFrame:
    """One row: line_count, and hash, the sum of the lines' FNV-1a-64 modulo 2**64."""
    return lines.select(fnv1a64("line").alias("h")).agg(
        F.count("*").alias("line_count"), F.coalesce(unsigned_sum(F.col("h")), F.lit(0).cast("decimal(20,0)")).alias("hash")
    )


def shown(line: bytes) -> str:
    return line[:PREVIEW_BYTES].decode("utf-8", "replace")


@dataclass
class _Split:
    """What a scan keeps of one split: sums over its records but the last one, and that one by itself,
    since only the driver knows whether it is the file's last and counts. ``bad`` and ``low`` are the
    first malformed record and the first one below its predecessor."""

    role: int
    block: int
    lines: int = 0
    bytes: int = 0
    hash: int = 0
    bad: tuple | None = None  # lines and bytes before it, its preview
    low: tuple | None = None  # lines and bytes before it, hash of these, previews of both
    first: tuple | None = None
    last: tuple | None = None
    tail: tuple | None = None  # size, hash, whether it is malformed, whether it is below, previews of its predecessor and itself

    FIELDS = "role int, block long, lines long, bytes long, hash decimal(20,0), bad_lines long, bad_bytes long, bad_shown string, low_lines long, low_bytes long, low_hash decimal(20,0), low_before string, low_shown string, first_sp binary, first_number long, first_line binary, last_sp binary, last_number long, last_line binary, tail_bytes long, tail_hash decimal(20,0), tail_bad boolean, tail_low boolean, tail_before string, tail_shown string"

    def take(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        line, sp, number = batch.column("line"), batch.column("string_part"), batch.column("number")
        h = fnv1a64_column(line)
        size = batch.column("size").to_numpy().astype(np.int64)
        bad = batch.column("bad").to_numpy(zero_copy_only=False)
        low = np.zeros(n, bool)
        if self.role and n > 1:
            a, b = slice(0, n - 1), slice(1, n)
            cut = lambda c, s: c.slice(s.start, s.stop - s.start)
            more = lambda c: pc.greater(cut(c, a), cut(c, b))
            same = lambda c: pc.equal(cut(c, a), cut(c, b))
            ties = pc.and_(same(number), more(line))
            below = pc.or_(more(sp), pc.and_(same(sp), pc.or_(more(number), ties)))
            low[1:] = pc.fill_null(below, False).to_numpy(zero_copy_only=False)
        value = lambda i: line[i].as_py()
        key = lambda i: (sp[i].as_py(), number[i].as_py(), value(i))
        if self.role and self.last is not None and not bad[0] and self.last[1] is not None:
            low[0] = key(0) < self.last
        if self.tail is not None:  # the record that was last until now is not
            self._count(self.tail)
        if self.first is None:
            self.first = key(0)
        before = np.concatenate(([0], np.cumsum(size)))[:n]
        if self.bad is None and bad[:-1].any():
            i = int(bad[:-1].argmax())
            self.bad = self.lines + i, self.bytes + int(before[i]), shown(value(i))
        if self.low is None and low[:-1].any():
            i = int(low[:-1].argmax())
            earlier = value(i - 1) if i else self.last[2]
            self.low = self.lines + i, self.bytes + int(before[i]), (self.hash + int(h[:i].sum(dtype=np.uint64))) % 2**64, shown(earlier), shown(value(i))
        self.lines += n - 1
        self.bytes += int(before[-1])
        self.hash = (self.hash + int(h[:-1].sum(dtype=np.uint64))) % 2**64
        earlier = value(n - 2) if n > 1 else self.last[2] if self.last else b""
        self.last = key(n - 1)
        self.tail = int(size[-1]), int(h[-1]), bool(bad[-1]), bool(low[-1]), shown(earlier), shown(value(n - 1))

    def _count(self, tail: tuple) -> None:
        size, h, bad, low, earlier, text = tail
        if bad and self.bad is None:
            self.bad = self.lines, self.bytes, text
        if low and self.low is None:
            self.low = self.lines, self.bytes, self.hash, earlier, text
        self.lines, self.bytes, self.hash = self.lines + 1, self.bytes + size, (self.hash + h) % 2**64

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        nothing = (None,) * 5
        values = [self.role, self.block, self.lines, self.bytes, self.hash, *(self.bad or nothing[:3]), *(self.low or nothing), *self.first, *self.last, *self.tail]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema=schema)


def scanned(lines: DataFrame, role: int, max_line: int) -> DataFrame:
    """One row per split of a file (raw records with ``line``), from one pass over its lines, which
    are parsed where they are read and never shuffled. ``role`` 1 also checks the order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_Split.FIELDS))
    parsed = parse(lines)
    bad = (F.octet_length("line") > max_line) | F.col("number").isNull()
    columns = ["block", "line", "number", "string_part", (F.octet_length("raw") + 1).alias("size"), bad.alias("bad")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edge = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                if now is None or now.block != blocks[a]:
                    if now is not None:
                        yield now.row(schema)
                    now = _Split(role, int(blocks[a]))
                now.take(batch.slice(a, b - a))
        if now is not None:
            yield now.row(schema)

    return parsed.select(*columns).mapInArrow(scan, _Split.FIELDS)


def first_violation(parsed: DataFrame) -> DataFrame:
    """At most one row (block, seq, before, line): the first line below its predecessor.

    Neighbours meet within a split; across splits only each split's first and last line are
    compared, one row per split.
    """
    key = F.struct(*ORDER)
    inside = Window.partitionBy("block").orderBy("seq")
    within = parsed.select("block", "seq", "line", key.alias("key"), F.lag(key).over(inside).alias("before"))
    within = within.where("before > key").select("block", "seq", F.col("before.line").alias("before"), "line")
    ends = parsed.groupBy("block").agg(F.min_by(F.struct("seq", key.alias("key")), "seq").alias("head"), F.max_by(key, "seq").alias("tail"))
    across = ends.select("block", "head", F.lag("tail").over(Window.orderBy("block")).alias("before")).where("before > head.key")
    across = across.select("block", F.col("head.seq").alias("seq"), F.col("before.line").alias("before"), F.col("head.key.line").alias("line"))
    return within.union(across).orderBy("block", "seq").limit(1)


def _settled(splits: DataFrame, role: int, drop_last: bool) -> DataFrame:
    """The splits of one file in order, each with its last record counted, but the file's last record
    if it is none; and what stood before each split. One row per split."""
    at = Window.orderBy("block")
    mine = splits.where(F.col("role") == role).withColumn("_open", F.lit(drop_last) & F.lead("block").over(at).isNull())
    keep = ~F.col("_open")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    last = F.struct(F.col("last_sp").alias("sp"), F.col("last_number").alias("number"), F.col("last_line").alias("line"))
    mine = mine.withColumn("n", F.col("lines") + keep.cast("long")).withColumn("b", F.col("bytes") + F.when(keep, F.col("tail_bytes")).otherwise(0))
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return mine.withColumns({"n0": total("n"), "b0": total("b"), "before": F.lag(last).over(at)})


def verify_file(spark: SparkSession, input_path: str, output_path: str, max_line: int = DEFAULT_MAX_LINE) -> Verdict:
    """Holds ``output_path`` against ``input_path``; a malformed line in either raises MalformedLine.

    One job scans both files side by side and writes a row for each split; what is decided across
    splits is decided on these rows. What comes after the output's first violation of the order is
    not looked at. Outcomes by precedence: order, termination, line count, hash.
    """
    ends = edges(spark, input_path), edges(spark, output_path)
    scratch = Scratch(spark, "verify")
    raw = [raw_lines(spark, p) for p in (input_path, output_path)]
    both = scanned(raw[0].withColumn("line", strip_cr(F.col("raw"))), 0, max_line).unionAll(scanned(raw[1].withColumn("line", F.col("raw")), 1, max_line))
    try:
        return _verdict(scratch.table(both, "splits"), ends, input_path, output_path)
    finally:
        scratch.release()


def _verdict(splits: DataFrame, ends: tuple, input_path: str, output_path: str) -> Verdict:
    reports, lows = [], None
    for role, (edge, path) in enumerate(zip(ends, (input_path, output_path), strict=True)):
        drop = edge.bare_cr if role == 0 else not edge.terminated
        rows = _settled(splits, role, drop)
        keep, bom = ~F.col("_open"), edge.bom if role == 0 else 0
        place = lambda n, b: [(F.col("n0") + n).alias("n"), (F.col("b0") + b).alias("b")]
        inside = rows.where("bad_lines IS NOT NULL").select(*place(F.col("bad_lines"), F.col("bad_bytes")), F.col("bad_shown").alias("shown"))
        at_end = rows.where(keep & F.col("tail_bad") & F.col("bad_lines").isNull()).select(*place(F.col("lines"), F.col("bytes")), F.col("tail_shown").alias("shown"))
        bad = inside.unionAll(at_end).orderBy("n").first()
        if role and edge.bom:
            first = rows.orderBy("block").select("first_line").first()
            raise MalformedLine(1, 0, "\ufeff" + (shown(bytes(first[0])) if first else ""), path)
        if role:
            lows = _first_low(rows, keep)
        if bad is not None and (lows is None or bad["n"] < lows["n"]):
            raise MalformedLine(bad["n"] + 1, bad["b"] + bom, bad["shown"], path)
        hashes = F.sum(F.col("hash") + F.when(keep, F.col("tail_hash")).otherwise(0))
        n, h = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(hashes, F.lit(0))).first()
        reports.append(Report(n, edge.size, int(h) % 2**64))
    a, b = reports
    if lows is not None:
        n = lows["n"]
        detail = f'Line {n + 1} of the output, "{lows["shown"]}", belongs before its predecessor "{lows["before"]}".'
        return Verdict("OrderViolation", a, Report(n, ends[1].size, int(lows["h"]) % 2**64), detail, n + 1)
    if not ends[1].terminated:
        rest = _settled(splits, 1, True).where("_open").select("n0", "b0", "lines", "bytes", "tail_shown").first()
        n, at, text = (rest["n0"] + rest["lines"], rest["b0"] + rest["bytes"], rest["tail_shown"]) if rest else (0, 0, "")
        return Verdict("OutputNotTerminated", a, b, f'Line {n + 1} of the output, at byte offset {at}, has no line feed: "{text}".', n + 1)
    if a.lines != b.lines:
        return Verdict("CountMismatch", a, b, f"The input has {a.lines} lines and the output {b.lines}.")
    if a.hash != b.hash:
        return Verdict("HashMismatch", a, b, f"As many lines, but not the same: hash {a.hash:016x} of the input, {b.hash:016x} of the output.")
    return Verdict("Verified", a, b)


def _first_low(rows: DataFrame, keep: F.Column):
    """The output's first line below its predecessor: lines before it, their hash, previews; or None."""
    h0 = F.coalesce(F.sum(F.col("hash") + F.when(keep, F.col("tail_hash")).otherwise(0)).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("h0", h0)
    preview = lambda c: F.substring(c, 1, PREVIEW_BYTES)
    first = F.struct(F.col("first_sp").alias("sp"), F.col("first_number").alias("number"), F.col("first_line").alias("line"))
    whole = keep | (F.col("lines") > 0)  # the split has a line of its own
    inside = rows.where("low_lines IS NOT NULL").select((F.col("n0") + F.col("low_lines")).alias("n"), (F.col("h0") + F.col("low_hash")).alias("h"), F.col("low_before").alias("before"), F.col("low_shown").alias("shown"))
    tail = rows.where(keep & F.col("tail_low") & F.col("low_lines").isNull()).select((F.col("n0") + F.col("lines")).alias("n"), (F.col("h0") + F.col("hash")).alias("h"), F.col("tail_before").alias("before"), F.col("tail_shown").alias("shown"))
    across = rows.where(whole & F.col("before.number").isNotNull() & F.col("first_number").isNotNull() & (F.col("before") > first)).select(
        F.col("n0").alias("n"), F.col("h0").alias("h"), F.make_valid_utf8(preview(F.col("before.line")).cast("string")).alias("before"), F.make_valid_utf8(preview(F.col("first_line")).cast("string")).alias("shown")
    )
    return inside.unionAll(tail).unionAll(across).orderBy("n").first()


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """line, surplus: how many more times ``left`` has a line than ``right`` (negative: fewer). Exact
    where the hash can only say that multisets probably agree."""
    signed = left.select("line", F.lit(1).alias("n")).unionAll(right.select("line", F.lit(-1).alias("n")))
    return signed.groupBy("line").agg(F.sum("n").alias("surplus")).where("surplus <> 0")
