"""Exact repeats of long byte strings, by a logarithmic family of sparse suffix arrays.

Which bytes lie in a string of ``length`` bytes that also starts elsewhere? Every window of that
length holds an anchor, the place in it whose following K bytes have the least hash; equal windows
have their anchor (the first such place) at the same offset. Windows that share an anchor lie side
by side; the string from the first one's start to the last one's end is a block. So:

1. Candidates. One scan counts the anchors' hashes. An anchor that occurs once has no repeated
   window, so only blocks of the others are indexed.
2. The index. Documents come in ``BATCHES`` batches. The distinct blocks of a batch get suffix arrays
   over all their windows, in true suffix order (compared byte by byte, as far as a window reaches).
   Each new array is merge-scanned against the arrays of every level: windows that fall beside an
   equal one are repeats. Then levels of equal size merge, so their sizes grow geometrically.
   Levels are tables in the shared folder; a row is a unit of the index, the blocks of some anchors.
3. What the scans found of a block holds for every place where that block stands.

Equal windows are in one unit, as the unit follows from the anchor. An anchor with very many
different blocks (a common line in ever different surroundings) is dealt more finely: its blocks are
cut into pieces of ``SPAN`` windows, each dealt by the bytes that all windows of the piece share.
Pieces that meet differ in fewer than 2 * SPAN bytes at their ends, so few different ones do.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import Bytes, Scratch, mix, small_batches

#: Bytes of a repeat; bytes of an anchor.
LENGTH, K = 200, 64
_CHUNK = 1 << 16
#: Batches of documents that enter the index one after the other.
BATCHES = 4
#: Bytes of blocks of a unit of the index, all batches together; one task holds a unit at a time.
UNIT = 1 << 20
#: Different blocks of an anchor from which they are cut into pieces; windows of a piece.
HOT, SPAN = 1000, 8


@dataclass
class Blocks:
    """Blocks of some texts, text by text: text, first window, number of windows, place and hash of
    the anchor. Positions count from the start of the text."""

    doc: np.ndarray
    at: np.ndarray
    count: np.ndarray
    spot: np.ndarray
    anchor: np.ndarray
    begin: np.ndarray  # of each text in ``buffer``
    buffer: Bytes | None


def anchors(texts: list[bytes], length: int = LENGTH, k: int = K) -> Blocks:
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    none = Blocks(*(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64), begin, None)
    data = b"".join(texts)
    if len(data) < length:
        return none
    buffer = Bytes(data)
    n = buffer.n
    starts = np.arange(n - k + 1)
    h = buffer.hashes(starts, starts + k)
    wide = length - k + 1
    # the first place of the least hash (its upper half) among `wide` neighbours, by doubling; a
    # place stands below its hash in one number, so the least number is the first least hash
    least, span = (h & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64), 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    windows = n - length + 1
    least = np.minimum(least[:windows], least[wide - span : wide - span + windows])
    least = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that lie within a text, text by text
    inside = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(texts)), inside)
    if not len(doc):
        return none
    place = np.arange(len(doc)) + np.repeat(begin - (np.cumsum(inside) - inside), inside)
    spot = least[place]
    first = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(first, len(place)))
    spot, doc, at = spot[first], doc[first], place[first]
    return Blocks(doc, at - begin[doc], count, spot - begin[doc], h[spot], begin, buffer)


def in_chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


# ---------------------------------------------------------------- the index


class Level:
    """A suffix array over the windows of some strings, each string under a name of two longs.

    ``order`` holds the places of windows in ``text``, in suffix order as far as a window reaches;
    of equal windows it holds one.
    """

    _HEAD = struct.Struct("<4Q")

    def __init__(self, text: np.ndarray, size: np.ndarray, names: np.ndarray, order: np.ndarray):
        self.text, self.size, self.names, self.order = text, size, names, order

    @classmethod
    def build(cls, text: np.ndarray, size: np.ndarray, names: np.ndarray, length: int) -> tuple[Level, np.ndarray]:
        """The array of new strings, and the places of windows that occur twice among them."""
        count = np.maximum(size - length + 1, 0)
        begin = np.cumsum(size) - size
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        level = cls(text, size, names, at)
        windows = np.empty((len(at), length), np.uint8)
        level._windows(windows)
        return level._sorted(windows)

    def _windows(self, out: np.ndarray) -> None:
        """Puts the windows themselves, in the array's order, into the rows of ``out``."""
        if len(self.order):
            view = np.lib.stride_tricks.sliding_window_view(self.text, out.shape[1])
            for i in range(0, len(self.order), 4096):
                out[i : i + 4096] = view[self.order[i : i + 4096]]

    def _sorted(self, windows: np.ndarray) -> tuple[Level, np.ndarray]:
        """Sorts by the windows (a stable sort: it merges what is in order already), finds equal
        neighbours, and keeps one of each."""
        n, length = windows.shape
        # one fixed width for all, so the order of such strings is that of their bytes, zeros included
        by = np.argsort(windows.view(f"S{length}").ravel(), kind="stable") if n else np.zeros(0, np.int64)
        order = self.order[by]
        tail = windows[:, -8:].copy().view(np.uint64).ravel()[by] if n and length >= 8 else by * 0
        maybe = np.flatnonzero(tail[1:] == tail[:-1])
        same = np.zeros(max(0, n - 1), bool)
        for i in range(0, len(maybe), 1 << 14):
            some = maybe[i : i + (1 << 14)]
            same[some] = (windows[by[some]] == windows[by[some + 1]]).all(1)
        twice = np.zeros(n, bool)
        twice[1:] |= same
        twice[:-1] |= same
        keep = np.concatenate(([True], ~same))[:n]
        return Level(self.text, self.size, self.names, order[keep]), order[twice]

    def merged(self, other: Level, length: int) -> tuple[Level, np.ndarray]:
        """Both arrays in one, by a merge of the two sorted sequences, and the places (in the joint
        text) of windows that met an equal one."""
        n = len(self.order)
        windows = np.empty((n + len(other.order), length), np.uint8)
        self._windows(windows[:n]), other._windows(windows[n:])
        joint = Level(
            np.concatenate([self.text, other.text]), np.concatenate([self.size, other.size]),
            np.concatenate([self.names, other.names]), np.concatenate([self.order, other.order + len(self.text)]),
        )
        return joint._sorted(windows)

    def runs(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows' places as runs within strings: number of the string, first byte, last byte + 1."""
        places = np.sort(places)
        begin = np.cumsum(self.size) - self.size
        owner = np.searchsorted(begin, places, side="right") - 1
        new = np.concatenate(([True], (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1])))[: len(places)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(places)) - 1
        return owner[first], places[first] - begin[owner[first]], places[last[: len(first)]] - begin[owner[first]] + length

    def to_bytes(self) -> bytes:
        """The level without the strings that have no window left in it; the text compressed, as
        strings of one anchor are much alike."""
        begin = np.cumsum(self.size) - self.size
        owner = np.searchsorted(begin, self.order, side="right") - 1
        used = np.zeros(len(self.size), bool)
        used[owner] = True
        number = np.cumsum(used) - 1
        text, size = pa.compress(self.text[np.repeat(used, self.size)].tobytes(), "zstd", asbytes=True), self.size[used]
        wide, inside = "<u2" if len(size) <= 1 << 16 else "<u4", self.order - begin[owner]
        deep = 1 if inside.max(initial=0) < 256 else 4
        head = self._HEAD.pack(len(size), len(self.order), len(text), deep)
        parts = [size.astype("<u4"), self.names[used].astype("<i8"), number[owner].astype(wide), inside.astype(f"<u{deep}")]
        return head + b"".join(x.tobytes() for x in parts) + text

    @classmethod
    def from_bytes(cls, blob: bytes) -> Level:
        n, windows, packed, deep = cls._HEAD.unpack_from(blob)
        at = cls._HEAD.size
        size = np.frombuffer(blob, "<u4", n, at).astype(np.int64)
        names = np.frombuffer(blob, "<i8", 2 * n, at + 4 * n).reshape(n, 2)
        wide = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        owner = np.frombuffer(blob, wide, windows, at + 20 * n).astype(np.int64)
        inside = np.frombuffer(blob, f"<u{deep}", windows, at + 20 * n + wide.itemsize * windows).astype(np.int64)
        text = pa.decompress(memoryview(blob)[len(blob) - packed :], int(size.sum()), "zstd", asbytes=True) if n else b""
        return cls(np.frombuffer(text, np.uint8), size, names, (np.cumsum(size) - size)[owner] + inside)


def enter(fresh: Level, levels: dict[int, Level], merge: int, length: int) -> tuple[Level, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Merge-scans a new array against all levels and merges it with those below ``merge``. Returns
    the merged array and what was found: names of strings, first byte, last byte + 1 of runs."""
    found, carry = [], fresh
    for number in sorted(levels):
        joint, places = (carry if number < merge else fresh).merged(levels[number], length)
        owner, first, last = joint.runs(places, length)
        found.append((joint.names[owner], first, last))
        if number < merge:
            carry = joint
    return carry, found


def merge_depth(batch: int) -> int:
    """Of a family that took ``batch`` batches: how many of its levels have the size that the next
    batch, merged upwards, will have; the levels there are the bits of ``batch``."""
    depth = 0
    while batch >> depth & 1:
        depth += 1
    return depth


# ---------------------------------------------------------------- the plan around it


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _pieces(blocks: Blocks, some: np.ndarray, hot: np.ndarray, length: int, span: int) -> tuple[np.ndarray, ...]:
    """Of the blocks numbered ``some``: block, first byte and last byte + 1 in the buffer, and the
    number that says to which unit it goes. Blocks of ``hot`` anchors are cut into pieces."""
    base = blocks.begin[blocks.doc[some]]
    first = base + blocks.at[some]
    last = first + blocks.count[some] + length - 1
    whole = ~hot
    out = [(some[whole], first[whole], last[whole], blocks.anchor[some][whole])]
    if hot.any():
        spot, n = (base + blocks.spot[some])[hot], blocks.count[some][hot]
        far = spot - first[hot]  # of the first window from the anchor; the others are nearer, one by one
        top, low = far // span, (far - n + 1) // span
        many = top - low + 1
        row = np.repeat(np.arange(len(many)), many)
        piece = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        upper, lower = np.minimum(far[row], piece * span + span - 1), np.maximum((far - n + 1)[row], piece * span)
        # all windows of the piece, in this text or another, have these bytes
        core = blocks.buffer.hashes(spot[row] - piece * span, spot[row] - piece * span - span + 1 + length)
        out.append((some[hot][row], spot[row] - upper, spot[row] - lower + length, mix(core + piece.astype(np.uint64))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Index:
    """The step of one batch, unit by unit, over rows sorted by unit."""

    def __init__(self, length: int, merge: int, keep: bool):
        self.length, self.merge, self.keep = length, merge, keep

    def unit(self, unit: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        old = pc.greater_equal(rows.column("level"), 0)
        blobs, new = rows.filter(old), rows.filter(pc.invert(old)).combine_chunks()
        levels = {n: Level.from_bytes(blob) for n, blob in zip(blobs.column("level").to_pylist(), blobs.column("bytes").to_pylist(), strict=True)}
        names = np.stack([new.column(c).to_numpy() for c in ("h1", "h2")], 1)
        n = new.column("n").to_numpy()
        order = np.lexsort((names[:, 1], names[:, 0]))
        names, n = names[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(1)))[: len(names)])
        n = np.add.reduceat(n, first) if len(first) else n
        strings = new.column("bytes").take(pa.array(order[first]))
        size = pc.binary_length(strings).to_numpy().astype(np.int64)
        text = np.frombuffer(b"".join(strings.to_pylist()), np.uint8)
        names = names[first]
        twice = np.flatnonzero(n > 1)
        found = [(names[twice], np.zeros(len(twice), np.int64), size[twice])]
        fresh, places = Level.build(text, size, names, self.length)
        owner, start, end = fresh.runs(places, self.length)
        found.append((names[owner], start, end))
        own = sum(len(f[0]) for f in found)
        carry, more = enter(fresh, levels, self.merge if self.keep else 0, self.length)
        found += more
        name, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(name):
            yield self._rows(unit, len(name), h1=name[:, 0], h2=name[:, 1], at=start, end=end, scanned=np.arange(len(name)) >= own)
        if self.keep:
            yield self._rows(unit, 1, blob=[carry.to_bytes()])

    FIELDS = {"unit": pa.int64(), "blob": pa.binary(), "h1": pa.int64(), "h2": pa.int64(), "at": pa.int64(), "end": pa.int64(), "scanned": pa.bool_(), "is_level": pa.bool_()}
    SCHEMA = "unit long, blob binary, h1 long, h2 long, at long, end long, scanned boolean, is_level boolean"

    def _rows(self, unit: int, n: int, **columns) -> pa.RecordBatch:
        columns |= {"unit": np.full(n, unit), "is_level": np.full(n, "blob" in columns)}
        arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in self.FIELDS.items()]
        return pa.RecordBatch.from_arrays(arrays, list(self.FIELDS))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            units = batch.column("unit").to_numpy()
            edges = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if units[a] != now and parts:
                    yield from self.unit(now, pa.Table.from_batches(parts))
                    parts = []
                now = int(units[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from self.unit(now, pa.Table.from_batches(parts))


def removed_runs(docs: DataFrame, length: int = LENGTH, k: int = K, batches: int = BATCHES, hot: int = HOT, unit_bytes: int = UNIT) -> tuple[DataFrame, Scratch]:
    """(key, found) of the texts of ``docs`` (key binary, text) that have covered bytes: ``found`` is
    a set of (at, runs), runs of covered bytes counted from ``at``; they may overlap. ``key`` must
    name a text: rows of one key have one text. The scratch holds what the result reads.

    Texts are scanned three times and shuffled once, beside the blocks that were cut out. A block's
    name is two independent 64-bit hashes of its bytes: copies of a block enter the index once a
    batch, with their number, so no group of copies is ever together in one task."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeats")

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct anchor hashes of a task with their counts; it holds at most the task's anchors."""
        seen: list[np.ndarray] = []
        for batch in rows:
            for _, some in in_chunks(_encoded(batch)):
                seen.append(anchors(some, length, k).anchor.view(np.int64))
        values, n = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)
        for i in range(0, len(values), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(values[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["anchor", "n"])

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys = batch.column("key")
            for first, some in in_chunks(_encoded(batch)):
                b = anchors(some, length, k)
                if not len(b.doc):
                    continue
                at = b.begin[b.doc] + b.at
                nth = (np.arange(len(b.doc)) - np.searchsorted(b.doc, b.doc)).astype(np.int32)
                whole = b.buffer.hashes(at, at + b.count + length - 1).view(np.int64)
                columns = [pa.array(b.anchor.view(np.int64)), pa.array(whole), pa.array(nth), keys.take(pa.array(first + b.doc))]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "whole", "nth", "key"])

    counts = docs.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    # written, as are others below, so that both sides of a join are exchanges, whose hot partitions Spark can split
    counts = scratch.table(counts, "anchors")
    blocks = docs.select("key", "text").mapInArrow(emit, "anchor long, whole long, nth int, key binary")
    shared = scratch.table(blocks.join(counts, "anchor"), "shared")
    many = shared.groupBy("anchor", "whole").agg(F.lit(1)).groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot)
    many = scratch.table(many.select("anchor", F.lit(1).alias("hot")), "many")
    if many.isEmpty():
        todo = shared.select("key", (F.col("nth") * 2).alias("todo"))
    else:
        todo = shared.join(many, "anchor", "left").select("key", (F.col("nth") * 2 + F.coalesce("hot", F.lit(0))).alias("todo"))
    todo = todo.groupBy("key").agg(F.collect_set("todo").alias("todo"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each place of a block, and one with its bytes for each block of the rows at hand."""
        for batch in rows:
            texts, keys, part, todo = _encoded(batch), batch.column("key"), batch.column("part").to_numpy(), batch.column("todo")
            begin, codes = todo.offsets.to_numpy(), todo.flatten().to_numpy()
            begin = begin - begin[0]
            parts, data = [], []
            for first, some in in_chunks(texts):
                b = anchors(some, length, k)
                mine = codes[begin[first] : begin[first + len(some)]]
                if not len(mine):
                    continue
                doc = np.repeat(np.arange(len(some)), np.diff(begin[first : first + len(some) + 1]))
                number = np.searchsorted(b.doc, doc) + mine // 2
                block, start, end, seed = _pieces(b, number, mine % 2 == 1, length, SPAN)
                h1 = mix(b.buffer.hashes(start, end) + (end - start).astype(np.uint64))
                raw = b.buffer.data.tobytes()
                h2 = np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)
                doc = b.doc[block]
                parts.append((first + doc, start - b.begin[doc], seed, h1, h2, start, end, np.full(len(doc), len(data))))
                data.append(raw)
            if not parts:
                continue
            doc, at, seed, h1, h2, start, end, chunk = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = part[doc]
            order = np.lexsort((h2, h1, own))
            new = np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]) | (own[order][1:] != own[order][:-1])))
            one = np.flatnonzero(new)
            one, n = order[one], np.diff(np.append(one, len(order)))
            strings = [data[c][x:y] for c, x, y in zip(chunk[one].tolist(), start[one].tolist(), end[one].tolist(), strict=True)]
            m, s = len(doc), len(one)
            out = [
                pa.concat_arrays([pa.array(np.full(m, -1, np.int32)), pa.array(own[one].astype(np.int32))]),
                pa.array(np.concatenate([seed, seed[one]]).view(np.int64)),
                pa.array(np.concatenate([h1, h1[one]]).view(np.int64)),
                pa.array(np.concatenate([h2, h2[one]]).view(np.int64)),
                pa.array(np.concatenate([np.ones(m, np.int64), n])),
                pa.array(np.concatenate([at, (end - start)[one]])),
                pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array(strings, pa.binary())]),
                pa.concat_arrays([keys.take(pa.array(doc)).cast(pa.binary()), pa.nulls(s, pa.binary())]),
            ]
            yield pa.RecordBatch.from_arrays(out, ["part", "seed", "h1", "h2", "n", "at", "bytes", "key"])

    schema = "part int, seed long, h1 long, h2 long, n long, at long, bytes binary, key binary"
    numbered = docs.select("key", "text", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(batches)).cast("int").alias("part"))
    path = scratch.path("work")
    numbered.join(todo, "key").mapInArrow(cut, schema).write.partitionBy("part").option("compression", "zstd").parquet(path)
    work = spark.read.schema(schema).parquet(path)
    scratch.forget("anchors", "shared", "many")
    total = work.where("part >= 0").agg(F.sum("at")).first()[0] or 0
    units = max(1, -(-int(total) // unit_bytes))

    levels: dict[int, tuple[str, DataFrame]] = {}
    verdicts = []
    for batch in range(batches):
        merge, last = merge_depth(batch), batch == batches - 1
        rows = work.where(F.col("part") == batch).select(F.pmod(F.xxhash64("seed"), F.lit(units)).alias("unit"), F.lit(-1).alias("level"), "h1", "h2", "n", "bytes")
        for number, (_, table) in levels.items():
            rows = rows.unionByName(table.select("unit", F.lit(number).alias("level"), F.col("blob").alias("bytes")), allowMissingColumns=True)
        rows = rows.repartition("unit").sortWithinPartitions("unit", "level")
        out = scratch.path("batch")
        # nothing comes after the last batch, so its arrays are not kept
        rows.mapInArrow(_Index(length, merge, not last), _Index.SCHEMA).write.partitionBy("is_level").option("compression", "zstd").parquet(out)
        written = spark.read.schema(_Index.SCHEMA).parquet(out)
        verdicts.append(written.where("NOT is_level").select("h1", "h2", "at", "end"))
        for number in range(merge):
            scratch.drop(f"{levels.pop(number)[0]}/is_level=true")
        levels[merge] = out, written.where("is_level")
        if not work.where(F.col("part") == batch).isEmpty():
            scratch.drop(f"{path}/part={batch}")  # the levels have its strings
    found = verdicts[0]
    for more in verdicts[1:]:
        found = found.unionAll(more)
    found = scratch.table(found.groupBy("h1", "h2").agg(F.collect_set(F.struct("at", "end")).alias("runs")), "found")
    runs = work.where("part < 0").select("h1", "h2", "key", "at").join(found, ["h1", "h2"])
    return runs.groupBy("key").agg(F.collect_set(F.struct("at", "runs")).alias("found")), scratch


def kept_bytes(texts: list[bytes], found: pa.ListArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Of some texts and what ``removed_runs`` found of each: the bytes that stay, how many go, and in
    how many stretches."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1  # a byte between texts, so that stretches end with their text
    struct_ = found.values
    runs = struct_.field("runs")
    doc = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    first = int(found.offsets[0].as_py()) if len(found) else 0
    inner = runs.offsets.to_numpy()[first : first + len(doc) + 1]
    base = np.repeat(begin[doc] + struct_.field("at").to_numpy(zero_copy_only=False)[first : first + len(doc)], np.diff(inner))
    at, end = (runs.values.field(c).to_numpy(zero_copy_only=False)[inner[0] : inner[-1]] if len(doc) else np.zeros(0, np.int64) for c in ("at", "end"))
    edge = np.zeros(int(size.sum()) + len(texts) + 1, np.int32)
    np.add.at(edge, base + at, 1)
    np.add.at(edge, base + end, -1)
    covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
    removed = np.add.reduceat(covered, begin, dtype=np.int64) if len(texts) else size
    starts = np.diff(covered.view(np.int8), prepend=0) == 1
    spans = np.add.reduceat(starts, begin, dtype=np.int64) if len(texts) else size
    out = list(texts)
    for i in np.flatnonzero(removed).tolist():
        mine = covered[begin[i] : begin[i] + size[i]]
        out[i] = b"" if removed[i] == size[i] else np.frombuffer(texts[i], np.uint8)[~mine].tobytes()
    return out, removed, spans


def text_key(doc_id: str, text: str) -> F.Column:
    """128 bits that name a row's doc_id and text. Rows equal in both share it; they are repeats of
    each other."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\0"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, **index: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes that stay) of each
    row of ``docs`` (doc_id, text).

    A null text is empty. Texts shorter than ``length`` lose nothing. Exact copies of longer texts
    lose everything. Repeated rows and null doc_ids are documents like others. Strings within one
    text count, also where they overlap. Very long texts are one document like others, in one task.
    Other columns are not read. ``index``: see ``removed_runs``.
    """
    rows = docs.select("doc_id", "text").withColumn("key", text_key("doc_id", "text"))
    runs, _ = removed_runs(rows.select("key", "text"), length, **index)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _encoded(batch)
            kept, removed, spans = kept_bytes(texts, batch.column("found"))
            numbers = [pa.array(np.array([len(t) for t in texts], np.int64)), pa.array(removed), pa.array(spans)]
            sha = pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers, sha, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    joined = rows.join(runs, "key", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def cut_repeats(docs: DataFrame, length: int = LENGTH, **index: int) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and other columns) with the covered bytes cut out of ``text``.

    A null text stays null. Where a cut splits a character, what is left of it goes too. ``n_chars``
    is counted anew where it was not null and the text changed. No row is dropped.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", text_key("row.doc_id", "row.text"))
    runs, _ = removed_runs(rows.select("key", F.col("row.text").alias("text")), length, **index)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column("row").flatten(), strict=True))
            texts, chars = columns["text"].to_pylist(), columns["n_chars"].to_pylist()
            kept, removed, _ = kept_bytes([b"" if t is None else t.encode() for t in texts], batch.column("found"))
            for i in np.flatnonzero(removed).tolist():
                texts[i] = kept[i].decode("utf-8", "ignore")
                chars[i] = chars[i] if chars[i] is None else len(texts[i])
            columns |= {"text": pa.array(texts, pa.string()), "n_chars": pa.array(chars, columns["n_chars"].type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return rows.join(runs, "key", "left").select("row", "found").mapInArrow(cut, docs.schema)
