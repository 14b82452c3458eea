"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lineweave.llm.common import Bytes, small_batches, texts_of, word_runs

#: Shortest run of tokens that is a seed or a tile.
MIN_MATCH = 5
#: Share of an item's tokens under tiles from which a document is contaminated by it.
COVERAGE = 0.6
#: Characters of benchmark text that travel to the workers at once; a larger benchmark goes in blocks.
BLOCK_CHARS = 8 << 20
_CHUNK = 1 << 17
NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def plain(text: str) -> bytes:
    """Lower case; one blank for each run of characters other than letters and digits."""
    return NOT_WORD.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, end to end, and the text of each."""
    data = b"\n".join(texts)
    buffer = Bytes(data)
    start, end = word_runs(buffer.data)
    size = np.array([len(t) + 1 for t in texts])
    return buffer.hashes(start, end), np.searchsorted(np.cumsum(size) - size, start, side="right") - 1


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Running hashes of all runs of n tokens, from one prefix sum."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - n + 1)
    return Bytes(words).hashes(at, at + n)


def _under(starts: np.ndarray, size: int, width: int) -> np.ndarray:
    """Flags of the places that runs of ``width`` from ``starts`` cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


class _Side:
    """Tokens of one side that lie under shared seeds, pressed together with a gap between stretches,
    and which of them are unmarked."""

    def __init__(self, words: np.ndarray, covered: np.ndarray):
        at = np.flatnonzero(covered)
        gap = np.concatenate(([0], np.diff(at) > 1)).cumsum() if len(at) else at
        self.place = np.full(len(at) + (int(gap[-1]) if len(at) else 0), -1)
        self.place[np.arange(len(at)) + gap] = at
        self.free = self.place >= 0
        self.words = np.where(self.free, words[self.place], 0) if len(at) else words[:0]
        self.hashes = Bytes(self.words)

    def longest(self) -> int:
        edge = np.diff(np.concatenate(([0], self.free.view(np.int8), [0])))
        return int((np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).max(initial=0))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the unmarked runs of n tokens."""
        total = np.concatenate(([0], np.cumsum(self.free)))
        at = np.flatnonzero(total[n:] - total[:-n] == n) if len(self.free) >= n else np.zeros(0, np.int64)
        return at, self.hashes.hashes(at, at + n)


def tile(pattern: np.ndarray, text: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of token hashes: (place in pattern, place in text, length), no overlaps.

    Tokens that share no seed of ``least`` with the other side cannot be in a tile and are left out.
    Each round finds the length of the longest match among unmarked tokens by running Karp-Rabin
    hashes of one length for all places at once, halving the range of lengths; then marks matches of
    that length from the pattern's start, each at the first place in the text that is unmarked. So a
    round takes time in proportion to both sides, not to their product, however often they repeat
    themselves. It ends when no match of ``least`` tokens is left.
    """
    hp, ht = _grams(pattern, least), _grams(text, least)
    p = _Side(pattern, _under(np.flatnonzero(np.isin(hp, ht)), len(pattern), least))
    t = _Side(text, _under(np.flatnonzero(np.isin(ht, hp)), len(text), least))
    tiles: list[tuple[int, int, int]] = []
    while True:
        low, high, matches = least - 1, min(p.longest(), t.longest()), None
        while low < high:
            n = (low + high + 1) // 2
            (ap, hp), (at, ht) = p.runs(n), t.runs(n)
            shared = np.isin(hp, ht)
            if shared.any():
                low, matches = n, (ap[shared], hp[shared], at, ht)
            else:
                high = n - 1
        if matches is None:
            return tiles
        ap, hp, at, ht = matches
        by = np.lexsort((at, ht))
        at, ht = at[by], ht[by]
        begin, end = (np.searchsorted(ht, hp, side=x) for x in ("left", "right"))
        after, nxt = 0, {}
        for i, a in enumerate(ap.tolist()):
            if a < after:
                continue
            k, last = nxt.get(int(begin[i]), int(begin[i])), int(end[i])
            while k < last and not t.free[at[k] : at[k] + low].all():
                k += 1
            nxt[int(begin[i])] = k
            if k == last:
                continue
            b = int(at[k])
            p.free[a : a + low] = t.free[b : b + low] = False
            nxt[int(begin[i])] = int(np.searchsorted(at[k:last], b + low)) + k
            tiles.append((int(p.place[a]), int(t.place[b]), low))
            after = a + low


class Index:
    """Seeds of a block of benchmark items. Items of fewer tokens than a seed have none."""

    def __init__(self, items: list[tuple], least: int):
        self.least = least
        self.ids = [i for i, _ in items]
        words, owner = tokens([plain(t) for _, t in items])
        self.words = np.split(words, np.searchsorted(owner, np.arange(1, len(items)))) if items else []
        grams = [_grams(w, least) for w in self.words]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        own = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.lexsort((own, h))
        self.grams, self.hash, self.own = grams, h[order], own[order]

    def candidates(self, words: np.ndarray, owner: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """Pairs of a document and an item whose shared seeds cover enough of the item for it to be
        in reach of ``coverage``; all such pairs, each once."""
        h = _grams(words, self.least)
        if not len(h) or not len(self.hash):
            return
        inside = owner[: len(h)] == owner[self.least - 1 :]
        low = np.searchsorted(self.hash, h)
        hit = np.flatnonzero(inside & (self.hash[np.minimum(low, len(self.hash) - 1)] == h))
        order = np.lexsort((h[hit], owner[hit]))
        hit = hit[order]
        new = np.concatenate(([True], (h[hit][1:] != h[hit][:-1]) | (owner[hit][1:] != owner[hit][:-1])))[: len(hit)]
        hit = hit[new]  # a seed counts once a document
        ends = np.flatnonzero(np.append(owner[hit][1:] != owner[hit][:-1], len(hit) > 0)) + 1
        start = 0
        for end in ends.tolist():
            mine = hit[start:end]
            start = end
            seeds = h[mine]  # sorted
            first, last = low[mine], np.searchsorted(self.hash, seeds, side="right")
            items = np.unique(np.concatenate([self.own[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]))
            for k in items.tolist():
                at = np.searchsorted(seeds, self.grams[k])
                starts = np.flatnonzero(seeds[np.minimum(at, len(seeds) - 1)] == self.grams[k])
                n = len(self.words[k])
                if _under(starts, n, self.least).sum() >= coverage * n:
                    yield int(owner[mine[0]]), k


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of about half of ``block_chars`` characters, measured first."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // max(1, block_chars // 2)))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        mine = items.where(place == block) if blocks > 1 else items
        yield [(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()]


def _matches(batch: pa.RecordBatch, index: Index, coverage: float) -> Iterator[tuple]:
    """(row of the batch, item, its tokens, covered ones, tiles) of each contaminated pair."""
    texts = [plain(t) for t in texts_of(batch)]
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _CHUNK):
            size += len(texts[last])
            last += 1
        words, owner = tokens(texts[first:last])
        for doc, k in index.candidates(words, owner, coverage):
            a, b = np.searchsorted(owner, [doc, doc + 1])
            tiles = tile(index.words[k], words[a:b], index.least)
            n = sum(t[2] for t in tiles)
            if n >= coverage * len(index.words[k]):
                yield first + doc, index.ids[k], len(index.words[k]), n, len(tiles)
        first = last


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_item_tokens, n_covered, n_tiles, coverage) of every contaminated pair.

    ``docs`` (doc_id, text) against ``benchmark`` (item_id, text): an item contaminates a document
    if tiles of at least ``least`` tokens cover ``coverage`` of its tokens, in whatever order they
    stand in the document. The benchmark's size is measured first; it goes to the workers in blocks
    of at most ``block_chars`` characters (an item is never cut), each block against all documents
    in one scan that shuffles nothing. Only pairs whose shared seeds could cover enough are tiled.

    Null and empty texts, and texts without letters or digits, match nothing. An item of fewer
    tokens than ``least`` says too little to contaminate anything and matches nothing; see
    ``short_items``. Very long texts are tiled whole. Repeated rows of either table each give their
    pairs. Null ids are kept; other columns are not read. An empty benchmark or table gives no row.
    """
    small_batches(docs.sparkSession)
    fields = [StructField("doc_id", docs.schema["doc_id"].dataType), StructField("item_id", benchmark.schema["item_id"].dataType)]
    schema = StructType(fields + StructType.fromDDL("n_item_tokens long, n_covered long, n_tiles long, coverage double").fields)
    arrow = to_arrow_schema(schema)

    def one(items: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, least)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[i], item, of, n, tiles, n / of) for i, item, of, n, tiles in _matches(batch, index, coverage)]
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in found], schema=arrow)

        return docs.select("doc_id", "text").mapInArrow(match, schema)

    return reduce(DataFrame.unionAll, (one(items) for items in _blocks(benchmark, block_chars)))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns; see ``contaminated``.
    Every block of the benchmark filters what the ones before it left; nothing is shuffled."""
    small_batches(docs.sparkSession)

    def one(rows: DataFrame, items: list[tuple]) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, least)
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[m[0] for m in _matches(batch, index, coverage)]] = False
                yield batch.filter(pa.array(stay))

        return rows.mapInArrow(keep, docs.schema)

    return reduce(one, _blocks(benchmark, block_chars), docs)


def short_items(benchmark: DataFrame, least: int = MIN_MATCH) -> DataFrame:
    """item_id, n_item_tokens of the items that are too short to be looked for: fewer tokens than a
    seed. A null text has none."""
    small_batches(benchmark.sparkSession)
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(plain(t).split()) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(n, pa.int64())], ["item_id", "n_item_tokens"])

    return benchmark.select("item_id", "text").mapInArrow(count, f"item_id {kind}, n_item_tokens long").where(F.col("n_item_tokens") < least)
