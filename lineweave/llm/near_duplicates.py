"""Near duplicates by ProbMinHash over weighted word shingles, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import Bytes, Scratch, gram_hashes, mix, small_batches, word_runs
from lineweave.llm.graph import components

#: Words of a shingle; similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bands and registers of each. A pair of probability or plain Jaccard 0.8 misses all bands with
#: probability (1 - 0.8**5)**28 = 1.5e-5, one of 0.9 with 1e-11.
BANDS, ROWS = 28, 5
#: Texts of a block where all pairs are compared; a task holds two blocks.
BLOCK = 1024
_CHUNK = 1 << 18
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) and how often each occurs, sorted by text. A text of fewer than
    n words has all its words as one shingle; a text without words has none."""
    buffer = Bytes(b"\n".join(texts))
    size = np.array([len(t) + 1 for t in texts])
    start, end = word_runs(buffer.data)
    owner = np.searchsorted(np.cumsum(size) - size, start, side="right") - 1
    words = buffer.hashes(start, end)
    h = gram_hashes(words, n)
    inside = owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, bool)
    h, doc = h[inside], owner[: len(h)][inside]
    count = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.cumsum(count) - count
        few = np.array([gram_hashes(words[first[k] : first[k] + count[k]], int(count[k]))[0] for k in short], np.uint64)
        h, doc = np.concatenate([h, few]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures of weighted sets, n_docs x m: the element that reaches each register first.

    Each element's arrivals are a Poisson process of its weight's rate, seeded by the element; an
    arrival falls on one register. The processes of all sets run side by side, an arrival of each
    element per round. An element stops as soon as its last arrival is later than the latest
    register of its set, as no later one can count.
    """
    time, owner = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    # a set of one element needs no race
    alone = np.bincount(doc, minlength=n_docs)[doc] == 1
    rows = doc[alone]
    owner.reshape(n_docs, m)[rows] = element[alone][:, None]
    d, e, w = doc[~alone], element[~alone], weight[~alone].astype(float)
    clock, step = np.zeros(len(d)), 0
    while len(d):
        step = (step + int(_GOLDEN)) % 2**64
        bits = mix(e + np.uint64(step))
        clock = clock - np.log((np.float64(1) + (bits >> np.uint64(12))) * 2.0**-52) / w
        register = d * m + ((mix(bits) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(clock < time[register])
        # the earliest arrival of a round is written last; ties go to the smaller element
        better = better[np.lexsort((e[better], clock[better]))[::-1]]
        time[register[better]] = clock[better]
        owner[register[better]] = e[better]
        latest = time.reshape(n_docs, m).max(1)
        live = clock < latest[d]
        d, e, w, clock = d[live], e[live], w[live], clock[live]
    return owner.reshape(n_docs, m)


def bands(signature: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    h = np.zeros((len(signature), n), np.uint64)
    h += np.arange(n, dtype=np.uint64)
    for r in range(rows):
        h = mix(h * _GOLDEN + signature[:, r::rows][:, :n])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of probability Jaccard of the weighted shingles (sorted hashes, counts) and plain
    Jaccard of the distinct ones. Without repeated shingles both are the same."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    union = len(ha) + len(hb) - len(both)
    plain = len(both) / union
    if wa.max() == 1 and wb.max() == 1 or not len(both):
        return plain
    x, y = wa.astype(float), wb.astype(float)
    only_a = x.sum() - x[ia].sum()
    only_b = y.sum() - y[ib].sum()
    ratio, inverse = np.unique(x[ia] / y[ib], return_inverse=True)
    total = np.array([only_a + t * only_b + np.maximum(x[ia], t * y[ib]).sum() for t in ratio])
    return max(plain, float((x[ia] / total[inverse]).sum()))


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def _in_chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of text ids whose texts are similar enough. ``texts``: (id, text)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _bytes(batch.column("ta")), _bytes(batch.column("tb"))
            keep = np.zeros(len(left), bool)
            known: dict[bytes, tuple] = {}
            for i, pair in enumerate(zip(left, right, strict=True)):
                for t in pair:
                    if t not in known:
                        if len(known) > 64:
                            known.clear()
                        known[t] = shingles([t], words)[1:]
                if all(t in known for t in pair):
                    keep[i] = similarity(known[pair[0]], known[pair[1]]) >= least
                else:
                    keep[i] = similarity(*(shingles([t], words)[1:] for t in pair)) >= least
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def joining_links(ids: np.ndarray, roots: np.ndarray, own: np.ndarray, texts: list[bytes], words: int, least: float, across: bool) -> list[tuple[int, int]]:
    """Links between texts of different roots that are enough to join all such roots.

    Texts most of whose shingles no other text here has cannot be similar enough to any, and are
    left out first. For the others, common shingles are counted through postings; pairs that could
    reach ``least`` are computed exactly. ``across``: only pairs of different ``own`` blocks.
    """
    doc, h, count = [], [], []
    for first, some in _in_chunks(texts):
        d, e, n = shingles(some, words)
        doc.append(d + first), h.append(e), count.append(n)
    doc, h, count = np.concatenate(doc), np.concatenate(h), np.concatenate(count)
    n = len(texts)
    _, term, df = np.unique(h, return_inverse=True, return_counts=True)
    size, weight = np.bincount(doc, minlength=n), np.bincount(doc, count, n)
    shared = df[term] > 1
    can = (np.bincount(doc[shared], minlength=n) >= least * size) | (np.bincount(doc[shared], count[shared], n) >= least * weight)
    can &= size > 0
    repeats = np.bincount(doc, count > 1, n) > 0
    if len(np.unique(roots[can])) < 2:
        return []
    keep = shared & can[doc]
    by_term = np.argsort(term[keep], kind="stable")
    posting, post_term = doc[keep][by_term], term[keep][by_term]
    low, high = (np.searchsorted(post_term, np.arange(len(df)), side=x) for x in ("left", "right"))
    begin = np.searchsorted(doc, np.arange(n + 1))
    parent = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    main = np.bincount(np.unique(roots[can], return_inverse=True)[1]).argmax()
    main = np.unique(roots[can])[main]
    out = []
    for u in np.flatnonzero(can & (roots != main)).tolist():  # every pair of two roots has one of these
        at = slice(begin[u], begin[u + 1])
        mine = np.flatnonzero(keep[at])
        terms = term[at][mine]
        if not len(terms):
            continue
        met = np.concatenate([posting[low[t] : high[t]] for t in terms.tolist()])
        common = np.bincount(met, minlength=n)
        hopeful = common >= least * (size[u] + size - common)
        if repeats[u] or repeats.any():
            share = np.bincount(met, np.repeat(count[at][mine], high[terms] - low[terms]), n) >= least * weight[u]
            hopeful |= share & (repeats | repeats[u])
        hopeful[u] = False
        if across:
            hopeful &= own != own[u]
        for v in np.flatnonzero(hopeful).tolist():
            ru, rv = find(int(roots[u])), find(int(roots[v]))
            if ru == rv:
                continue
            a, b = slice(begin[u], begin[u + 1]), slice(begin[v], begin[v + 1])
            if similarity((h[a], count[a]), (h[b], count[b])) >= least:
                parent[ru] = rv
                out.append((int(ids[u]), int(ids[v])))
    return out


def _block_joiner(words: int, least: float):
    """Runs joining_links on each (bucket, i, j) of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        key = None

        def finish() -> pa.RecordBatch:
            columns = list(zip(*group, strict=True))
            ids, roots, own = (np.array(c, np.int64) for c in columns[:3])
            found = joining_links(ids, roots, own, list(columns[3]), words, least, key[1] != key[2])
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j")), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "root", "own")), _bytes(batch.column("text")), strict=True)
            for k, row in zip(keys, rows, strict=True):
                if k != key and group:
                    yield finish()
                    group.clear()
                key = k
                group.append(row)
        if group:
            yield finish()

    return run


def text_name(text: str = "text") -> Column:
    """128 bits that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, Scratch]:
    """(doc_id, class_id, name, first) of each row of ``docs`` (doc_id, text), and the scratch it reads.

    A class is a connected component of texts linked by a similarity of ``least`` or more;
    ``class_id`` is its least doc_id. Equal texts are one node of the graph from the start: each
    distinct text (told apart by 128 bits, ``name``) gets a number of its own, and only one of its
    copies is signed and compared. ``first`` marks the row that stands for its class, the one with the
    least doc_id (of several, the least ``name``; rows equal in both are all marked).

    Candidates share a band of the signatures of counted shingles, which follow probability Jaccard,
    or of distinct ones, which follow plain Jaccard; a text without repeated shingles has one
    signature for both. First each member of a bucket of any size meets two others, those first
    and last by a hash, which are mostly the same ones in all buckets of a group of copies. The links
    found join texts into components. Then, in each bucket whose texts are still of several
    components, all pairs of different components are compared exactly, in blocks of ``BLOCK``
    texts; buckets of the same texts count once. A task gets two blocks of one bucket, counts common
    shingles by postings and returns only links that join components, fewer than it has texts. So
    no pair that shares a band goes unseen, and pairs are never rows.

    A null text counts as empty; empty texts are equal. A text of fewer words than a shingle is
    one shingle. Very long texts are compared whole. Rows with a null doc_id take part, and a class
    of such rows alone has a null class_id. Rows that share a doc_id each get the class of their own
    text. An empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near")
    kind = docs.schema["doc_id"].dataType
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("name", text_name())
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id")).alias("owner")
    texts = named.groupBy("name").agg(F.first("text").alias("text"), owner)
    texts = scratch.table(texts.withColumn("id", F.monotonically_increasing_id()), "texts")  # written, so the numbers stay

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, some_texts = batch.column("id").to_numpy(), _bytes(batch.column("text"))
            for first, some in _in_chunks(some_texts):
                doc, h, n = shingles(some, words)
                present = np.unique(doc)
                if not len(present):
                    continue
                number = np.searchsorted(present, doc)
                bucket = bands(prob_min_hash(number, h, n, len(present), n_bands * rows), n_bands, rows).ravel()
                own = np.repeat(first + present, n_bands)
                # texts with repeated shingles also get the signature of their distinct ones
                twice = np.unique(number[n > 1])
                if len(twice):
                    again = np.isin(number, twice)
                    plain = prob_min_hash(np.searchsorted(twice, number[again]), h[again], np.ones(int(again.sum()), np.int64), len(twice), n_bands * rows)
                    bucket = np.concatenate([bucket, bands(plain, n_bands, rows).ravel()])
                    own = np.concatenate([own, np.repeat(first + present[twice], n_bands)])
                    order = np.lexsort((bucket, own))
                    bucket, own = bucket[order], own[order]
                    new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])))
                    bucket, own = bucket[new], own[new]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(ids[own])], ["bucket", "id"])

    # written, as it is read twice and both sides of the join must be exchanges that Spark can split
    members = scratch.table(texts.select("id", "text").mapInArrow(sign, "bucket long, id long"), "members")
    place = F.xxhash64("id", F.lit(11))
    sized = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(place, "id")).alias("first"), F.max(F.struct(place, "id")).alias("last"))
    sized = sized.where("n > 1").select("bucket", "n", F.col("first.id").alias("first"), F.col("last.id").alias("last"))
    # only buckets with company are kept
    shared = scratch.table(members.join(sized, "bucket"), "shared")
    scratch.forget("members")
    ordered = lambda x, y: F.array_sort(F.array(x, y))
    pairs = shared.select(F.explode(F.array(ordered(F.col("id"), F.col("first")), ordered(F.col("id"), F.col("last")))).alias("p"))
    pairs = pairs.select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).where("a <> b").distinct()
    wanted = scratch.table(shared.select("id").distinct(), "wanted")
    company = scratch.table(texts.select("id", "text").join(wanted, "id"), "company")
    links = scratch.table(_verified(pairs, company, words, least), "links")
    roots = components(links, scratch)

    # buckets that the first pass did not settle: in one of three texts or fewer all pairs have met
    root = F.coalesce("root", "id").alias("root")
    tagged = shared.where("n > 3").select("bucket", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("bucket", "id", root)
    tagged = scratch.table(tagged, "tagged")
    prints = [F.expr(f"bit_xor(xxhash64(id, {k}))").alias(f"x{k}") for k in (1, 2)]
    unsettled = tagged.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *prints).where("low <> high")
    unsettled = unsettled.groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    work = tagged.join(scratch.table(unsettled, "unsettled"), "bucket")
    work = work.withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root")
    work = scratch.table(work, "work").join(company, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
    more = scratch.table(work.mapInArrow(_block_joiner(words, least), "a long, b long"), "more")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), scratch)

    # classes of texts first; only the last join has a row per document
    rooted = texts.select("id", "name", "owner").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("name", "owner", root)
    rooted = scratch.table(rooted, "rooted")
    heads = scratch.table(rooted.groupBy("root").agg(F.min(F.struct("owner", "name")).alias("head")), "heads")
    classes = scratch.table(rooted.join(heads, "root").select("name", "head"), "classes")
    mine = (F.col("name") == F.col("head.name")) & F.col("doc_id").eqNullSafe(F.col("head.owner.doc_id"))
    result = named.select("doc_id", "name").join(classes, "name")
    return result.select("doc_id", F.col("head.owner.doc_id").cast(kind).alias("class_id"), "name", mine.alias("first")), scratch
