import hashlib
import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lineweave.llm.common import Scratch, read_table
from lineweave.llm.decontaminate import clean, contaminated, plain, short_items, tile
from lineweave.llm.graph import components
from lineweave.llm.near_duplicates import bands, near_duplicates, prob_min_hash, shingles, similarity
from lineweave.llm.repeats import Level, _pieces, anchors, cut_repeats, enter, merge_depth, remove_repeats, removed_runs, text_key
from tests.conftest import SF
from tests.llm.conftest import edge_rows, prose


def brute_shingles(text, n=5):
    w = (text or "").split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def brute_similarity(a, b):
    """The larger of plain and probability Jaccard, from their definitions."""
    union = set(a) | set(b)
    if not a or not b:
        return 0.0
    plain = len(set(a) & set(b)) / len(union)
    if max(a.values()) == max(b.values()) == 1:  # then both are the same
        return plain
    prob = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in union) for d in set(a) & set(b))
    return max(plain, prob)


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [brute_shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or brute_similarity(s[i], s[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return [(d, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def test_prob_min_hash_estimates_probability_jaccard():
    rng = random.Random(0)
    pairs = []
    for _ in range(40):
        a = {rng.randrange(2**63): rng.randint(1, 3) for _ in range(rng.randint(1, 60))}
        b = {e: (w if rng.random() < 0.9 else w + 1) for e, w in a.items() if rng.random() < 0.8} | {rng.randrange(2**63): 1 for _ in range(rng.randint(0, 9))}
        pairs.append((Counter(a), Counter(b or {1: 1})))
    sets = [s for p in pairs for s in p]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    e = np.array([x for s in sets for x in s], np.uint64)
    w = np.array([x for s in sets for x in s.values()])
    sig = prob_min_hash(doc, e, w, len(sets), 1000)
    for k, (a, b) in enumerate(pairs):
        union = set(a) | set(b)
        want = sum(1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in union) for d in set(a) & set(b))
        assert abs((sig[2 * k] == sig[2 * k + 1]).mean() - want) < 0.07
    assert bands(sig[:2, :140]).shape == (2, 28)


def test_similarity_and_shingles():
    texts = ["a b c d e f", "a b c d e f g", "x y", "", "a b c d e a b c d e a b c d e f", "a b c d e a b c d e f"]
    doc, h, n = shingles([t.encode() for t in texts])
    part = [(h[doc == k], n[doc == k]) for k in range(len(texts))]
    for i, a in enumerate(texts):
        assert len(part[i][0]) == len(brute_shingles(a))
        for j, b in enumerate(texts):
            assert similarity(part[i], part[j]) == pytest.approx(brute_similarity(brute_shingles(a), brute_shingles(b)))


def family(seed, n):
    """Copies of one text with 0 to 8 changed words each, some at the same places."""
    rng = random.Random(seed)
    base = prose(seed, 150).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.choice([rng.randrange(150), rng.randrange(20)])] = f"w{rng.randrange(10**6)}"
        rows.append((seed * 1000 + i, " ".join(w)))
    return rows


def test_near_duplicates_against_all_pairs(spark, empty):
    rows = family(1, 70) + family(2, 30) + [(r[0], r[1]) for r in edge_rows()] + [(9000 + i, prose(100 + i, 80)) for i in range(20)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))[0].select("doc_id", "class_id").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_classes(rows)))
    assert near_duplicates(empty)[0].count() == 0


def test_near_copies_that_repeat_a_line(spark):
    """Plain Jaccard is 0.95 or more, probability Jaccard low: the bands of distinct shingles find them."""
    rows = []
    for k in range(12):
        w = prose(600 + k, 300).split()
        line = " ".join(w[140:152])
        text = " ".join(w[:152]) + f" {line}" * 40 + " " + " ".join(w[152:])
        rows += [(10 * k, " ".join(w)), (10 * k + 1, text), (10 * k + 2, text.replace(f" {line}" * 40, f" {line}" * 300))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))[0].select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes(rows)) == [(10 * k + i, 10 * k) for k in range(12) for i in range(3)]


def test_blocks_find_every_joining_link(spark, monkeypatch):
    from lineweave.llm import near_duplicates as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rows = family(3, 60)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))[0].select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes(rows))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(1, 1)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert sorted(map(tuple, found.collect())) == sorted((x, find(x)) for x in parent if find(x) != x)


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_repeats_against_brute_force(spark, edge, empty):
    rng = random.Random(4)
    passages = [prose(50 + i, rng.randint(20, 90)) for i in range(12)] + ["ab" * 150, "x" * 500]
    texts = [" ".join([prose(200 + i, rng.randint(0, 60)), *rng.choices(passages, k=rng.randint(0, 3)), prose(300 + i, rng.randint(0, 60))]) for i in range(120)]
    texts += [r[1] for r in edge_rows() if r[0] != 5] + [prose(9, 100) + "é" + prose(8, 100), prose(9, 100) + "è" + prose(8, 100)]
    rows = [(i % 100, t) for i, t in enumerate(texts)]
    want = [(rows[i][0], *x[:4]) for i, x in enumerate(brute_repeats(texts, 200))]
    for index in ({}, {"hot": 2, "batches": 7, "unit_bytes": 20_000}):  # blocks as they are, or cut into pieces
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **index).collect()
        assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    want = [(rows[i][0], *x[:4]) for i, x in enumerate(brute_repeats(texts, 420))]  # windows beyond 256 a block
    assert sorted(map(repr, (tuple(r)[:5] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=420).collect()))) == sorted(map(repr, want))
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)
    assert remove_repeats(empty).count() == 0
    assert remove_repeats(edge).count() == len(edge_rows())


def test_repeats_on_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = [(d, *x[:4]) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows], 200), strict=True)]
    got = [tuple(r)[:5] for r in remove_repeats(read_table(spark, SF, "documents")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_repeats_around_a_common_line(spark):
    """A line of 150 bytes in ever different surroundings, some of which agree by a few bytes: no
    task gets all its blocks, and none is taken for another."""
    rng = random.Random(8)
    line = prose(31, 60)[:150]
    sides = [prose(500 + i, 40)[:90] for i in range(12)]
    texts = ["".join([prose(900 + i, 30)[: rng.randint(0, 90)], rng.choice(sides)[rng.randint(0, 90) :], line, rng.choice(sides)[: rng.randint(0, 90)], prose(5000 + i, 30)]) for i in range(400)]
    rows = list(enumerate(texts))
    want = [(i, *x[:4]) for i, x in enumerate(brute_repeats(texts, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (10**9, 20):
        assert sorted(tuple(r)[:5] for r in remove_repeats(docs, hot=hot).collect()) == want
    assert sum(r[2] for r in want) > 10_000


def test_copies_of_one_text_enter_once_a_batch(spark, monkeypatch):
    """Many copies, also rows alike in all columns: the index gets each block once for each group of
    rows that a task has at hand."""
    text = prose(77, 200)
    docs = spark.range(4000).select((F.col("id") % 1000 * (F.col("id") % 2)).alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    got = remove_repeats(docs).select("n_removed").distinct().collect()
    assert [r["n_removed"] for r in got] == [len(text)]
    key = docs.withColumn("key", text_key("doc_id", "text")).select("key", "text")
    monkeypatch.setattr(Scratch, "drop", lambda *_: None)  # strings go when the levels have them
    runs, scratch = removed_runs(key)
    work = spark.read.parquet(f"{scratch.root}/{[p for p in os.listdir(scratch.root.removeprefix('file://')) if p.endswith('work')][0]}")
    blocks = len(anchors([text.encode()]).doc)
    strings = work.where("part >= 0").groupBy("h1", "h2").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    assert len(strings) == blocks and all(r["n"] == 4000 for r in strings)
    assert max(r["rows"] for r in strings) <= 4 * 4 * 2  # tasks, batches, groups of 1,000 rows


def test_pieces_share_units():
    """Equal windows of hot anchors get the same number, whatever stands around them."""
    line = prose(31, 60)[:150].encode()
    texts = [prose(100 + i, 40).encode()[:140] + line + prose(200 + i % 3, 40).encode()[:140] for i in range(9)]
    b = anchors(texts)
    block, start, end, seed = _pieces(b, np.arange(len(b.doc)), np.ones(len(b.doc), bool), 200, 8)
    data, where, seen = b.buffer.data.tobytes(), defaultdict(set), Counter()
    for x, y, unit, d in zip(start.tolist(), end.tolist(), seed.tolist(), b.doc[block].tolist(), strict=True):
        assert b.begin[d] <= x and y - x - 200 < 8 and y <= b.begin[d] + len(texts[d])
        for i in range(x, y - 199):
            where[data[i : i + 200]].add(unit)
            seen[d] += 1
    assert all(len(units) == 1 for units in where.values())
    assert [seen[d] for d in range(9)] == [len(t) - 199 for t in texts]  # every window is in one piece


@pytest.mark.parametrize("length", [10, 24])
def test_family_of_levels(length):
    """Batches enter one by one; what the scans find is what counting finds, levels grow
    geometrically, and each is a suffix array."""
    rng = random.Random(length)
    blocks = ["".join(rng.choices("ab\0", k=rng.randint(length, 60))).encode() for _ in range(200)]
    count = Counter(b[i : i + length] for b in blocks for i in range(len(b) - length + 1))
    for batch in (5, 40, 200):
        levels, flags = {}, [np.zeros(len(b) - length + 1, bool) for b in blocks]
        for step, i in enumerate(range(0, 200, batch)):
            some = blocks[i : i + batch]
            names = np.stack([np.arange(i, i + len(some)), np.zeros(len(some), int)], 1)
            fresh, places = Level.build(np.frombuffer(b"".join(some), np.uint8), np.array([len(b) for b in some]), names, length)
            owner, first, last = fresh.runs(places, length)
            carry, found = enter(fresh, levels, merge_depth(step), length)
            for name, a, e in [(names[owner], first, last), *found]:
                for k, x, y in zip(name[:, 0].tolist(), a.tolist(), e.tolist(), strict=True):
                    flags[k][x : y - length + 1] = True
            for number in range(merge_depth(step)):
                del levels[number]
            levels[merge_depth(step)] = Level.from_bytes(carry.to_bytes())
            assert sorted(levels) == [k for k in range(9) if (step + 1) >> k & 1]
            for level in levels.values():
                text = level.text.tobytes()
                windows = [text[p : p + length] for p in level.order.tolist()]
                assert windows == sorted(set(windows))
        for b, f in zip(blocks, flags, strict=True):
            assert f.tolist() == [count[b[i : i + length]] > 1 for i in range(len(b) - length + 1)]


def test_cut_repeats_keeps_rows_and_columns(spark, edge):
    cut = cut_repeats(edge)
    assert cut.columns == edge.columns and cut.count() == edge.count()
    kept = {hashlib.sha256(x[4]).hexdigest() for x in brute_repeats([r[1] for r in edge_rows()], 200)}
    for r in cut.collect():
        assert r["text"] is None or hashlib.sha256(r["text"].encode()).hexdigest() in kept


def naive_tiles(p, t, least):
    """Greedy string tiling from its definition: all maximal matches, longest first, pattern's start first."""
    mp, mt, tiles = [False] * len(p), [False] * len(t), []
    while True:
        best, found = least - 1, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = mt[j : j + best] = [True] * best
                tiles.append((i, j, best))


def test_tile():
    v = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert tile(v("abcdefghij"), v("xxfghijyyabcdezz"), 5) == [(0, 9, 5), (5, 2, 5)]
    assert tile(v("abcdefghij"), v("abcdefgh"), 5) == [(0, 0, 8)]
    assert tile(v("abcd"), v("abcd"), 5) == [] and tile(v("aaaaaaaa"), v("aaaaaaaaaaaaaaaaaaaa"), 5) == [(0, 0, 8)]
    rng = random.Random(12)
    for i in range(300):
        letters = "ab" if i % 3 == 0 else "abcdefgh"
        text = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        cut = [text[k : k + rng.randint(3, 20)] for k in (rng.randint(0, max(0, len(text))) for _ in range(3))]
        pattern = "".join([*cut, *rng.choices(letters, k=rng.randint(0, 8))])
        least = rng.choice([2, 3, 5])
        assert tile(v(pattern), v(text), least) == naive_tiles(pattern, text, least), (pattern, text, least)


def test_tile_of_texts_that_repeat_themselves():
    """A million tokens of one kind against thousands: a round is linear in both."""
    began = time.process_time()
    same = lambda n: np.full(n, 7, np.uint64)
    assert tile(same(8000), same(1_000_000), 5) == [(0, 0, 8000)]
    pattern = np.tile(np.arange(40, dtype=np.uint64), 100)
    assert sum(t[2] for t in tile(pattern, np.tile(np.arange(39, dtype=np.uint64), 20_000), 5)) == 100 * 39
    assert time.process_time() - began < 20


def test_decontamination_against_naive_tiling(spark):
    rng = random.Random(13)
    items = [(i, prose(800 + i, rng.randint(1, 25))) for i in range(12)] + [(12, prose(800, 25) + " " + prose(801, 3))]
    docs = []
    for i in range(40):
        parts = [prose(900 + i, rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            k = rng.randint(0, len(w))
            parts += [" ".join(w[k:]).upper() + "!", prose(950 + i, rng.randint(0, 4)), " ".join(w[:k])]
        docs.append((i, " ".join(parts)))
    want = set()
    for d, text in docs:
        for k, item in items:
            p, t = plain(item).split(), plain(text).split()
            covered = sum(x[2] for x in naive_tiles(p, t, 5))
            if len(p) >= 5 and covered >= 0.6 * len(p):
                want.add((d, k, len(p), covered))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_item_tokens"], r["n_covered"]) for r in got.collect()} == want and len(want) > 15
    short = short_items(spark.createDataFrame([*items, (13, None)], "item_id long, text string")).collect()
    assert {r["item_id"] for r in short} == {13} | {k for k, t in items if len(t.split()) < 5}


def test_decontamination(spark, edge, empty):
    items = [(i, prose(700 + i, 30)) for i in range(20)] + [(20, "only three words"), (21, None), (22, "")]
    w = items[0][1].split()
    docs = [
        (1, f"{prose(1, 50)} {items[0][1]} {prose(2, 50)}"), (2, f"{' '.join(w[15:])} {prose(3, 30)}! {' '.join(w[:15]).upper()}"), (3, " ".join(w[:14])),
        (4, prose(4, 400)), (5, "it has ONLY, three words"), (6, "only two three words"), (7, f"{items[1][1]} {items[2][1]}"), (8, None),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 0), (2, 0), (7, 1), (7, 2)}  # an item of three words is too short to look for
    for chars in (8 << 20, 400):  # one block, and many
        assert {(r["doc_id"], r["item_id"]) for r in contaminated(table, bench, block_chars=chars).collect()} == want
        assert {r["doc_id"] for r in clean(table, bench, block_chars=chars).collect()} == {3, 4, 5, 6, 8}
    assert contaminated(empty, bench).count() == contaminated(table, bench.limit(0)).count() == 0
    assert clean(edge, bench).columns == edge.columns and clean(edge, bench).count() == edge.count()
    real = read_table(spark, SF, "benchmark")
    planted = [(r["item_id"], f"{prose(r['item_id'], 20)}\n{r['text']}\n{prose(5, 20)}") for r in real.collect()]
    found = contaminated(spark.createDataFrame(planted, "doc_id long, text string"), real).collect()
    assert {(i, i) for i, _ in planted} <= {(r["doc_id"], r["item_id"]) for r in found}


def test_pipeline_on_edge_rows(spark, edge, empty):
    twins = spark.createDataFrame([(9, prose(4, 40), "de", "b", 1), (9, prose(5, 50), "de", "b", 1), (9, prose(5, 50), "de", "b", 1)], edge.select(*corpus_pipeline.COLUMNS).schema)
    assert corpus_pipeline.STAGES[1][1](spark, twins, SF).count() == 2
    for docs, least in ((edge, 1), (empty, 0)):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            rows = spark.createDataFrame(rows.collect(), rows.schema)  # as the written and reread table
            if name != "packing":
                assert rows.columns == corpus_pipeline.COLUMNS
        assert rows.count() >= least


def test_recall_of_links(spark):
    """Pairs of texts just above 0.8, by counted and by distinct shingles: bands miss almost none."""
    rng = random.Random(21)
    rows, pairs = [], 0
    for k in range(300):
        w = [f"{k}w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
        other = list(w)
        if k % 2:  # one stretch replaced
            n = int(len(w) * 0.07)
            at = rng.randrange(5, len(w) - n - 5)
            other[at : at + n] = [f"x{rng.randrange(10**6)}" for _ in range(n)]
        else:  # a stretch repeated often beside a small change
            at = rng.randrange(5, len(w) - 20)
            other = w[:at] + w[at : at + 8] * rng.randint(10, 40) + w[at:]
        a, b = " ".join(w), " ".join(other)
        if brute_similarity(brute_shingles(a), brute_shingles(b)) >= 0.8:
            pairs += 1
            rows += [(2 * k, a), (2 * k + 1, b)]
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))[0].select("doc_id", "class_id").collect())
    assert pairs > 200 and sum(got[d] == d & ~1 for d, _ in rows) >= 0.99 * 2 * pairs


def test_copies_are_signed_once(spark):
    rows = [(i, prose(40, 100)) for i in range(500)] + [(1000 + i, prose(41, 100)) for i in range(3)]
    found, scratch = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert dict(found.select("doc_id", "class_id").collect()) == {d: 0 if d < 1000 else 1000 for d, _ in rows}
    assert spark.read.parquet(scratch._tables["texts"]).count() == 2
    assert found.where("first").count() == 2


def brute_quality(docs, trusted):
    """Which documents the rules and the mean log ratio keep, in exact arithmetic over hashed n-grams."""
    from lineweave.llm.quality import BUCKETS, THRESHOLD, Chunk, buckets
    from tests.llm.test_text import rules

    raw, target, grams = Counter(), Counter(), {}
    for d, text in docs.items():
        grams[d] = buckets(Chunk([(text or "").encode()]))[0].tolist()
        raw.update(grams[d])
        if d in trusted:
            target.update(grams[d])
    n, m = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    score = lambda b: np.log((target[b] + 1) / m) - np.log((raw[b] + 1) / n)
    return {d for d, t in docs.items() if not rules(t)[5] and sum(map(score, grams[d])) / max(1, len(grams[d])) >= THRESHOLD}


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before it kept."""
    docs = read_table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    documents, quality, near, cut, safe = seen
    trusted = {r["doc_id"] for r in read_table(spark, SF, "labels").where("quality = 1").collect()}
    assert set(quality) == brute_quality(documents, trusted) and len(quality) < len(documents)
    classes = dict(brute_classes(sorted(quality.items())))
    assert set(near) == {d for d, c in classes.items() if d == c} and len(near) < len(quality)
    ids = sorted(near)
    want = {d: x[4].decode("utf-8", "ignore") for d, x in zip(ids, brute_repeats([near[d] for d in ids], 200), strict=True)}
    assert cut == want and cut != near
    bench = [(r["item_id"], plain(r["text"]).split()) for r in read_table(spark, SF, "benchmark").collect()]
    bad = set()
    for d, text in cut.items():
        words = plain(text).split()
        have = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for _, p in bench:
            if any(tuple(p[i : i + 5]) in have for i in range(len(p) - 4)) and sum(x[2] for x in naive_tiles(p, words, 5)) >= 0.6 * len(p):
                bad.add(d)
                break
    assert set(safe) == set(cut) - bad and all(safe[d] == cut[d] for d in safe)
    pieces = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(safe)
    starts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert starts <= 2048
