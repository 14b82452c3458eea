import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lineweave.llm import packing, simple8b, token_store
from lineweave.llm.bpe import Counter, Encoder, prove_whole_tokens, tokenizer_json
from lineweave.llm.common import read_table
from lineweave.llm.packing import pack, plan
from lineweave.llm.token_counts import token_counts
from lineweave.llm.token_store import pack_segment, token_store_digest, unpack_segments
from tests.conftest import SF
from tests.llm.conftest import edge_rows

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", "a  b", "\n\n a\n", "it's we'll IT'S", "<|endoftext|> x<|endoftext|>y <|startoftext|>z", "a\xa0 b\x0b c", "É é", "日本語 テスト 123 4.5",
    "Straße ÀÉ İstanbul ΣΑΣ", "a\tb \t\r\n c  ", "😀 hi!!! ***x", "\x1c a\x1cb", "don't!", "x' s", "a　b", " lead", "trail ", "\n", None, "s",
]


def library(name):
    tok = Tokenizer.from_str(tokenizer_json(name))
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_encoder_is_the_library(name):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices(list(" \n\t'sabÉ1.!\xa0éß<|>中\x0b\x1c"), k=rng.randint(0, 14))) for _ in range(5000)] + [r[1] for r in edge_rows()]
    want = list(map(library(name), texts))
    spec = tokenizer_json(name)
    for memo in (100_000, 50):  # a small memo forgets all the time
        ids, length = Encoder(spec, memo).column(pa.array(["x", *texts])[1:])
        assert length.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
    counter = Counter(spec, prove_whole_tokens(spec))
    assert counter.column(pa.array(texts)).tolist() == [len(w) for w in want]
    assert [len(x) for x in Encoder(spec).column(pa.array([], pa.string()))] == [0, 0]


def test_proven_tokens_encode_alone():
    encode = library(NAMES[0])
    proven = prove_whole_tokens(tokenizer_json(NAMES[0]))
    assert len(proven) > 30_000 and all(len(encode(t)) == 1 for t in random.Random(0).sample(sorted(proven), 500))


def test_counts(spark, edge, empty):
    encode = library(NAMES[0])
    got = token_counts(edge, NAMES[0], max_tokens=100).collect()
    want = [(r[0], len((r[1] or "").encode()), len(encode(r[1])), len(encode(r[1])) > 100) for r in edge_rows()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts(empty, NAMES[0]).count() == 0


@pytest.mark.parametrize("high", [1, 2, 50_000, 2**33, 2**60, 2**64])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_simple8b_round_trip(high, n):
    v = np.array([random.Random(i).randrange(high) for i in range(n)], np.uint64)
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, n) == v).all()
    for b in range(len(offsets)):  # any block by itself
        end = offsets[b + 1] if b + 1 < len(offsets) else len(words)
        part = v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
        assert (simple8b.decode(words[offsets[b] : end], len(part)) == part).all()


def test_segments_and_damage():
    ids = [np.arange(i, dtype="<u4").tobytes() for i in (1, 0, 700)]
    raw = pack_segment([5, None, 7], ids)
    ((doc_ids, null, lengths, values),) = unpack_segments(raw + b"\n")
    assert lengths.tolist() == [1, 0, 700] and doc_ids.tolist() == [5, 0, 7] and null.tolist() == [False, True, False] and values[1:].tolist() == list(range(700))
    with pytest.raises(ValueError):
        list(unpack_segments(raw[:-3] + b"abc\n"))


def test_token_store(spark, edge, empty):
    encode = library(NAMES[0])
    got = sorted(map(tuple, token_store_digest(edge, NAMES[0], 2).collect()), key=lambda r: r[1])
    want = [[*encode(r[1]), 2] for r in edge_rows()]
    assert sum(r[2] for r in got) == sum(map(len, want))
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got])[:-1])  # starts are gapless
    assert [r[0] is not None for r in got] == sorted(r[0] is not None for r in got)
    known = [r[0] for r in got if r[0] is not None]
    assert known == sorted(known)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((repr(r[0]), r[2], r[3]) for r in got) == sorted((repr(e[0]), len(w), crc(w)) for e, w in zip(edge_rows(), want, strict=True))
    assert token_store_digest(empty, NAMES[0]).count() == 0


def test_plan_uses_the_histogram_exactly():
    rng = np.random.default_rng(0)
    for window, n in ((64, 5), (64, 4000), (2048, 3000)):
        h = np.bincount(rng.integers(1, window, n), minlength=window + 1)
        used = np.zeros_like(h)
        for lengths, m in plan(h, window):
            assert sum(lengths) <= window and m > 0
            for k in lengths:
                used[k] += m
        assert (used == h).all()
    assert plan(np.zeros(65, np.int64), 64) == []


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(spark, edge, empty, window):
    encode = library(NAMES[1])
    for docs in (edge, read_table(spark, SF, "documents")):
        pieces = [tuple(r) for r in pack(docs, NAMES[1], 1, window).collect()]
        want = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            ids = [*encode(r["text"]), 1]
            for s in range(0, len(ids), window):
                part = ids[s : s + window]
                want[r["doc_id"]].append((s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
        got, sequences = defaultdict(list), defaultdict(list)
        for doc_id, start, length, crc, total, sequence, offset in pieces:
            got[doc_id].append((start, length, crc, total))
            sequences[sequence].append((offset, length))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= window
        if docs is not edge:
            assert sum(p[2] for p in pieces) / (len(sequences) * window) > 0.97
    assert pack(empty, NAMES[1], 1).count() == 0


def alike(spark, n=100_000):
    """Rows alike in all columns, ids and texts null."""
    return spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")).repartition(4)


def test_store_of_rows_that_are_alike(spark, tmp_path, monkeypatch):
    """They spread over files, and no file has more than its segments; the lowest id is no null."""
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 1000)
    docs = alike(spark).unionAll(spark.createDataFrame([(-(2**63), "x")], "doc_id long, text string"))
    path = (tmp_path / "store").as_uri()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_tokens(docs, path, NAMES[0], 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = token_store.read_tokens(spark, path).groupBy("file").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in files) == 100_001
    assert len({re.search(r"part-(\d+)", r["file"])[1] for r in files}) >= 3 and max(r["n"] for r in files) <= 64 * 1000
    got = token_store_digest(docs, NAMES[0], 2)
    assert sorted(r["start"] for r in got.where("doc_id IS NULL").collect()) == list(range(100_000))
    assert got.where(F.col("doc_id") == -(2**63)).count() == 1


def test_packing_rows_that_are_alike(spark):
    """Groups in which ranks are counted stay small."""
    pieces = pack(alike(spark), NAMES[1], 1, 64)
    n = pieces.agg(F.count("*"), F.count_distinct("sequence_id", "offset"), F.max("offset")).first()
    assert tuple(n) == (100_000, 100_000, 63)
    salted = spark.range(100_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(max(16, 100_000 // packing.RANKED_ROWS)))).count()
    assert salted.agg(F.max("count")).first()[0] < 2 * packing.RANKED_ROWS


def test_nnls_meets_the_conditions_of_an_optimum():
    """At the least distance no count can be raised, or lowered above 0, with profit."""
    rng = np.random.default_rng(3)
    columns = packing.combinations(24)
    target = np.bincount(rng.integers(1, 24, 500), minlength=25).astype(float)
    target[0] = target[24] = 0
    columns = [c for c in columns if all(target[k] > 0 for k in c)]
    x = packing.nnls(columns, target, rounds=20_000)
    matrix = np.zeros((25, len(columns)))
    for j, c in enumerate(columns):
        for k in c:
            matrix[k, j] += 1
    slope = matrix.T @ (matrix @ x - target)
    assert (x >= 0).all() and slope.min() > -1e-2 and np.abs(slope[x > 1e-6]).max() < 1e-2
