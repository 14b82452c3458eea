"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import Bytes, small_batches, texts_of
from lineweave.llm.sampling import bounded_ids

#: Hashed n-gram space. What a task counts or the driver receives is bounded by it.
BUCKETS = 1 << 20
#: N-gram lengths in characters (code points).
LENGTHS = (3, 4, 5)
#: Most labelled documents the classifier is fitted on.
TRAIN_DOCS = 12_000
#: What makes an n-gram a feature: the fewest documents it was seen in, and how many standard errors
#: its log-count ratio lies from 0. All such n-grams are features.
MIN_DOCS, MIN_Z = 3, 2.6
_CHUNK = 1 << 16
NOT_LETTERS = regex.compile(r"[^\p{L}]+")


@dataclass
class Toxicity:
    """ratio: the log-count ratio of a feature, weight: the linear weight of the scaled feature."""

    effect: np.ndarray  # ratio * weight by bucket, float32; 0 where there is no feature
    bias: float
    base: float  # the score of a text without any n-gram


def plain(text: str) -> np.ndarray:
    """Code points in lower case, with one blank for each run of other characters than letters."""
    return np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), "<u4")


def features(texts: list[str], known: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Distinct (text, bucket) pairs of the texts' n-grams, for runs of texts of about _CHUNK characters:
    first text, last + 1, text, bucket. ``known``: flags of the buckets that matter."""
    first, size, some = 0, 0, []
    for i in range(len(texts) + 1):
        if some and (i == len(texts) or size >= _CHUNK):
            data = Bytes(np.concatenate(some))
            length = np.array([len(t) for t in some])
            doc = np.repeat(np.arange(len(some)), length)
            keys = []
            for n in LENGTHS:
                at = np.arange(max(0, data.n - n + 1))
                at = at[doc[at] == doc[at + n - 1]]
                bucket = (data.hashes(at, at + n) >> np.uint64(44)).astype(np.int64)
                d = doc[at]
                if known is not None:
                    keep = known[bucket]
                    bucket, d = bucket[keep], d[keep]
                keys.append(d * BUCKETS + bucket)
            key = np.unique(np.concatenate(keys))
            yield first, i, key // BUCKETS, key % BUCKETS
            first, size, some = i, 0, []
        if i < len(texts):
            some.append(plain(texts[i]))
            size += len(some[-1])


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Toxicity:
    """Fits on at most ``train_docs`` rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic)
    covers, chosen by a hash of their ids. Rows with a null label or a null doc_id teach nothing; of
    several labels of one id the largest counts, and each row of that id is learned from. Without rows
    of both classes every score is the share of toxic rows; without any, 0. Very long texts teach
    whole. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    ids = bounded_ids(known, train_docs)
    marks = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int32)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy().astype(np.int64)
            rows += np.bincount(toxic, minlength=2)
            for first, _, doc, bucket in features(texts_of(batch)):
                mark = toxic[first + doc]
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[mark == k], minlength=BUCKETS).astype(np.int32)
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(seen[0, some], rows[0])), pa.array(np.append(seen[1, some], rows[1]))], ["bucket", "clean", "toxic"]
        )

    sums = sample.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = sums.where((F.col("bucket") < 0) | (F.col("clean") + F.col("toxic") >= MIN_DOCS)).toArrow()
    place, clean, toxic = (sums.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    n0, n1 = (int(x[place < 0].sum()) for x in (clean, toxic))
    base = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return Toxicity(np.zeros(BUCKETS, np.float32), float(np.log((base + 1e-6) / (1 - base + 1e-6))), base)
    place, clean, toxic = (x[place >= 0] for x in (place, clean, toxic))
    c0, c1 = clean + 0.5, toxic + 0.5
    ratio = np.log(c1 / (n1 + 1)) - np.log(c0 / (n0 + 1))
    z = np.abs(ratio) / np.sqrt(1 / c0 + 1 / c1)
    chosen = np.flatnonzero(z >= MIN_Z)
    scale = np.zeros(BUCKETS, np.float32)
    scale[place[chosen]] = ratio[chosen]
    is_feature = scale != 0

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = texts_of(batch), []
            for first, last, doc, bucket in features(texts, is_feature):
                out += [x.tobytes() for x in np.split(number[bucket], np.searchsorted(doc, np.arange(1, last - first)))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.binary())], ["toxic", "found"])

    number = (np.cumsum(is_feature) - 1).astype(np.int32)
    got = sample.mapInArrow(extract, "toxic int, found binary").toArrow()  # at most train_docs rows of numbers of features
    rows = sorted(zip(got.column("toxic").to_pylist(), got.column("found").to_pylist(), strict=True))  # the same order on every run
    del got
    size, marks = np.array([len(f) // 4 for _, f in rows]), np.array([t for t, _ in rows], float)
    col = np.frombuffer(b"".join(f for _, f in rows), np.int32)
    del rows
    value = scale[is_feature].astype(float)
    weight, bias = logistic(size, col, value, marks)
    effect = np.zeros(BUCKETS, np.float32)
    effect[is_feature] = value * weight
    return Toxicity(effect, bias, base)


def logistic(size: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float = 1e-5, rounds: int = 150, flat: float = 1e-6) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient steps, ``rounds`` at most, fewer once no
    partial derivative is above ``flat``. Row i has the next ``size[i]`` features of ``col``; feature j
    has the value ``scale[j]`` wherever it is."""
    m, n = len(y), len(scale)
    by = np.argsort(col, kind="stable")
    row, begin = np.repeat(np.arange(m, dtype=np.int32), size)[by], np.cumsum(size) - size
    del by
    many = np.bincount(col, minlength=n)
    filled, used = np.flatnonzero(size), np.flatnonzero(many)
    first = (np.cumsum(many) - many)[used]

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.zeros(m)
        out[filled] = np.add.reduceat((scale * x)[col], begin[filled]) if len(filled) else 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[used] = np.add.reduceat(r[row], first) if len(used) else 0
        return scale * out

    v = np.ones(n)
    top = 1.0
    for _ in range(15):
        v = back(forward(v))
        top = max(np.linalg.norm(v), 1e-12)
        v /= top
    step = 1 / (0.25 * (top + m) / m + penalty)
    w = u = np.zeros(n)
    b = c = 0.0
    t = 1.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-(forward(u) + c))) - y) / m
        slope = back(g) + penalty * u
        if np.abs(slope).max(initial=0) < flat and abs(g.sum()) < flat:
            break
        w2 = u - step * slope
        b2 = c - step * g.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of each row of ``docs``: one scan, no shuffle.

    Every n-gram of the whole text, however long, counts once. A null or letterless text has no n-gram
    and gets the share of toxic rows as its score. Null and repeated doc_ids pass through, a row each;
    equal texts get equal scores; an empty table gives no row; other columns are not read. The model,
    of fixed size, is broadcast.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = model.effect != 0
        for batch in batches:
            texts = texts_of(batch)
            logit = np.zeros(len(texts))
            for first, last, doc, bucket in features(texts, known):
                logit[first:last] = np.bincount(doc, model.effect[bucket].astype(float), last - first)
            p = 1 / (1 + np.exp(-np.clip(logit + model.bias, -500, 500)))
            empty = np.array([not regex.search(r"\p{L}", t[:200]) and not regex.search(r"\p{L}", t) for t in texts], bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(empty, model.base, p), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
