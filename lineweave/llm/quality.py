"""Quality rules: fixed text rules, then a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lineweave.llm.common import Bytes, gram_hashes, mix, small_batches, texts_of, word_runs

#: Hash buckets of the two multinomials; what is broadcast has this size at any size of corpus.
BUCKETS = 1 << 16
#: Most ids of trusted documents that are broadcast; more are joined by an exchange.
BROADCAST_IDS = 1_000_000
#: Mean log-likelihood ratio per n-gram, in nats, from which a document is kept.
THRESHOLD = -0.3
#: Words of the windows whose repeats count.
SPAN = 8

BLANKS = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHUNK = 1 << 16


class Chunk:
    """Some whole texts in one buffer, with their words and word hashes."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        data = b"\n".join(texts)
        self.bytes = Bytes(data)
        size = np.array([len(t) + 1 for t in texts])
        self.begin = np.cumsum(size) - size
        self.start, self.end = word_runs(self.bytes.data)
        self.doc = np.searchsorted(self.begin, self.start, side="right") - 1
        self.words = np.bincount(self.doc, minlength=self.n)
        self.hash = self.bytes.hashes(self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each text has."""
        total = np.concatenate(([0], np.cumsum(flags)))
        ends = np.append(self.begin[1:] - 1, len(flags))
        return total[ends] - total[self.begin]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word n-grams within texts, and the text of each."""
        h = gram_hashes(self.hash, n)
        inside = self.doc[: len(h)] == self.doc[n - 1 :] if len(h) else np.zeros(0, bool)
        return h[inside], self.doc[: len(h)][inside]

    def repeated_words(self, span: int) -> np.ndarray:
        """Words of each text that lie in windows found twice or more in it."""
        h, doc = self.grams(span)
        first = np.flatnonzero(self.doc[: len(self.doc) - span + 1] == self.doc[span - 1 :]) if len(h) else np.zeros(0, np.int64)
        key = mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        cover = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(cover, first[twice], 1)
        np.add.at(cover, first[twice] + span, -1)
        covered = np.cumsum(cover[:-1]) > 0
        return np.bincount(self.doc[covered], minlength=self.n)


def chunks(texts: list[str]) -> Iterator[tuple[int, int, Chunk]]:
    """Runs of texts of about _CHUNK bytes together (or one long text), as (first, last + 1, chunk)."""
    first, size, some = 0, 0, []
    for i, text in enumerate(texts):
        some.append(text.encode("utf-8", "surrogatepass"))
        size += len(some[-1])
        if size >= _CHUNK:
            yield first, i + 1, Chunk(some)
            first, size, some = i + 1, 0, []
    if some:
        yield first, len(texts), Chunk(some)


def buckets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word, every pair of neighbouring words and every run of four bytes.

    The byte runs let the ratio judge words that no other document has, by how they are spelt.
    """
    parts = [chunk.grams(1), chunk.grams(2)]
    word = np.concatenate([mix(h + np.uint64(n)) for n, (h, _) in enumerate(parts)]) & np.uint64(BUCKETS - 1)
    data = chunk.bytes.data.astype(np.uint32)
    run = data[:-3] | (data[1:-2] << 8) | (data[2:-1] << 16) | (data[3:] << 24) if len(data) > 3 else data[:0]
    run = (run * np.uint32(0x9E3779B1)) >> np.uint32(16)
    at = np.repeat(np.arange(chunk.n), np.diff(np.append(chunk.begin, len(data) + 1)))[: len(data)]
    at[chunk.begin[1:] - 1] = -1  # what parts two texts belongs to neither
    inside = (at[: len(run)] == at[3:]) & (at[3:] >= 0) if len(run) else np.zeros(0, bool)
    return np.concatenate([word.astype(np.int64), run[inside].astype(np.int64)]), np.concatenate([*(d for _, d in parts), at[: len(run)][inside]])


def fit_ratio(docs: DataFrame, trusted_ids: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """log(p_target / p_raw) of each bucket.

    The raw multinomial counts every document, the target one every document in ``trusted_ids``
    (distinct), whose number is checked before they are broadcast. Every task adds up its own counts,
    at most BUCKETS rows; the sums that reach the driver are BUCKETS rows too.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for first, last, chunk in chunks(texts_of(batch)):
                b, doc = buckets(chunk)
                raw += np.bincount(b, minlength=BUCKETS)
                target += np.bincount(b[trusted[first:last][doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    known = trusted_ids.select("doc_id", F.lit(True).alias("trusted"))
    if trusted_ids.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    marked = docs.select("doc_id", "text").join(known, "doc_id", "left")
    marked = marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    sums = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(BUCKETS, smoothing), np.full(BUCKETS, smoothing)
    for row in sums.collect():
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if target.sum() <= BUCKETS * smoothing:  # nothing is trusted: no verdict but the rules'
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def quality(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, min_words: int = 20, max_repeat_percent: int = 30, carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio.

    ``labels`` (doc_id, quality) names trusted documents by quality 1; all of them make the target
    multinomial. ``ratio`` is the mean log ratio of a document's n-grams (words, word pairs, runs of
    four bytes); the verdict is ratio >= threshold. Two scans of the texts, no shuffle of them while
    the trusted ids are few enough to be broadcast.

    A null text has no words and fails; null and repeated doc_ids pass through, a row each. Very long
    texts are judged whole. Equal texts get equal verdicts. Without trusted rows every ratio is 0; an
    empty table gives no row. ``carry`` names the columns of ``docs`` that come along, none of them
    named like a measure, which raises ValueError; others are not read.
    """
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    carry = list(carry)
    if clash := {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"} & set(carry):
        raise ValueError(f"carried columns have the names of measures: {sorted(clash)}")
    sent = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, trusted))
    measures = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"
    schema = StructType([docs.schema[c] for c in carry] + StructType.fromDDL(measures).fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        for batch in batches:
            texts = texts_of(batch)
            words, chars, symbols, repeats = (np.zeros(len(texts), np.int64) for _ in range(4))
            mean = np.zeros(len(texts))
            for first, last, chunk in chunks(texts):
                data = chunk.bytes.data
                words[first:last] = chunk.words
                inside = np.zeros(len(data) + 1, np.int8)
                inside[chunk.start] = 1
                inside[chunk.end] = -1
                inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
                chars[first:last] = chunk.per_doc(inside & ((data & 0xC0) != 0x80))
                symbols[first:last] = chunk.per_doc(_SYMBOL[data])
                repeats[first:last] = chunk.repeated_words(SPAN)
                b, doc = buckets(chunk)
                n = np.bincount(doc, minlength=chunk.n)
                mean[first:last] = np.bincount(doc, ratio[b], minlength=chunk.n) / np.maximum(n, 1)
            lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
            duplicates = [len(x) - len(set(x)) for x in lines]
            failed = (words < min_words) | (100 * repeats > max_repeat_percent * words)
            columns = {c: batch.column(c) for c in carry} | {
                "n_words": pa.array(words), "word_chars": pa.array(chars), "n_symbols": pa.array(symbols),
                "n_dup_lines": pa.array(duplicates, pa.int64()), "n_repeat_words": pa.array(repeats), "base_failed": pa.array(failed),
                "kept": pa.array(~failed & (mean >= threshold)), "ratio": pa.array(mean),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(score, schema)
