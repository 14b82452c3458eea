"""Language identification: words first, then ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.bpe import MEMO
from lineweave.llm.common import small_batches, texts_of
from lineweave.llm.sampling import bounded_per_group

#: Most labelled documents the model is fitted on, shared out equally among the languages.
TRAIN_DOCS = 20_000
#: Longest n-gram of the backoff, in characters (code points).
LONGEST = 5
#: Most characters of a run of letters that is looked up as a word. Longer runs, those of scripts
#: without blanks among them, are learned and judged by their n-grams.
WORD_CHARS = 64
WORDS = regex.compile(r"\p{L}+")
#: A backed-off word says less than a known one.
BACKOFF = 0.4
#: Entries of a worker's counter that it hands on at once.
_ENTRIES = 200_000


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def cut(word: str, n: int) -> list[str]:
    """The n-grams of a word between marks for its start and end."""
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Table:
    """Log frequencies by language of words, or of n-grams of one length: sorted 64-bit hashes, each
    with the languages it was seen in; for the others a smoothed value that depends on them alone."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int):
        order = np.lexsort((lang, key))
        key, self.lang, n = key[order], lang[order], n[order].astype(float)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        self.key, self.start = key[first], np.append(first, len(key))
        total = np.bincount(self.lang, n, languages) + 0.5 * max(1, len(first))
        self.unseen = np.log(0.5 / total)
        self.seen = (np.log((n + 0.5) / total[self.lang])).astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and their log frequencies, a row for each known one."""
        if not len(self.key):
            return np.zeros(len(keys), bool), np.zeros((0, len(self.unseen)))
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        known = self.key[at] == keys
        at = at[known]
        many = self.start[at + 1] - self.start[at]
        row = np.repeat(np.arange(len(at)), many)
        cell = self.start[at][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        out = np.tile(self.unseen, (len(at), 1))
        out[row, self.lang[cell]] = self.seen[cell]
        return known, out


class LanguageModel:
    def __init__(self, languages: list[str], tables: list[Table], backoff: float = BACKOFF):
        """``tables``: of words, then of n-grams of 1 to LONGEST characters."""
        self.languages, self.tables, self.backoff = languages, tables, backoff

    @classmethod
    def of(cls, rows: dict[str, np.ndarray], languages: list[str]) -> LanguageModel:
        """From counts: kind (0 words, else the length of the n-gram), key, lang (its number), n."""
        mine = [rows["kind"] == k for k in range(LONGEST + 1)]
        return cls(languages, [Table(*(rows[c][m] for c in ("key", "lang", "n")), len(languages)) for m in mine])

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log frequencies of words less their mean over the languages, a row each: a known word's
        own, else the mean over its longest n-grams that the model knows, weighed down; else 0."""
        out = np.zeros((len(words), len(self.languages)))
        known, found = self.tables[0].find(np.array([hashed(w) if len(w) <= WORD_CHARS else 0 for w in words], np.uint64))
        known &= np.array([len(w) <= WORD_CHARS for w in words], bool)[: len(known)]
        out[known] = found[: int(known.sum())]
        rest, weight = np.flatnonzero(~known), np.where(known, 1.0, self.backoff)
        for n in range(LONGEST, 0, -1):
            if not len(rest):
                break
            grams = [cut(words[i], n) for i in rest.tolist()]
            row = np.repeat(np.arange(len(rest)), [len(g) for g in grams])
            have, found = self.tables[n].find(np.array([hashed(g) for some in grams for g in some], np.uint64))
            row = row[have]
            if len(row):
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                out[rest[row[first]]] = np.add.reduceat(found, first) / np.diff(np.append(first, len(row)))[:, None]
            rest = np.delete(rest, np.unique(row))
        return (out - out.mean(1, keepdims=True)) * weight[:, None] if len(words) else out


class Scorer:
    """Scores texts; evidence of words met before is kept in one growing matrix."""

    def __init__(self, model: LanguageModel, memo: int = MEMO):
        # as many words as `memo`, fewer where there are many languages, so the matrix is bounded
        self.model, self.memo = model, max(4096, min(memo, (64 << 20) // (8 * max(1, len(model.languages)))))
        self._reset()

    def _reset(self) -> None:
        self.places: dict[str, int] = {}
        self.matrix = np.zeros((1 << 12, len(self.model.languages)))

    def _learn(self, words: set[str]) -> None:
        """Puts words that were not met before into the matrix."""
        new = sorted(w for w in words if w not in self.places)
        if len(self.places) + len(new) > self.memo:
            self._reset()
            new = sorted(words)
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            have = len(self.places)
            while have + len(some) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[have : have + len(some)] = self.model.evidence(some)
            self.places.update(zip(some, range(have, have + len(some)), strict=True))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """A language and its share for each of some texts."""
        out = []
        for i in range(0, len(texts), 64):
            words = [WORDS.findall(t.lower()) for t in texts[i : i + 64]]
            if self.model.languages:
                self._learn({w for some in words for w in some if len(w) <= WORD_CHARS})
            out += map(self._verdict, words)
        return out

    def _verdict(self, words: list[str]) -> tuple[str, float]:
        if not words or not self.model.languages:
            return "und", 0.0
        short = [self.places[w] for w in words if len(w) <= WORD_CHARS]
        total = self.matrix[short].sum(0)
        if len(short) < len(words):
            for w in words:
                if len(w) > WORD_CHARS:  # a run counts as many words as it would make
                    total += self.model.evidence([w])[0] * -(-len(w) // LONGEST)
        count = len(short) + sum(-(-len(w) // LONGEST) for w in words if len(w) > WORD_CHARS)
        total /= count**0.5
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def fit_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """The model of ``docs`` (doc_id, text, lang), fitted on at most ``train_docs`` of them, of which
    each language gives an equal share or all it has; so a rare language beside a large one is
    learned from as many documents. All words and n-grams of these whole documents count. What the
    driver gets are the sums by word, n-gram and language of that bounded sample.

    Rows with a null lang, text or doc_id teach nothing; a doc_id with several rows teaches by each.
    Without rows there is no language. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def flush(seen: Counter, names: list[str]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in seen]) for i in range(len(names) - 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(seen.values(), pa.int64())], names)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                seen.update((lang, w) for w in WORDS.findall(text.lower()))
                if len(seen) > _ENTRIES:
                    yield flush(seen, ["lang", "word", "n"])
                    seen.clear()
        if seen:
            yield flush(seen, ["lang", "word", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def done() -> pa.RecordBatch:
            kind, key, lang = (list(c) for c in zip(*((kind, hashed(gram), lang) for lang, kind, gram in seen), strict=True))
            columns = [pa.array(kind, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(lang, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(seen.values(), pa.int64())], ["kind", "key", "lang", "n"])

        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                if len(word) <= WORD_CHARS:
                    seen[lang, 0, word] += n
                for k in range(1, LONGEST + 1):
                    for gram in cut(word, k):
                        seen[lang, k, gram] += n
                if len(seen) > _ENTRIES:
                    yield done()
                    seen.clear()
        if seen:
            yield done()

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sample = labelled.join(F.broadcast(bounded_per_group(labelled, train_docs, "lang")), ["doc_id", "lang"])
    by_word = sample.select("text", "lang").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sums = by_word.mapInArrow(grams, "kind int, key long, lang string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("lang").combine_chunks().dictionary_encode() if sums.num_rows else None
    languages = sorted(names.dictionary.to_pylist()) if names is not None else []
    place = np.array([languages.index(x) for x in names.dictionary.to_pylist()], np.int16) if languages else np.zeros(0, np.int16)
    rows = {c: sums.column(c).to_numpy() for c in ("kind", "key", "n")}
    rows["lang"] = place[names.indices.to_numpy()] if languages else place
    rows["key"] = rows["key"].astype(np.int64).view(np.uint64)
    return LanguageModel.of(rows, languages)


def predict_languages(docs: DataFrame, model: LanguageModel, memo: int = MEMO) -> DataFrame:
    """doc_id, lang_pred, score (the share of the predicted language, 0 to 1) of each row of ``docs``.

    A null text and a text without a letter give ``und`` and 0. Ties go to the first language in
    alphabetic order. Whole texts count, of any length; null and repeated doc_ids pass through, and
    equal texts get equal results. An empty table gives no row; other columns are not read. The
    model, bounded by its sample, is broadcast.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, memo)
        for batch in batches:
            found = scorer.predict(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
