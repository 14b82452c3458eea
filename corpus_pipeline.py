"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``documents``.

* quality_rules drops what the fixed rules or the n-gram ratio reject. Documents without text go;
  the trusted texts are the documents of ``docs`` that ``labels`` marks with quality 1.
* near_duplicates keeps one document of each class, the one with the least doc_id (nulls last).
* repeated_passages cuts every byte of a 200-byte string that starts elsewhere too, and what is left
  of a character that a cut splits; n_chars is counted anew where it was known. No row goes.
* decontamination drops documents that contain a benchmark item.
* packing returns the pieces of the packed sequences.

An empty table gives an empty result at every stage. Texts of any length are treated whole, each in
one task. Columns of ``docs`` beyond those of ``documents`` are not carried, so their names clash
with nothing. Null doc_ids and repeated rows are rows like others, but the second stage leaves one of
rows alike in doc_id and text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.common import Scratch, read_table
from lineweave.llm.decontaminate import clean
from lineweave.llm.near_duplicates import near_duplicates, text_name
from lineweave.llm.packing import pack
from lineweave.llm.quality import quality
from lineweave.llm.repeats import cut_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that neither the fixed rules nor the n-gram ratio reject."""
    return quality(docs, read_table(spark, sf_dir, "labels"), carry=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the one with the least doc_id."""
    docs = _only(docs).withColumn("name", text_name())
    classes, _ = near_duplicates(docs.select("doc_id", "text"))
    first = classes.where("first").select("doc_id", "name")
    same = (docs["name"] == first["name"]) & docs["doc_id"].eqNullSafe(first["doc_id"])
    return docs.join(first, same, "left_semi").dropDuplicates(["doc_id", "name"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the bytes of 200-byte strings that start elsewhere in ``docs`` too."""
    return cut_repeats(_only(docs), length=200).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that no benchmark item contaminates."""
    return clean(_only(docs), read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, as ``pack`` returns them."""
    return pack(docs, "byte_bpe_50k.json", end_id=1, window=2048)


_spent: list[tuple[int, str, Scratch]] = []


def _stage(number: int, f: Callable) -> Callable:
    """Frees what earlier stages of the same input left behind, if ``docs`` reads none of it: then
    their results are written. What stays is freed when the interpreter ends."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        done = [x for x in _spent if x[0] < number and x[1] == sf_dir]
        read = " ".join(docs.inputFiles()) if done else ""
        for spent in done:
            if spent[2].root.removeprefix("file://") not in read:
                spent[2].release()
                _spent.remove(spent)
        before = {id(s) for s in Scratch.live()}
        result = f(spark, docs, sf_dir)
        _spent.extend((number, sf_dir, s) for s in Scratch.live() if id(s) not in before)
        return result

    return run_stage


_FUNCTIONS = {
    "quality_rules": quality_rules,
    "near_duplicates": near_duplicate_stage,
    "repeated_passages": repeated_passages,
    "decontamination": decontamination,
    "packing": packing,
}
STAGES = [(name, _stage(k, f)) for k, (name, f) in enumerate(_FUNCTIONS.items())]

#: No stage but the base rules can be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below spark.checkpoint.dir and read again."""
    docs = read_table(spark, sf_dir, "documents")
    written = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = written.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
