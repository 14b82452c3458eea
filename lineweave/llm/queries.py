"""The queries of this subpackage, by the names the entry module registers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.common import read_table, remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier of labelled ones whose crc32(doc_id) mod 3 is not 1."""
    from lineweave.llm.toxicity import fit, score

    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 3) == 1
    model = fit(docs.where(~held_out), read_table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, model, threshold=0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, verdict and ratio of all documents."""
    from lineweave.llm.quality import quality

    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: five-word shingles, similarity 0.8 or more."""
    from lineweave.llm.near_duplicates import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), words=5, least=0.8)[0].select("doc_id", "class_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and which have more than 2,048."""
    from lineweave.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), "word_bpe_49k.json", max_tokens=2048)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of those whose crc32(doc_id) mod 4 is not 2."""
    from lineweave.llm.language import fit_languages, predict_languages

    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 4) == 2
    model = fit_languages(docs.where(~held_out))
    return predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    from lineweave.llm.licenses import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    from lineweave.llm.decontaminate import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's tokens are in the store that was written, and their checksum."""
    from lineweave.llm.token_store import token_store_digest

    return token_store_digest(read_table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses as part of repeated strings of 200 bytes."""
    from lineweave.llm.repeats import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), length=200).drop("kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    from lineweave.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=1, window=2048)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from lineweave.llm.licenses import oracle

    return {"op6_licenses": oracle()}
