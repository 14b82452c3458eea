"""Line files that arrive over time, with the batch grammar: Structured Streaming over a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lineweave.functions.grammar import DEFAULT_MAX_LINE, parse, strip_cr
from lineweave.functions.hashing import fnv1a64
from lineweave.operators.malformed import split_lenient, with_reason
from lineweave.operators.order import sort_lines


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of parsed lines of the files that appear in ``folder``, each file once. Files are
    whole when they appear, so put them there by a rename."""
    source = spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger)
    raw = source.load(folder).select(F.col("value").cast("binary").alias("raw"))
    return parse(raw.withColumn("line", strip_cr(F.col("raw"))))


def sorted_runs(lines: DataFrame, runs: str, bad: str, checkpoint: str, max_line: int = DEFAULT_MAX_LINE) -> StreamingQuery:
    """Writes every micro-batch as a sorted run below ``runs`` and its malformed lines below ``bad``.

    A batch goes to a folder of its own number and overwrites it, so a batch that is repeated after
    a failure leaves one copy. Runs are Parquet; a batch sort of all of them is the global order.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, rejected = split_lenient(batch, max_line)
        sort_lines(good.select("line", "number", "string_part")).write.mode("overwrite").parquet(f"{runs}/batch={number}")
        rejected.select("line", "reason").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_report(lines: DataFrame, max_line: int = DEFAULT_MAX_LINE) -> DataFrame:
    """A stream of one row: lines, malformed lines, and the two halves of the content hash's sum."""
    marked = with_reason(lines, max_line).withColumn("h", fnv1a64("line"))
    return marked.groupBy().agg(
        F.count("*").alias("lines"),
        F.count("reason").alias("malformed"),
        F.sum(F.shiftrightunsigned("h", 32).cast("decimal(20,0)")).alias("hash_high"),
        F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)")).alias("hash_low"),
    )
