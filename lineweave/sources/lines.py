"""Line files as DataFrames: raw bytes, exact ends of lines, and where each line stands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.functions.grammar import strip_cr

BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Edges:
    """A file's size and its first and last bytes, read by the driver alone."""

    size: int
    head: bytes
    tail: bytes

    @property
    def bom(self) -> int:
        return len(BOM) if self.head == BOM else 0

    @property
    def terminated(self) -> bool:
        return self.size == self.bom or self.tail[-1:] == b"\n"

    @property
    def bare_cr(self) -> bool:
        """A carriage return alone after the last line end: a terminator, not a line."""
        body = self.tail[-min(2, self.size - self.bom) :] if self.size > self.bom else b""
        return body in (b"\r", b"\n\r")


def edges(spark: SparkSession, path: str) -> Edges:
    """Through Hadoop's file system, so any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(file).getLen()
    stream = fs.open(file)
    try:
        head = bytes(stream.read() for _ in range(min(3, size)))
        stream.seek(max(0, size - 2))
        tail = bytes(stream.read() for _ in range(min(2, size)))
    finally:
        stream.close()
    return Edges(size, head, tail)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """block, seq, raw: the records between line feeds, as bytes.

    (block, seq) orders a file's records: ``block`` is where the record's split starts in the file,
    ``seq`` rises within a split. Splits are read in parallel; a leading byte order mark is not part
    of the first record.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("raw"),
    )


def input_lines(spark: SparkSession, path: str) -> DataFrame:
    """block, seq, raw, line of a user's file: one trailing carriage return is no part of a line,
    and neither is an empty rest after the last line end."""
    df = raw_lines(spark, path)
    if edges(spark, path).bare_cr:
        last = df.agg(F.max(F.struct("block", "seq")).alias("m")).first()["m"]
        df = df.where(~((F.col("block") == last["block"]) & (F.col("seq") == last["seq"])))
    return df.withColumn("line", strip_cr(F.col("raw")))


def output_lines(spark: SparkSession, path: str) -> DataFrame:
    """block, seq, raw, line of a result file: a carriage return is content."""
    return raw_lines(spark, path).withColumn("line", F.col("raw"))


def numbered(df: DataFrame, bom: int = 0) -> DataFrame:
    """Adds ``line_no`` (from 1) and ``byte_offset``. Windows are per split; only one row per split
    is ordered globally."""
    from pyspark.sql import Window

    size = F.octet_length("raw") + 1
    splits = df.groupBy("block").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("block").orderBy("seq")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_n", F.row_number().over(inside))
        .withColumn("_b", F.coalesce(F.sum(size).over(earlier), F.lit(0)))
        .join(base, "block")
        .withColumn("line_no", F.col("n0") + F.col("_n"))
        .withColumn("byte_offset", F.col("b0") + F.col("_b") + bom)
        .drop("_n", "_b", "n0", "b0")
    )
