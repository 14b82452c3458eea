"""Sorting a line file from end to end."""

from __future__ import annotations

import os
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lineweave.functions.grammar import COMPACT, DEFAULT_MAX_LINE, compact, parse, rebuilt
from lineweave.operators.malformed import MalformedLine, check
from lineweave.sources.lines import edges, input_lines
from lineweave.sources.sink import publish, write_parts


class _Sorted:
    """A file's sorted lines, whose malformed ones are counted while they are sorted."""

    def __init__(self, spark: SparkSession, path: str, max_line: int):
        self.path, self.max_line, self.spark = path, max_line, spark
        self.parsed = parse(input_lines(spark, path))
        self.seen = Observation()
        bad = (F.octet_length("line") > max_line) | F.col("number").isNull()
        watched = self.parsed.observe(self.seen, F.count(F.when(bad, 1)).alias("bad"))
        self.lines = rebuilt(compact(watched).orderBy(*COMPACT))

    def accept(self) -> None:
        """After the lines were written: raises MalformedLine for the first bad one, if any."""
        try:
            bad = self.seen.get["bad"]
        except (Py4JJavaError, KeyError):  # a plan that turned out empty has no metrics; then look
            bad = True
        if bad:
            check(self.parsed, self.max_line, edges(self.spark, self.path).bom)


def sorted_lines(spark: SparkSession, path: str, max_line: int = DEFAULT_MAX_LINE) -> DataFrame:
    """The file's lines in order (``line``); raises MalformedLine before anything is sorted. The
    exchange carries a line's bytes once, cut into its parts."""
    parsed = parse(input_lines(spark, path))
    check(parsed, max_line, edges(spark, path).bom)
    return rebuilt(compact(parsed).orderBy(*COMPACT))


def sort_file(spark: SparkSession, source: str, destination: str, temp: str | None = None, max_line: int = DEFAULT_MAX_LINE, told: Callable[[list[int]], None] | None = None) -> int:
    """Sorts a file into one local file, published at once; returns its bytes. Empty input gives an
    empty file. Lines are validated on their way into the sort, which costs no pass of its own; a
    malformed one stops the publication, so an existing result stays as it was. ``told`` gets the bytes
    of each range, in order."""
    temp = temp or os.path.dirname(os.path.abspath(destination))
    work = _Sorted(spark, source, max_line)
    return publish(work.lines, destination, temp, accept=work.accept, told=told)


def sort_to_parts(spark: SparkSession, source: str, folder: str, max_line: int = DEFAULT_MAX_LINE) -> None:
    """Sorts into ordered part files of a folder: the form for inputs that no single disk holds. The
    folder is removed again if a line is malformed."""
    work = _Sorted(spark, source, max_line)
    write_parts(work.lines, folder)
    try:
        work.accept()
    except MalformedLine:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        raise
