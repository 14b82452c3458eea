"""Rejection of malformed lines: the first in file order, wherever tasks meet it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions.grammar import DEFAULT_MAX_LINE, preview, reason


class MalformedLine(ValueError):
    """The first malformed line of a file: line_no from 1, byte_offset, preview, path."""

    def __init__(self, line_no: int, byte_offset: int, shown: str, path: str | None = None):
        where = f" in '{path}'" if path else ""
        super().__init__(f'Malformed line {line_no} at byte offset {byte_offset}{where}: "{shown}"')
        self.line_no, self.byte_offset, self.preview, self.path = line_no, byte_offset, shown, path


def with_reason(parsed: DataFrame, max_line: int = DEFAULT_MAX_LINE) -> DataFrame:
    """Adds ``reason``, null for a well-formed line. Input: parsed lines."""
    return parsed.withColumn("reason", reason("line", max_line))


def split_lenient(parsed: DataFrame, max_line: int = DEFAULT_MAX_LINE) -> tuple[DataFrame, DataFrame]:
    """(good lines, quarantine): bad lines are set aside with their reason instead of failing."""
    marked = with_reason(parsed, max_line)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def check(parsed: DataFrame, max_line: int = DEFAULT_MAX_LINE, bom: int = 0, path: str | None = None) -> None:
    """Raises MalformedLine for the first malformed line of a file (block, seq, raw, line, number).

    No task raises: one aggregate finds the least (block, seq) among bad lines, and only then a
    second one counts the lines and bytes before it. Neither shuffles lines.
    """
    bad = (F.octet_length("line") > max_line) | F.col("number").isNull()
    found = parsed.where(bad).agg(F.min(F.struct("block", "seq", preview(F.col("line")).alias("shown"))).alias("m")).first()["m"]
    if found is None:
        return
    before = parsed.where((F.col("block") < found["block"]) | ((F.col("block") == found["block"]) & (F.col("seq") < found["seq"])))
    n, size = before.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0))).first()
    raise MalformedLine(n + 1, size + bom, found["shown"], path)
