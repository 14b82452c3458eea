"""The line grammar ``<Number>.[ ]<String>`` as column expressions. Lines are opaque bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the line format.
DEFAULT_MAX_LINE = 64 * 1024
PREVIEW_BYTES = 128
NUMBER_FIELD = r"(?s)\A([+-]?[0-9]+)\."
#: Order of lines: string part by unsigned bytes, then number, then the raw line.
ORDER = ("string_part", "number", "line")


def as_bytes(column: Column) -> Column:
    return column.cast("binary")


def strip_cr(raw: Column) -> Column:
    """Without one trailing carriage return."""
    cut = F.octet_length(raw) - 1
    return F.when(F.substring(raw, -1, 1) == F.lit(b"\r"), F.substring(raw, F.lit(1), cut)).otherwise(raw)


def number_field(line: Column) -> Column:
    """The text of the number, up to the first period; empty if that is no number."""
    return F.regexp_extract(F.decode(line, "ISO-8859-1"), NUMBER_FIELD, 1)


def parse(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``number`` (null if the line is malformed) and ``string_part``."""
    field = number_field(F.col(line))
    df = df.withColumn("_field", field)
    after = F.length("_field") + 2
    spaced = F.substring(F.col(line), after, F.lit(1)) == F.lit(b" ")
    rest = F.substring(F.col(line), after + F.when(spaced, 1).otherwise(0), F.octet_length(line))
    return (
        df.withColumn("number", F.expr("try_cast(nullif(_field, '') AS bigint)"))
        .withColumn("string_part", F.when(F.col("number").isNotNull(), rest))
        .drop("_field")
    )


#: What a sort moves of a line: its bytes once. They sort like ORDER, see ``compact``.
COMPACT = ("string_part", "number", "field", "late")


def compact(parsed: DataFrame, line: str = "line") -> DataFrame:
    """string_part, number, field, late of parsed lines, in whose order lines are in order.

    Among lines of one string part and number, those of one ``field`` (the number's text) differ at
    most by the blank after the period. The one with it comes first where the string part begins
    above a blank, and last otherwise; ``late`` says so. A field that another one begins with stays
    first, as a period sorts below digits.
    """
    head = F.octet_length(line) - F.octet_length("string_part")
    spaced = F.substring(F.col(line), head, F.lit(1)) == F.lit(b" ")
    field = F.substring(F.col(line), F.lit(1), head - F.when(spaced, 2).otherwise(1))
    above = F.substring("string_part", 1, 1) > F.lit(b" ")
    return parsed.select("string_part", "number", field.alias("field"), (spaced != above).alias("late"))


def rebuilt(compacted: DataFrame) -> DataFrame:
    """The lines of ``compact``."""
    above = F.substring("string_part", 1, 1) > F.lit(b" ")
    blank = F.when(F.col("late") != above, F.lit(b" ")).otherwise(F.lit(b""))
    return compacted.select(F.concat("field", F.lit(b"."), blank, "string_part").alias("line"))


def reason(line: str = "line", max_line: int = DEFAULT_MAX_LINE) -> Column:
    """Why a parsed line is malformed, else null: too_long, no_separator, bad_number, out_of_range."""
    text = F.decode(F.col(line), "ISO-8859-1")
    return (
        F.when(F.octet_length(line) > max_line, "too_long")
        .when(F.instr(text, ".") == 0, "no_separator")
        .when(number_field(F.col(line)) == "", "bad_number")
        .when(F.col("number").isNull(), "out_of_range")
    )


def preview(line: Column) -> Column:
    """The first bytes as text, with a replacement for what is not UTF-8."""
    return F.make_valid_utf8(F.substring(line, 1, PREVIEW_BYTES).cast("string"))


def key_prefix(string_part: Column) -> Column:
    """The first eight bytes in hex, padded with zero bytes: sorts like the string part's start."""
    return F.rpad(F.hex(F.substring(string_part, 1, 8)), 16, "0")


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))
