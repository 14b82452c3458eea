"""Seeded test lines with a controllable share of repeated string parts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions.grammar import base36

#: Vocabulary of the string parts: our own list, of mixed case, with phrases and other alphabets.
WORDS = (
    "amber birch Copper dune ember Fjord granite harbor indigo juniper kelp lagoon Meadow nectar onyx prairie "
    "quartz river saffron tundra umber velvet willow xenon yarrow zephyr café Łódź Zürich naïve"
).split() + ["deep blue", "old stone bridge", "Пример", "例え"]
#: Fixed values of the generator's contract: shared string parts, digits of a number.
SHARED, MAX_DIGITS = 64, 19


@dataclass(frozen=True)
class Options:
    size: int
    seed: int = 0
    ratio: float = 0.1

    def __post_init__(self) -> None:
        if not 0 <= self.ratio <= 1 or self.size < 0:
            raise ValueError("the ratio is from 0 to 1 and the size not negative")


def digest(seed: Column | int, key: Column, purpose: str) -> Column:
    """128 bits in hex from md5, the same in every engine that has it."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string"), F.lit(purpose)).cast("binary"))


def cut(hexes: Column, at: int, width: int, modulus: int) -> Column:
    """A number below ``modulus`` from some digits of a digest, counted from 1."""
    return F.conv(F.substring(hexes, at, width), 16, 10).cast("long") % F.lit(modulus)


def draw(seed: Column | int, key: Column, purpose: str, modulus: int) -> Column:
    """A number below ``modulus`` of its own digest."""
    return cut(digest(seed, key, purpose), 1, 15, modulus)


def shared_part(seed: int, slot: int) -> str:
    """One of the string parts that lines share, made like others but on the driver."""
    hexes = hashlib.md5(f"{seed}:{slot}:part".encode()).hexdigest()
    numbers = [int(hexes[i : i + 8], 16) for i in range(0, 32, 8)]
    return " ".join([*(WORDS[n % len(WORDS)] for n in numbers[: numbers[3] % 4 + 1]), "s"])


def lines(spark: SparkSession, n: int, seed: int = 0, ratio: float = 0.1) -> DataFrame:
    """id, number, string_part, line of n generated lines, each from its id alone.

    A line shares its string part with probability ``ratio``, one of 64 parts; other parts end in a
    token of their own, so they never repeat by chance. With a ratio above 0 the first two lines
    share a part. A number's count of digits is drawn first. Three digests serve a line.
    """
    ids = spark.range(n)
    key = F.col("id")
    ids = ids.withColumns({"_line": digest(seed, key, "line"), "_number": digest(seed, key, "number"), "_words": digest(seed, key, "words")})
    shared = (cut(F.col("_line"), 1, 8, 1_000_000) < int(round(ratio * 1_000_000))) | ((key < 2) if ratio > 0 else F.lit(False))
    slot = F.when(key < 2, F.lit(0)).otherwise(cut(F.col("_line"), 9, 8, SHARED))
    digits = cut(F.col("_line"), 17, 8, MAX_DIGITS) + 1
    wide = F.concat(cut(F.col("_number"), 1, 15, 10**9).cast("string"), F.lpad(cut(F.col("_number"), 16, 15, 10**10).cast("string"), 10, "0"))
    number = F.expr("try_cast(ltrim('0', _wide) AS bigint)")
    vocabulary = F.array(*[F.lit(w) for w in WORDS])
    picked = F.array(*[F.element_at(vocabulary, (cut(F.col("_words"), 8 * i + 1, 8, len(WORDS)) + 1).cast("int")) for i in range(4)])
    own = F.array_join(F.slice(picked, F.lit(1), (cut(F.col("_line"), 25, 8, 4) + 1).cast("int")), " ")
    parts = F.array(*[F.lit(shared_part(seed, k)) for k in range(SHARED)])
    text = F.when(shared, F.element_at(parts, (slot + 1).cast("int"))).otherwise(F.concat_ws(" ", own, base36(key)))
    out = ids.withColumn("_wide", F.substring(F.lpad(wide, 19, "1"), F.lit(1), digits.cast("int"))).withColumn("string_part", text)
    out = out.withColumn("number", F.coalesce(number, F.lit(0)))
    return out.select("id", "number", "string_part", F.concat(F.col("number").cast("string"), F.lit(". "), "string_part").cast("binary").alias("line"))


def sized(spark: SparkSession, options: Options) -> DataFrame:
    """The longest run of generated lines from the first on that fits ``options.size`` bytes with
    their line ends. A larger size only adds lines.

    Lengths are summed per block of ids; the running sum is over one row per block, then within
    the block that the end falls in.
    """
    guess, block = options.size // 4 + 2, 65_536
    made = lines(spark, guess, options.seed, options.ratio).withColumn("size", F.octet_length("line") + 1).withColumn("block", F.floor(F.col("id") / block))
    sums = made.groupBy("block").agg(F.sum("size").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).where(F.col("base") < options.size)
    run = F.sum("size").over(Window.partitionBy("block").orderBy("id"))
    fits = made.join(base, "block").withColumn("end", F.col("base") + run).where(F.col("end") <= options.size)
    return fits.select("id", "number", "string_part", "line").orderBy("id")


def repeated_share(parsed: DataFrame) -> DataFrame:
    """One row: lines, repeated_lines, share: how many lines' string part another line has too."""
    counts = parsed.groupBy("string_part").agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_lines")
    ).withColumn("share", F.when(F.col("lines") > 0, F.col("repeated_lines") / F.col("lines")).otherwise(0.0))
