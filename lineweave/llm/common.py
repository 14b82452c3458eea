"""What several operators of this package share: table access, shared scratch space, word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.sources.shared import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]

#: Rows handed to a Python worker at once; whole texts travel, so the batches stay small.
ARROW_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Caps the rows and bytes of an Arrow batch unless the user already chose smaller numbers. The
    session keeps them: results are lazy, and the settings count when they are computed."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, "2147483647")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo ``modulus`` (null ids count as the text 'null')."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


# ---------------------------------------------------------------- hashing runs of bytes

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(n: int, base: np.uint64 = _BASE, _kept: dict = {}) -> np.ndarray:  # noqa: B006  grown on demand, one per process
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _kept[base] = have = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; it works in place on its own copy."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


class Bytes:
    """Polynomial hashes of any runs of one buffer of bytes (or of other numbers), from a single prefix sum."""

    def __init__(self, data: bytes | np.ndarray):
        self.data = data if isinstance(data, np.ndarray) else np.frombuffer(data, np.uint8)
        self.n = len(self.data)
        p = powers(self.n + 1)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * p[: self.n], out=self.prefix[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run [start, end); equal runs have equal hashes in whatever buffer."""
        return mix((self.prefix[end] - self.prefix[start]) * powers(self.n + 1, _INVERSE)[start])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of each run of n word hashes; empty if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = h * _BASE + words[i : i + count]
    return mix(h)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts, null as the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]
