"""FNV-1a-64 of whole lines, and its order-independent sum."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Fixed values of FNV-1a-64.
OFFSET, PRIME = 14695981039346656037, 1099511628211


def fnv1a64_runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of a buffer: all take their next byte together, longest runs first."""
    order = np.argsort(-size, kind="stable")
    begin = begin[order]
    h = np.full(len(size), OFFSET, np.uint64)
    live = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    prime = np.uint64(PRIME)
    for j, n in enumerate(live.tolist()):
        h[:n] = (h[:n] ^ data[begin[:n] + j]) * prime
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a64_batch(lines: list[bytes]) -> np.ndarray:
    """Hashes of a list of lines."""
    size = np.array([len(x) for x in lines], np.int64)
    return fnv1a64_runs(np.frombuffer(b"".join(lines), np.uint8), np.cumsum(size) - size, size)


def fnv1a64_column(lines: pa.Array) -> np.ndarray:
    """Hashes of a column of bytes without nulls, read where it lies."""
    lines = lines.cast(pa.large_binary())
    _, ends, data = lines.buffers()
    ends = np.frombuffer(ends, np.int64)[lines.offset : lines.offset + len(lines) + 1]
    return fnv1a64_runs(np.frombuffer(data or b"", np.uint8), ends[:-1], np.diff(ends))


@pandas_udf(LongType())
def fnv1a64(lines: pd.Series) -> pd.Series:
    """The hash's 64 bits as a signed long; a null line hashes like an empty one."""
    return pd.Series(fnv1a64_batch([b"" if x is None else bytes(x) for x in lines]).view(np.int64))


def unsigned_sum(h: Column) -> Column:
    """Sum of 64-bit patterns modulo 2**64, as decimal(38,0)."""
    high = F.sum(F.shiftrightunsigned(h, 32).cast("decimal(20,0)"))
    low = F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)"))
    carried = F.pmod(high, F.lit(Decimal(2**32))).cast("decimal(10,0)") * F.lit(Decimal(2**32)).cast("decimal(10,0)")
    return F.pmod(carried.cast("decimal(38,0)") + low.cast("decimal(38,0)"), F.lit(Decimal(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)")
