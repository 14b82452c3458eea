"""Byte sizes: literals with binary units, and their description."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Decimal

UNITS = ("B", "KiB", "MiB", "GiB")
LONG_MAX = 2**63 - 1
_LITERAL = re.compile(r"([0-9]+)(b|kib|mib|gib)?", re.IGNORECASE | re.ASCII)


def parse_size(text: str) -> int | None:
    """The bytes of a size literal, or None if it is none or does not fit 63 bits."""
    m = _LITERAL.fullmatch(text)
    if m is None:
        return None
    power = [u.lower() for u in UNITS].index(m[2].lower()) if m[2] else 0
    size = int(m[1]) << (10 * power)
    return size if size <= LONG_MAX else None


def describe_size(n: int) -> str:
    """One decimal in the largest unit that reads below 1024 after rounding."""
    exact = Decimal(n)
    for power, unit in enumerate(UNITS):
        shown = (exact / (1 << (10 * power))).quantize(Decimal("0.1"), ROUND_HALF_EVEN)
        if shown < 1024 or unit == UNITS[-1]:
            return f"{n} B" if power == 0 else f"{shown} {unit}"
    raise AssertionError
