"""Simple-8b: word-aligned coding of unsigned integers, with numpy on whole arrays.

A 64-bit word holds a selector in its top four bits and up to 60 bits of values, the first value
lowest. Selectors 0 to 13 stand for the counts in ``COUNTS``, each value getting 60 // count bits.
Selector 15 is an escape: the next word is one raw 64-bit value. Values are coded in blocks; each
block starts a new word, and its word offset is kept, so blocks can be decoded by themselves.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the coding: values per word, by selector.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BITS = 60 // COUNTS
ESCAPE = 15
BLOCK = 256


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 needs none. Exact for all 64 bits."""
    high, low = (values >> np.uint64(32)).astype(np.float64), (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the offset of each block's first word."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    rows = -(-n // block)
    need = np.full(rows * block, 99, np.uint8)  # what is past the end never fits
    need[:n] = bit_lengths(values)
    need = need.reshape(rows, block)
    # step[i]: the selector of the longest run from i on that fits a word and stays in its block
    step = np.full((rows, block), ESCAPE, np.uint8)
    widest, reach = need.copy(), 1
    for selector, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        if count > block:
            break
        while reach < count:
            widest[:, : block - reach] = np.maximum(widest[:, : block - reach], need[:, reach:])
            widest[:, block - reach :] = 99
            reach += 1
        fits = widest <= bits
        if not fits.any():
            break
        step[fits] = selector
    jump = np.ones(16, np.int64)
    jump[: len(COUNTS)] = COUNTS
    # all blocks take their next word together
    begins = np.zeros((rows, block), bool)
    live, at = np.arange(rows), np.zeros(rows, np.int64)
    ends = np.full(rows, block)
    ends[-1] = n - (rows - 1) * block
    while len(live):
        begins[live, at] = True
        at = at + jump[step[live, at]]
        keep = at < ends[live]
        live, at = live[keep], at[keep]
    starts = np.flatnonzero(begins.ravel())
    selectors = step.ravel()[starts]
    size = np.where(selectors == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(selectors):
        mine = selectors == s
        if s == ESCAPE:
            words[place[mine]] = np.uint64(ESCAPE << 60)
            words[place[mine] + 1] = values[starts[mine]]
            continue
        word = np.full(int(mine.sum()), int(s) << 60, np.uint64)
        for j in range(COUNTS[s]):
            word |= values[starts[mine] + j] << np.uint64(j * BITS[s])
        words[place[mine]] = word
    first = np.searchsorted(starts, np.arange(rows) * block)
    return words, place[first].astype(np.uint32)


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of consecutive whole blocks."""
    words = np.ascontiguousarray(words, np.uint64)
    heads = np.arange(len(words))
    selectors = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is a raw value; only a chain of such words needs care
    escapes = np.flatnonzero(selectors == ESCAPE)
    if len(escapes):
        raw, last = np.zeros(len(words), bool), -2
        for e in escapes:
            if e != last + 1:  # not itself a raw value
                raw[e + 1], last = True, e
        heads = np.flatnonzero(~raw)
        selectors = selectors[heads]
    count = np.ones(16, np.int64)
    count[: len(COUNTS)] = COUNTS
    sizes = count[selectors]
    place = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s in np.unique(selectors):
        mine = selectors == s
        if s == ESCAPE:
            out[place[mine]] = words[heads[mine] + 1]
            continue
        word, mask = words[heads[mine]], np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNTS[s]):
            out[place[mine] + j] = (word >> np.uint64(j * BITS[s])) & mask
    if len(out) != n:
        raise ValueError(f"{len(out)} values are coded where {n} are expected")
    return out
