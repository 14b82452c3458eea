"""Exact, memoised front end of the byte-pair tokenizers.

A column of texts is cut at places where the tokenizer itself always cuts: before each run of
blanks, tabs or line ends, and, in pieces of Latin letters, digits and ASCII punctuation, between
the pre-tokens that the library would make of them. Each distinct piece is encoded once and
remembered: pre-tokens by the model's merges alone, other pieces by the library. Texts with rarer
kinds of white space go to the library whole. The ids are always those of ``Tokenizer.encode`` on
the whole text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each memo; beyond it the older half goes. It bounds memory, not results.
MEMO = 300_000
#: White space that could join a run of blanks; a text with any of it goes to the library whole.
ODD_PATTERN = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
PUNCT = r"!-/:-@\[-`{-~"
#: What the tokenizers' own patterns keep together among these characters.
PRE_TOKEN = re.compile(rf" ?(?:[{LETTERS}]+|[{PUNCT}]+|[0-9]+)|[ \t\n\r]")
#: Kinds of bytes; REST is whatever the cuts here do not know.
BLANK, LETTER, PUNCTUATION, DIGIT, REST = range(5)
KIND = np.full(256, REST, np.uint8)
KIND[list(b" \t\n\r")] = BLANK
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = PUNCTUATION


def tokenizer_json(name: str) -> str:
    """The tokenizer's file as text; read once by the driver and sent with the task."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """A dict that makes what it lacks and forgets the older half when it is full."""

    def __init__(self, make, limit: int = MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, spec: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        #: A normaliser that folds case and white space drops the blank before a word.
        self.folds = parsed["normalizer"] is not None
        self.model, self.letters = self.tok.model, byte_letters()
        # the cut into pre-tokens holds for these two well-known shapes of tokenizer only
        kinds = json.dumps(parsed["pre_tokenizer"])
        special = all(t["content"].startswith("<|") for t in parsed["added_tokens"])
        self.cuts = special and ('"Split"' in kinds and "[\\\\p{L}]+" in kinds if self.folds else '"use_regex": true' in kinds)
        self.pieces = Memo(self._piece, memo)

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a pre-token by the model's merges alone, or of any other piece by the library."""
        if self.folds and not (piece := piece.strip(" \t\n\r")):
            return b""
        if self.cuts and PRE_TOKEN.fullmatch(piece) and (not self.folds or piece == piece.lower()):
            mapped = piece.replace(" ", "\u0120") if piece.isascii() and piece[0] >= " " else piece.encode().decode("latin1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return self.whole(piece)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts (null is empty), end to end, and the number of each text's ids.

        Pieces are found in the column's own bytes and told apart by Arrow's dictionary encoding, so
        Python handles only the distinct pieces of a batch.
        """
        distinct, index, owner, whole = self._distinct(texts)
        coded = list(map(self.pieces.__getitem__, distinct))
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, count = np.frombuffer(b"".join(coded), np.uint32), size[index]
        at = np.repeat((np.cumsum(size) - size)[index] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        length = np.bincount(owner, count, len(texts)).astype(np.int64)
        out = ids[at]
        if len(whole):
            parts = np.split(out, np.cumsum(length)[:-1])
            for k in whole:
                parts[k] = np.frombuffer(self.whole(texts[k].as_py()), np.uint32)
                length[k] = len(parts[k])
            out = np.concatenate(parts)
        return out, length

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit bytes."""
        ids, length = self.column(texts)
        raw, at = ids.astype("<u4").tobytes(), 0
        for n in length.tolist():
            yield raw[at : at + 4 * n]
            at += 4 * n

    def _distinct(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pieces of a column, each piece's index among them, each piece's text, and
        the texts that the library must see whole (their pieces are left out)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        whole = np.zeros(0, np.int64)
        if not self.folds:  # where white space is dropped, any of it inside a piece does no harm
            whole = np.flatnonzero(pc.match_substring_regex(texts, ODD_PATTERN).to_numpy(zero_copy_only=False))
        # a new list entry at each run of blanks, and at each text
        kind = KIND[data]
        latin = np.zeros(len(data), bool)  # the second byte of a Latin letter
        if len(data) > 1:
            latin[1:] = (data[:-1] == 0xC3) & (kind[1:] == REST) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[1:] < 0xC0)
            kind[latin] = LETTER
            kind[:-1][latin[1:]] = LETTER
        blank = kind == BLANK
        first = blank.copy()
        if len(data):
            first[0] = True
            first[1:] &= ~blank[:-1]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(first)
        # pieces that are cut no further: rare characters, contractions, special tokens, blanks in a row
        odd = kind == REST
        if len(data) > 1:
            odd[:-1] |= (data[:-1] == 0x27) & (kind[1:] == LETTER) | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
            if not self.folds:
                odd[1:] |= blank[1:] & blank[:-1]
        if self.cuts and len(start):
            size = np.diff(np.append(start, len(data)))
            plain = np.repeat(np.add.reduceat(odd, start, dtype=np.int64) == 0, size)
            change = np.zeros(len(data), bool)
            change[1:] = (kind[1:] != kind[:-1]) & ((data[:-1] != 32) if not self.folds else True)
            if self.folds:  # every digit is a pre-token; capitals fold
                change |= kind == DIGIT
                upper = plain & ((data >= 0x41) & (data <= 0x5A) | latin & (data <= 0x9E))
                data = data + (upper.view(np.uint8) << 5)
            first |= change & plain
            start = np.flatnonzero(first)
        owner = np.searchsorted(offsets, start, side="right") - 1
        # piece k is data[start[k] : start[k + 1]]; one column over the same bytes
        bounds = np.append(start, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_utf8(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        if len(whole):
            keep = ~np.isin(owner, whole)
            pieces, owner = pieces.filter(pa.array(keep)), owner[keep]
        coded = pieces.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), owner, whole


class Counter(Encoder):
    """Token counts by the whole-token shortcut: proven pre-tokens count one, the rest are merged."""

    def __init__(self, spec: str, proven: frozenset[str], memo: int = MEMO):
        super().__init__(spec, memo)
        self.proven = proven
        self.pieces = Memo(lambda piece: 1 if piece in proven else len(self._piece(piece)) // 4, memo)

    def column(self, texts: pa.Array) -> np.ndarray:
        """The number of each text's tokens."""
        distinct, index, owner, whole = self._distinct(texts)
        size = np.fromiter(map(self.pieces.__getitem__, distinct), np.int64, len(distinct))
        length = np.bincount(owner, size[index], len(texts)).astype(np.int64)
        for k in whole:
            length[k] = len(self.whole(texts[k].as_py())) // 4
        return length


def kept(make, *args, _made: dict = {}):  # noqa: B006  one per worker process
    """``make(*args)``, made once in a process: later tasks of a reused worker find its memos warm."""
    if _made.get("args") != (make, *args):
        _made.clear()
        _made.update(args=(make, *args), value=make(*args))
    return _made["value"]


def prove_whole_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings that, met as a pre-token of their own, encode as one token.

    Each candidate is put through the library by itself: a vocabulary entry can be unreachable by
    the merges, so membership alone proves nothing. Only strings in the shape of pre-tokens are
    kept; others are never looked up.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    parsed = json.loads(spec)
    suffix = parsed["model"].get("end_of_word_suffix") or ""
    back = {c: b for b, c in byte_letters().items()}
    found = []
    for entry in parsed["model"]["vocab"]:
        if suffix and not entry.endswith(suffix):
            continue
        core = entry[: len(entry) - len(suffix)]
        try:
            text = bytes(back[c] for c in core).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if PRE_TOKEN.fullmatch(text) and (not suffix or text == text.lower()):
            found.append(text)
    encoded = tok.encode_batch(found, add_special_tokens=False)
    return frozenset(t for t, e in zip(found, encoded, strict=True) if len(e.ids) == 1)
