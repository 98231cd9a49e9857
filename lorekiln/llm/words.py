"""Words of whole Arrow batches as numpy arrays: spans, rows and 64-bit keys."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .codepoints import TOP, tables, unify_codes, widen

SPACE, OTHER, WORD, MARK, SOLO = 0, 1, 2, 3, 4
#: Scripts written without blanks; each of their letters is a word of its own.
UNSPACED = [(0x0E00, 0x0E80), (0x0E80, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x32000)]
P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its class, its lower-case code point, and its letter without marks (lower case)."""
    kind = np.full(TOP, OTHER, np.uint8)
    lower, bare = np.arange(TOP, dtype=np.uint32), np.arange(TOP, dtype=np.uint32)
    for cp in range(0x32000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        category = unicodedata.category(c)
        if category[0] in "LN":
            kind[cp] = WORD
        elif category[0] == "M":
            kind[cp] = MARK
        elif c.isspace():
            kind[cp] = SPACE
        if category == "Lu":
            lower[cp] = ord(c.lower()[0])
        if kind[cp] == WORD and cp > 0x7F and not 0xAC00 <= cp < 0xD7A4:
            first = unicodedata.normalize("NFD", c.lower())[0]
            bare[cp] = ord({"ł": "l", "đ": "d", "ø": "o"}.get(first, first))
        else:
            bare[cp] = lower[cp]
    for a, b in UNSPACED:
        kind[a:b] = np.where(kind[a:b] == WORD, SOLO, kind[a:b])
    return kind, lower, bare


def unified(texts: pa.Array, alike: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in their consistent form (letters in their own script if not ``alike``), with the rows' bounds."""
    codes, bounds = widen(texts)
    return unify_codes(codes, bounds, tables(True, alike))


def spans(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of every word: runs of letters, digits and marks; solo letters apart."""
    kind = classes()[0][codes]
    inside = kind >= WORD
    begins = np.zeros(len(codes) + 1, bool)
    begins[bounds] = True
    begins = begins[:-1]
    before = np.concatenate(([OTHER], kind[:-1])) if len(kind) else kind
    begins = inside & (begins | (before < WORD) | (kind == SOLO) | ((before == SOLO) & (kind != MARK)))
    # a mark after a solo letter belongs to it, but a plain letter after that mark starts anew
    start = np.flatnonzero(begins)
    stop = np.flatnonzero(begins | ~inside)
    stop = np.append(stop, len(codes))
    end = stop[np.searchsorted(stop, start, side="right")] if len(start) else start
    row = np.searchsorted(bounds, start, side="right") - 1
    return start, np.minimum(end, bounds[np.minimum(row + 1, len(bounds) - 1)]), row


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse up to the n-th, kept between batches."""
    if len(_POWERS[0]) <= n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n + n // 4, x, np.uint64))), dtype=np.uint64) for x in (P, P_INVERSE)]
    return _POWERS[0], _POWERS[1]


def keys(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each code-point range: a polynomial by prefix sums, modulo 2^64, then mixed."""
    power, back = powers(len(codes))
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)))
        key = (total[end] - total[start]) * back[start]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(32))


def texts_of(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The ranges as strings; meant for few, distinct ranges."""
    whole = codes.astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]
