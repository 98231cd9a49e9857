"""Bringing text to one visual form with numpy over whole Arrow batches.

A batch of strings is one UTF-8 buffer. It is widened once to an array of code
points, every step then works on that array (table gathers, expansion by
offsets, stable sorts, pair look-ups), and the result is narrowed once to a
new UTF-8 buffer. No step calls a string function per row.

What is unified: character width, composed or combining accents, ligatures,
invisible characters, kinds of space and hyphen, and look-alike letters of
Cyrillic, Greek, Armenian, Cherokee and Coptic (brought to their Latin twin). What stays different: case,
accents, raised or lowered digits, font variants, any other spelling.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters that print alike, other script -> Latin.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "Ӏ": "I", "ӏ": "l", "Ү": "Y", "Ѵ": "V", "ѵ": "v", "Ꙅ": "S", "ꙅ": "s",
    "Օ": "O", "օ": "o", "Ս": "U", "ս": "u", "Տ": "S", "Լ": "L", "հ": "h", "ո": "n", "ց": "g", "յ": "j",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    "ɡ": "g",
}
# Kinds of hyphen, and invisible characters outside category Cf.
HYPHENS = "‐‑‒−﹣－⁃˗"
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
VARIATION_SELECTORS = [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]

TOP = 0x110000
WIDTH_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}


class Tables(NamedTuple):
    start: np.ndarray  # code point -> where its expansion begins in pool
    length: np.ndarray  # code point -> length of its expansion (0: dropped)
    pool: np.ndarray
    klass: np.ndarray  # canonical combining class
    pair_keys: np.ndarray  # sorted (first << 21 | second)
    pair_values: np.ndarray
    changes: np.ndarray  # code points that don't stay as they are when alone
    joins: np.ndarray  # code points that begin with a mark
    second: np.ndarray  # code points that aren't marks, but second in a composition


def _pairs() -> dict[tuple[int, int], int]:
    """Canonical compositions, from the interpreter's Unicode data and the Hangul rule."""
    pairs = {}
    for cp in range(0xA0, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(cp))
        if parts and parts[0] != "<":
            codes = [int(x, 16) for x in parts.split()]
            if len(codes) == 2 and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                pairs[codes[0], codes[1]] = cp
    for lead in range(19):
        for vowel in range(21):
            syllable = 0xAC00 + (lead * 21 + vowel) * 28
            pairs[0x1100 + lead, 0x1161 + vowel] = syllable
            for tail in range(1, 28):
                pairs[syllable, 0x11A7 + tail] = syllable + tail
    return pairs


@lru_cache(maxsize=3)
def tables(visual: bool = True, alike: bool = True) -> Tables:
    """``visual=False`` gives plain canonical composition, which tests compare with NFC; ``alike=False`` leaves every letter in its script."""
    expand: dict[int, list[int]] = {}
    for cp in range(0xA0, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(cp))
        if not parts and not 0xAC00 <= cp < 0xD7A4:
            continue
        if not parts or parts[0] != "<":
            expand[cp] = [ord(x) for x in unicodedata.normalize("NFD", chr(cp))]
        elif visual:
            tag = parts.split()[0]
            if unicodedata.category(chr(cp)) == "Zs":
                expand[cp] = [32]
            elif tag in WIDTH_TAGS or tag == "<compat>" and "LIGATURE" in unicodedata.name(chr(cp), ""):
                expand[cp] = [ord(x) for x in unicodedata.normalize("NFKD", chr(cp))]
    if visual:
        twin = {ord(a): ord(b) for a, b in LOOK_ALIKES.items()} if alike else {}
        hidden = {*map(ord, INVISIBLE), *VARIATION_SELECTORS}
        for cp in range(0xA0, sys.maxunicode + 1):
            kind = unicodedata.category(chr(cp))
            if kind == "Cf":
                hidden.add(cp)
            elif kind == "Zs":
                expand[cp] = [32]
        expand |= {cp: [] for cp in hidden} | {ord(x): [0x2D] for x in HYPHENS} | {9: [32]}
        expand |= {cp: [twin.get(x, x) for x in to] for cp, to in expand.items()}
        expand |= {cp: [to] for cp, to in twin.items() if cp not in expand}
    start, length = np.arange(TOP, dtype=np.int64), np.ones(TOP, dtype=np.int64)
    pool = [np.arange(TOP, dtype=np.uint32)]
    at = TOP
    for cp, to in expand.items():
        start[cp], length[cp] = at, len(to)
        pool.append(np.array(to, dtype=np.uint32))
        at += len(to)
    klass = np.zeros(TOP, dtype=np.uint8)
    for cp in range(0x300, 0x20000):
        klass[cp] = unicodedata.combining(chr(cp))
    pairs = sorted(((a << 21) | b, to) for (a, b), to in _pairs().items())
    keys, values = zip(*pairs)
    changes, joins, second = klass > 0, klass > 0, np.zeros(TOP, bool)
    for cp, to in expand.items():
        changes[cp] |= unicodedata.normalize("NFC", "".join(map(chr, to))) != chr(cp)
        joins[cp] |= bool(to) and klass[to[0]] > 0
    second[np.array(keys, np.int64) & 0x1FFFFF] = True
    second &= klass == 0
    return Tables(start, length, np.concatenate(pool), klass, np.array(keys, np.int64), np.array(values, np.uint32), changes, joins, second)


def compose_pairs(t: Tables, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The composed code point of each pair, 0 where there is none."""
    key = (first.astype(np.int64) << 21) | second
    at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
    return np.where(t.pair_keys[at] == key, t.pair_values[at], 0).astype(np.uint32)


def widen(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings (nulls count as empty), and where each string begins and ends."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    strings = strings.cast(pa.large_string()).fill_null("")
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + n + 1]
    raw = memoryview(data)[off[0] : off[-1]] if data is not None else memoryview(b"")
    codes = np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return codes, heads[off - off[0]]


def narrow(codes: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The reverse of widen(); ``valid`` marks the rows that aren't null."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    off = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[bounds].astype(np.int64)
    mask = None if valid is None else pa.array(valid).buffers()[1]
    made = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(data), mask)
    return made.cast(pa.string())


PORTION = 1 << 20


def portions(batches: Iterator[pa.RecordBatch], column: int, limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of one text column, so that the arrays over it stay small.

    A single longer text is a slice of its own; no text is split.
    """
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _expand(codes: np.ndarray, bounds: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The expansions of all code points that change or stand before a mark; the others stay."""
    marked = t.joins[codes]
    touched = t.changes[codes] | marked
    touched[:-1] |= marked[1:]
    at = np.flatnonzero(touched)
    if not len(at):
        return codes.copy(), bounds
    grown = t.length[codes[at]]
    count = np.ones(len(codes), np.int64)
    count[at] = grown
    ends = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(ends[-1], codes.dtype)
    out[ends[:-1][~touched]] = codes[~touched]
    within = np.arange(grown.sum()) - np.repeat(np.cumsum(grown) - grown, grown)
    out[np.repeat(ends[at], grown) + within] = t.pool[np.repeat(t.start[codes[at]], grown) + within]
    return out, ends[bounds]


def _compose_marks(out: np.ndarray, klass: np.ndarray, bounds: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Order the marks behind each base and compose them with it, the k-th mark of every run at once."""
    row_start = np.zeros(len(out) + 1, bool)
    row_start[bounds[:-1]] = True
    row_start = row_start[:-1]
    head = (klass == 0) | row_start
    run = np.cumsum(head) - 1
    if np.any((klass[1:] > 0) & (klass[:-1] > klass[1:]) & ~row_start[1:]):
        order = np.lexsort((klass, run))  # stable: equal classes keep their order
        out, klass = out[order], klass[order]
    heads, marks = np.flatnonzero(head), np.flatnonzero(~head)
    alive = np.ones(len(out), bool)
    base, nth = heads[run[marks]], marks - heads[run[marks]]
    usable = klass[base] == 0
    marks, base, nth = marks[usable], base[usable], nth[usable]
    last = np.zeros(len(out), np.uint8)  # class of the last mark that stayed, by base
    k = 1
    while len(marks):
        here = nth == k
        m, b = marks[here], base[here]
        made = compose_pairs(t, out[b], out[m])
        ok = (made > 0) & (last[b] < klass[m])
        out[b[ok]] = made[ok]
        alive[m[ok]] = False
        last[b[~ok]] = klass[m[~ok]]
        marks, base, nth = marks[~here], base[~here], nth[~here]
        k += 1
    kept = np.concatenate(([0], np.cumsum(alive)))
    return out[alive], kept[bounds]


def unify_codes(codes: np.ndarray, bounds: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Expand, order the marks and compose; rows never merge across ``bounds``."""
    out, bounds = _expand(codes, bounds, t)
    if not len(out):
        return out, bounds
    while True:
        klass = t.klass[out]
        if klass.any():
            out, bounds = _compose_marks(out, klass, bounds, t)
        # bases that compose with the next base (Hangul, some Indic vowels), and then perhaps with its marks
        b = np.flatnonzero(t.second[out])
        b = b[b > 0]
        a = b - 1
        row = np.searchsorted(bounds, b, side="right")
        near = (t.klass[out[a]] == 0) & (row == np.searchsorted(bounds, a, side="right"))
        made = np.where(near, compose_pairs(t, out[a], out[b]), 0)
        hit = made > 0
        hit[1:] &= ~(hit[:-1] & (b[:-1] == a[1:]))
        if not hit.any():
            return out, bounds
        alive = np.ones(len(out), bool)
        out[a[hit]] = made[hit]
        alive[b[hit]] = False
        kept = np.concatenate(([0], np.cumsum(alive)))
        out, bounds = out[alive], kept[bounds]


def unify_array(strings: pa.Array, visual: bool = True) -> pa.Array:
    """One consistent form of every string; null stays null, empty stays empty."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    codes, bounds = widen(strings)
    codes, bounds = unify_codes(codes, bounds, tables(visual))
    return narrow(codes, bounds, np.asarray(strings.is_valid()))
