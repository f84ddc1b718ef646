"""Texts as arrays: whole batches are cut into hashed units (words, numbers, CJK characters) without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

OTHER, WORD, CJK, SYMBOL = 0, 1, 2, 3
#: Characters handled at once; arrays of some 60 bytes a character are held for them.
CHUNK_CHARS = 1_000_000
_B = np.uint64(0x9E3779B97F4A7C15)
NUMBER = np.uint64(0x0123456789ABCDEF)  # what any number hashes to where numbers are masked


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character of the basic plane: its kind, whether it is a digit, and a hash of its lower case."""
    kind, digit, low = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, bool), np.arange(1 << 16, dtype=np.uint64)
    for c in range(33, 1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if 0x3400 <= c <= 0x9FFF or 0x3040 <= c <= 0x30FF or 0xF900 <= c <= 0xFAFF:
            kind[c] = CJK
        elif ch.isalnum():
            kind[c] = WORD
            digit[c] = ch.isdigit()
        elif not ch.isspace():
            kind[c] = SYMBOL
        lower = ch.lower()
        if len(lower) == 1 and ord(lower) < 1 << 16:
            low[c] = ord(lower)
    return kind, digit, mix(low + np.uint64(77))


class Units:
    """h: hash of each unit; doc: its text; at: its first character's offset in that text; cjk; n: units of each text."""

    def __init__(self, texts: list[str], symbols: str = "", mask_numbers: bool = False):
        kind, digit, hashed = tables()
        if symbols:
            kind = kind.copy()
            kind[kind == SYMBOL] = OTHER
            kind[[ord(c) for c in symbols]] = CJK  # units of one character, like these
        else:
            kind = np.where(kind == SYMBOL, OTHER, kind)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        wide = points > 0xFFFF
        kinds = kind[np.where(wide, 0, points)]
        if wide.any():
            kinds[(points >= 0x20000) & (points < 0x40000)] = CJK
            points = np.where(wide, (points & 0x3FFF) + 0x4E00, points)
        starts = np.cumsum(lengths) - lengths
        at = np.flatnonzero(kinds)
        k = kinds[at]
        first = np.ones(len(at), bool)
        first[1:] = (k[1:] == CJK) | (k[:-1] == CJK) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(first)
        self.docs = len(texts)
        if not len(begin):
            self.h, self.doc, self.at, self.cjk = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
            self.n = np.zeros(len(texts), np.int64)
            return
        size = np.diff(begin, append=len(at))
        place = np.arange(len(at)) - np.repeat(begin, size)
        power = np.ones(int(size.max()), np.uint64)
        power[1:] = _B
        h = np.add.reduceat(hashed[points[at]] * np.cumprod(power)[place], begin)
        if mask_numbers:
            number = np.logical_and.reduceat(digit[points[at]], begin)
            h = np.where(number, NUMBER, h)
        self.h = mix(h)
        self.cjk = k[begin] == CJK
        self.doc = np.searchsorted(starts, at[begin], side="right") - 1
        self.at = at[begin] - starts[self.doc]
        self.n = np.bincount(self.doc, minlength=len(texts))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n units, by doubling."""
    out, done, window, size = None, 0, h, 1
    base = _B
    count = max(0, len(h) - n + 1)
    left = n
    while left:
        if left & 1:
            part = window[done : done + count]
            out = part if out is None else out * base + part
            done += size
        left >>= 1
        if left:
            window = window[: len(window) - size] * base + window[size:] if len(window) > size else window[:0]
            base = np.uint64(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF)
            size *= 2
    return mix(out) if out is not None else h[:0]


def chunks(lengths: list[int], most: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of consecutive texts of about `most` characters together; a longer text is a slice of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))
