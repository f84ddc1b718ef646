"""Exact candidate keys for set similarity: a universe partition with pigeonhole guarantees.

Two sets of sizes a and b with Jaccard similarity t or more differ in at most U = (1-t)/(1+t)(a+b) tokens. The token
universe is hashed into m segments, each segment i being worth v_i: 1 if it is indexed by its exact subset, 2 if by the
subset and all its one-deletion neighbours, so that it is found unless v_i tokens or more of it differ. If the v_i sum
to U+1+k, a pair of similar sets shares keys worth more than k. Each set may therefore leave out its k most common
exact segments: of the segments that a pair shares, the rarest cannot be among those that either side leaves out.
Rarity is a total order on (information, key), a function of the segment's content alone, so both sides agree on it.

Sizes are cut into bands, each with its own m; a set takes part in every band that a similar set of at least its size
can lie in. `allocate` picks, for each band, the number of two-worth segments and the slack k by estimated cost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

BAND_RATIO = 1.25
#: No array is longer than this: bands reach as far as any set can.
MAX_SIZE = (1 << 31) - 1
SLOTS = 1 << 16
UNIT = 16  # steps a bit of information
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Threshold:
    """A similarity threshold num/den."""

    num: int = 4
    den: int = 5

    def differing(self, total):
        """The most tokens that two similar sets with `total` tokens together can differ in."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest(self, size):
        """The largest set that can be similar to one of `size` tokens."""
        return size * self.den // self.num


@dataclass(frozen=True)
class Bands:
    """lo, hi: sizes of each band's larger sets; m: segments; p: how many of them are worth two; bits: a token slot's information."""

    lo: np.ndarray
    hi: np.ndarray
    m: np.ndarray
    p: np.ndarray
    bits: np.ndarray
    threshold: Threshold
    #: In a self-join the larger set of a pair names the band; else the indexed set does, whichever is larger.
    self_join: bool


def edges() -> list[int]:
    out = [1]
    while out[-1] <= MAX_SIZE:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


def _cost(n: float, size: float, u: int, p: int, k: int, q: float) -> float:
    """Estimated microseconds for n sets: rows emitted and accidental pairs, from the chance q that two tokens are the same."""
    m = u + 1 + k - p
    rest = m - p
    lam = size / m
    pmf = [math.exp(-lam)]
    for j in range(1, 40):
        pmf.append(pmf[-1] * lam / j)
    meet = [min(1.0, math.factorial(j) * min(1.0, q * m) ** j) for j in range(40)]  # the chance that j tokens of a segment are the same
    rows = (u + 1 - 2 * p) + p * (lam + 1) if u + 1 > 2 * p else p * (lam + 1)
    pairs, skip = 0.0, (k / rest if rest else 0.0)
    for j in range(39):
        left = max(0.0, pmf[j] - skip)
        skip = max(0.0, skip - pmf[j])
        pairs += rest * left * meet[j] * pmf[j] * n
        # Of two sets that meet in a neighbourhood, either may hold one token more.
        near = meet[j] * (pmf[j] + (j + 1) * pmf[j + 1])
        pairs += p * near * (pmf[j] + (j + 1) * pmf[j + 1]) * n
    return n * (2.0 * rows + 0.05 * pairs)


def allocate(sizes: dict[int, int], df: np.ndarray, threshold: Threshold, self_join: bool) -> Bands:
    """Bands with the cheapest allocation, from the number of sets of each size and the tokens counted in SLOTS slots."""
    total, count = float(df.sum()) or 1.0, max(1, sum(sizes.values()))
    q = float((df.astype(np.float64) ** 2).sum()) / total**2
    bits = np.clip(np.round(UNIT * np.log2(count / np.maximum(df, 1.0))), 1, 10 * UNIT).astype(np.float64)
    cut = edges()
    lo, hi, ms, ps = [], [], [], []
    for a, b in zip(cut, cut[1:]):
        largest = b - 1 if self_join else threshold.largest(b - 1)
        u = int(threshold.differing(b - 1 + largest))
        n = sum(c for s, c in sizes.items() if math.ceil(a * threshold.num / threshold.den) <= s < b)
        options = [
            (_cost(max(n, 1), 0.9 * b, u, p, k, q), p, k)
            # Segments worth two pay only where all are: they are twice as large then, so that few hold a token or none.
            for p, k in [(0, k) for k in range(min(9, u + 2))] + [(u // 2 + 1, (u + 1) % 2)]
        ]
        _, p, k = min(options)
        lo.append(a), hi.append(b), ms.append(u + 1 + k - p), ps.append(p)
    return Bands(*(np.array(x, dtype=np.int64) for x in (lo, hi, ms, ps)), bits, threshold, self_join)


def membership(bands: Bands, n: np.ndarray, index: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which set takes part in which band, and the most tokens it can differ in from its partners there.

    In a self-join both sides are alike. Else the indexed sets (index=True) lie in the band of their own size only, and
    the queries in each band with sets that can be similar to them.
    """
    t = bands.threshold
    n = np.minimum(n, MAX_SIZE).astype(np.int64)
    own = np.searchsorted(bands.hi, n, side="right")
    most = t.largest(n)
    last = np.searchsorted(bands.hi, most, side="right")
    if bands.self_join:
        first, span = own, last - own + 1
    elif index:
        first, span = own, np.ones(len(n), np.int64)
    else:
        least = -(-n * t.num // t.den)
        first = np.searchsorted(bands.hi, least, side="right")
        span = last - first + 1
    first, span = np.where(n > 0, first, 0), np.where(n > 0, span, 0)
    rec = np.repeat(np.arange(len(n)), span)
    band = np.arange(len(rec)) - np.repeat(np.cumsum(span) - span, span) + np.repeat(first, span)
    keep = band < len(bands.hi)
    rec, band = rec[keep], band[keep]
    partner = most[rec] if index and not bands.self_join else np.minimum(bands.hi[band] - 1, most[rec])
    return rec, band, t.differing(n[rec] + partner)


def rows_of(bands: Bands, sizes: dict[int, int], index: bool = True) -> int:
    """About how many rows `emit` gives for so many sets of each size."""
    n = np.array(list(sizes), dtype=np.int64)
    rec, band, u = membership(bands, n, index)
    p = bands.p[band]
    each = p + np.maximum(0, u + 1 - 2 * p) + np.where(p > 0, n[rec], 0)
    return int((each * np.array(list(sizes.values()), dtype=np.int64)[rec]).sum())


def emit(bands: Bands, toks: np.ndarray, ends: np.ndarray, n: np.ndarray, index: bool = True) -> tuple[np.ndarray, ...]:
    """(set number, key, band, step) rows of a batch of sets given as flat 32-bit tokens; two similar sets share at least one key.

    step numbers a set's keys in a band from the rarest on, 0 also for the neighbourhoods of segments worth two.
    """
    rec, band, u = membership(bands, n, index)
    if not len(rec):
        return (np.zeros(0, np.int64),) * 4
    starts, counts = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
    m, p = bands.m[band], bands.p[band]
    base = np.cumsum(m) - m
    total = int(m.sum())
    count = counts[rec]
    pair = np.repeat(np.arange(len(rec)), count)
    token = toks[np.arange(len(pair)) + np.repeat(starts[rec] - (np.cumsum(count) - count), count)].astype(np.uint64)
    spread = mix(token * _A + (band[pair].astype(np.uint64) + np.uint64(1)) * _D)
    segment = ((spread >> np.uint64(32)) % m[pair].astype(np.uint64)).astype(np.int64)
    content = (mix(token + _D) >> np.uint64(22)).astype(np.float64)  # 42 bits: sums stay exact
    cell = base[pair] + segment
    subset = np.bincount(cell, weights=content, minlength=total)
    weight = np.bincount(cell, weights=bands.bits[(token & np.uint64(SLOTS - 1)).astype(np.int64)], minlength=total)
    of = np.repeat(np.arange(len(rec)), m)
    place = np.arange(total) - np.repeat(base, m)

    def key(sums: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        salt = at.astype(np.uint64) * _B + (band[which].astype(np.uint64) + np.uint64(1)) * _C
        return mix(sums.astype(np.uint64) * _A + salt)

    keys = key(subset, place, of)
    # Rank each set's exact segments from rare to common; those worth two come first and are never left out.
    rare = np.where(place < p[of], 0, 65_535 - np.minimum(weight, 65_534).astype(np.int64)).astype(np.uint64)
    order = np.argsort((of.astype(np.uint64) << np.uint64(32)) | (rare << np.uint64(16)) | (keys >> np.uint64(48)), kind="stable")
    rank = np.empty(total, np.int64)
    rank[order] = place  # the sort keeps sets apart, so places and ranks run over the same numbers
    kept = rank < (p + np.maximum(0, u + 1 - 2 * p))[of]
    out = [rec[of[kept]], keys[kept], band[of[kept]], np.maximum(0, rank - p[of])[kept]]
    two = segment < p[pair]
    if two.any():
        shorter = key(subset[cell[two]] - content[two], segment[two], pair[two])
        near = [rec[pair[two]], shorter, band[pair[two]], np.zeros(len(shorter), np.int64)]
        out = [np.concatenate(x) for x in zip(out, near)]
    return out[0], out[1].view(np.int64), out[2], out[3]
