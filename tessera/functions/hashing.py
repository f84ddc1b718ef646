"""Hashes of texts: simhash, content hashes, seeded minhash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fixed import STOP_CHARACTERS
from tessera.functions.text import bounded_tokens, stripped, tokens

BITS = 63
PERMUTATIONS, BANDS, ROWS = 128, 32, 4


#: Rows hashed at once; a signature needs half a kilobyte for each token of them.
HASHED_ROWS = 1_000


class _Digests:
    """Low 64 bits of the md5 of tokens, each computed once in a task."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, flat: pa.Array) -> np.ndarray:
        if len(self.known) > 400_000:
            self.known.clear()
        coded = flat.dictionary_encode()
        own = np.empty(len(coded.dictionary), np.uint64)
        for i, token in enumerate(coded.dictionary.to_pylist()):
            h = self.known.get(token)
            if h is None:
                h = self.known[token] = int.from_bytes(hashlib.md5(token.encode()).digest()[8:], "big")
            own[i] = h
        return own[np.asarray(coded.indices)]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Keys, all tokens and the number of tokens of each row, of the second column, in parts of HASHED_ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, HASHED_ROWS):
            part = batch.slice(at, HASHED_ROWS)
            lists = part.column(1)
            yield part.column(0), lists.flatten(), np.asarray(pc.list_value_length(lists).fill_null(0))


def _simhashes(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    digests = _Digests()
    for keys, flat, n in _each(batches):
        out, some = np.zeros(len(n), np.int64), n > 0
        if some.any():
            bits = np.unpackbits(digests.of(flat).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)[:, :BITS]
            out[some] = ((2 * ones > n[some, None]) * (np.int64(1) << np.arange(BITS))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([keys, pa.array(out)], names=names)


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash): the sign of the votes of all tokens, repeats included, in each of 63 bits of their md5; 0 without tokens.

    A function of the row alone: no shuffle. Tokens are native arrays, hashed by Arrow batches.
    """
    names = [key, "simhash"]
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tokens(F.col(text)).alias("_tokens")).mapInArrow(lambda it: _simhashes(it, names), f"`{key}` {kind}, simhash long")


def simhash_of(text: str) -> int:
    """The simhash of one text, for query parameters."""
    votes = [0] * BITS
    for word in re.findall(r"[\w一-鿿]+", text.lower()):
        for token in [c for c in word if c not in STOP_CHARACTERS] if re.fullmatch("[一-鿿]+", word) else [word]:
            h = int(hashlib.md5(token.encode()).hexdigest(), 16)
            votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
    return sum(1 << i for i, v in enumerate(votes) if v > 0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def content_hash(c: Column) -> Column:
    return F.sha2(stripped(c), 256)


# A date or time counts only between characters that are no word characters, in any script.
EDGE_LEFT, EDGE_RIGHT = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
DATE = EDGE_LEFT + r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?" + EDGE_RIGHT
TIME = EDGE_LEFT + r"\d{1,2}:\d{2}(?::\d{2})?" + EDGE_RIGHT


def normalised(c: Column) -> Column:
    """The text without links, dates and times, in lower case, with single blanks."""
    bare = F.regexp_replace(c, r"(?i)https?://[^\s\p{Z}]+", "")
    for pattern in (DATE, DATE, TIME, TIME):  # twice, as two may share the character between them
        bare = F.regexp_replace(bare, pattern, "$1$2")
    return F.lower(stripped(F.regexp_replace(bare, r"[\s\p{Z}]+", " ")))


def normalised_hash(c: Column) -> Column:
    return F.substring(F.sha2(normalised(c), 256), 1, 16)


#: Hash functions (a * h + b) mod P of 28-bit token hashes; products stay below 2^59, so that any engine computes the same.
P = (1 << 31) - 1
SEEDS = [(pow(48_271, 2 * i + 1, P), pow(16_807, 2 * i + 2, P)) for i in range(PERMUTATIONS)]


def _signed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    digests = _Digests()
    a, b = (np.array(x, np.int64) for x in zip(*SEEDS))
    for keys, flat, n in _each(batches):
        some = n > 0
        if not some.any():
            continue
        h = (digests.of(flat) & np.uint64((1 << 28) - 1)).astype(np.int64)
        start = (np.cumsum(n) - n)[some]
        least = np.empty((int(some.sum()), PERMUTATIONS), np.int64)
        for i in range(PERMUTATIONS):
            least[:, i] = np.minimum.reduceat((h * a[i] + b[i]) % P, start)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, PERMUTATIONS, dtype=np.int32)), pa.array(least.ravel()))
        yield pa.RecordBatch.from_arrays([keys.filter(pa.array(some)), lists], names=names)


def signatures(sets: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, signature): minhash of the bounded tokens under PERMUTATIONS fixed hash functions; no row without tokens.

    A function of the row alone: no shuffle.
    """
    names = [key, "signature"]
    kind = sets.schema[key].dataType.simpleString()
    bounded = sets.select(key, F.array_distinct(bounded_tokens(F.col(tokens))).alias("_tokens"))
    return bounded.mapInArrow(lambda it: _signed(it, names), f"`{key}` {kind}, signature array<bigint>")


def _banded(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    digests = _Digests()
    a, b = (np.array(x, np.int64) for x in zip(*SEEDS))
    odd = np.uint64(0x9E3779B97F4A7C15)
    for keys, flat, n in _each(batches):
        some = n > 0
        if not some.any():
            continue
        full = digests.of(flat)
        h = (full & np.uint64((1 << 28) - 1)).astype(np.int64)
        start = (np.cumsum(n) - n)[some]
        sketch = np.bitwise_xor.reduceat(np.uint64(1) << (full >> np.uint64(58)), start)
        band = np.empty((len(start), BANDS), np.uint64)
        for i in range(BANDS):
            mixed = np.full(len(start), i + 1, np.uint64) * odd
            for j in range(i * ROWS, (i + 1) * ROWS):
                mixed = (mixed ^ np.minimum.reduceat((h * a[j] + b[j]) % P, start).astype(np.uint64)) * odd
                mixed ^= mixed >> np.uint64(29)
            band[:, i] = mixed
        each = np.repeat(np.flatnonzero(some), BANDS)
        columns = [pa.array(band.ravel().view(np.int64)), keys.take(pa.array(each)), pa.array(n[each].astype(np.int32)), pa.array(np.repeat(sketch, BANDS).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def banded_sets(sets: DataFrame, key: str, tokens: str) -> DataFrame:
    """(h, key, n, sketch): a row for each minhash band of all tokens, with the size of the set and the parity of its tokens in
    64 slots, in which two sets differ in no more slots than tokens. h is a hash of the band's number and its ROWS values.
    """
    names = ["h", key, "n", "sketch"]
    kind = sets.schema[key].dataType.simpleString()
    return sets.select(key, tokens).mapInArrow(lambda it: _banded(it, names), f"h long, `{key}` {kind}, n int, sketch long")


def bands(signature: Column) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), F.slice(signature, b * ROWS + 1, ROWS)) for b in range(BANDS)])
