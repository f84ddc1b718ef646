"""Tokens of a text as the fallback tokenizer gives them, and their hashed form for set operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

# The stop characters of the fallback tokenizer, and the limits that its SQL keeps and this one has not.
STOP = frozenset("的了是在我有和就不人都一个上也这到说他她你们这那之")
CLIP_CHARS, CLIP_HEAD, CLIP_MIDDLE, CLIP_TAIL = 12_000, 7_200, 2_400, 2_400
MAX_TOKENS = 1_500
#: Tokens of a batch that are held at once, so that long texts need no more memory than many short ones.
BATCH_TOKENS = 2_000_000

WORD = re.compile(r"[\w一-鿿]+")
CJK = re.compile(r"[一-鿿]+")


def tokenize(text: str) -> list[str]:
    """Lower-case word runs of the whole text, all-CJK runs split into characters, stop characters dropped."""
    out: list[str] = []
    for word in WORD.findall(text.lower()):
        if word.isascii():
            out.append(word)
        elif CJK.fullmatch(word):
            out.extend(c for c in word if c not in STOP)
        else:
            out.append(word)
    return out


def token_set(text: str | None) -> set[str]:
    return set(tokenize(text)) if text else set()


FEATURES = "s long, n int, sketch long, toks array<bigint>"


def _hashed(batches: Iterator[pa.RecordBatch], text: str, carry: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        flat: list[int] = []
        ends: list[int] = []
        first = 0
        if len(known) > 400_000:
            known.clear()
        for i, value in enumerate(batch.column(text).to_pylist(), 1):
            for token in token_set(value):
                h = known.get(token)
                if h is None:
                    h = known[token] = digest(token)
                flat.append(h)
            ends.append(len(flat))
            if len(flat) >= BATCH_TOKENS or i == batch.num_rows:
                yield _rows(batch.slice(first, i - first), flat, ends, carry, schema)
                flat, ends, first = [], [], i


def _rows(batch: pa.RecordBatch, flat: list[int], ends: list[int], carry: list[str], schema: pa.Schema) -> pa.RecordBatch:
    end = np.array(ends, dtype=np.int64)
    n = np.diff(end, prepend=0)
    some = n > 0
    h64 = np.array(flat, dtype=np.uint64)
    start = (end - n)[some]
    s, sketch = np.zeros(len(end), np.uint64), np.zeros(len(end), np.uint64)
    if len(h64):
        s[some] = np.add.reduceat(h64 * np.uint64(0x9E3779B97F4A7C15), start)
        sketch[some] = np.bitwise_xor.reduceat(np.uint64(1) << (h64 >> np.uint64(58)), start)
    toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(h64.view(np.int64)))
    columns = [batch.column(c) for c in carry]
    columns += [pa.array(s.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(sketch.view(np.int64)), toks]
    columns = [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def hashed_sets(df: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The columns `carry` and, of the token set of column `text`: s, its 64-bit hash; n, its size; sketch, the parity of
    its tokens in 64 slots, of which two sets differ in no more bits than they do in tokens; toks, its tokens' 64-bit hashes.

    s and sketch together tell sets apart: 128 bits, so that no two sets meet by chance in any collection.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kept = df.select(*carry, *([] if text in carry else [text]))
    out = StructType([kept.schema[c] for c in carry] + _parse_datatype_string(FEATURES).fields)
    schema = to_arrow_schema(out)
    return kept.mapInArrow(lambda it: _hashed(it, text, carry, schema), out)
