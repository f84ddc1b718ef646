"""Problem 7: evaluation texts leaking into training text, by greedy string tiling.

Method: windows of the shortest counted passage (12 words, or 20 characters in Chinese texts) of all items are the
seeds. Every document is hashed window by window (Karp-Rabin, whole batches at once) and joined with them; seeds on one
diagonal are grown to maximal matches, which are checked unit by unit. The longest match is marked first, in the document
and in the item; a match that another has covered in part is cut to what is free in both, and its pieces wait for their
turn by their length. So each unit of either text is in one tile at most: a passage that the document holds once covers
only one of its places in the item. A document leaks an item when the tiles hold a third of the item's units or more,
whatever their order. Every tile is part of an unbroken match of the least length, whatever is left of it.

Units are words, numbers and CJK characters in lower case; line breaks, punctuation, quote marks and markup are none.

Scale: the items are a stated query set. They are read in blocks of bounded size, each broadcast to one pass over the
documents, without a shuffle; every document is read whole. With the 240 items of the fixed table there is one block.

Defined results: null and empty documents leak nothing; an item without units is never leaked; items with equal texts
are reported each; repeated documents are reported as often as they occur.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vec import Units, chunks, rolling

MIN_WORDS, MIN_CHARACTERS = 12, 20
SHARE = (1, 3)
#: Characters of items in a block: its table of seeds takes about 30 bytes for each.
BLOCK_CHARS = 4_000_000
MIN_BITS = 20
LEAK = "doc_id long, item_id long, matched int, units int"


class Items:
    """The seeds of a block of items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        units = Units([t or "" for _, t in rows])
        ends = np.cumsum(units.n)
        self.h = [units.h[e - n : e] for n, e in zip(units.n, ends)]
        chinese = np.bincount(units.doc, weights=units.cjk, minlength=len(rows)) * 2 > units.n
        self.least = np.where(chinese, MIN_CHARACTERS, MIN_WORDS)
        self.tables = {}
        for size in (MIN_WORDS, MIN_CHARACTERS):
            of = np.flatnonzero(self.least == size)
            seeds = [(rolling(self.h[i], size), i) for i in of]
            if not any(len(s) for s, _ in seeds):
                continue
            key = np.concatenate([s for s, _ in seeds])
            item = np.concatenate([np.full(len(s), i) for s, i in seeds])
            place = np.concatenate([np.arange(len(s)) for s, _ in seeds])
            order = np.argsort(key, kind="stable")
            shift = np.uint64(64 - max(MIN_BITS, int(len(key) * 8).bit_length()))  # an eighth of the filter at most is set
            present = np.zeros(1 << (64 - int(shift)), bool)
            present[(key >> shift).astype(np.int64)] = True
            self.tables[size] = key[order], item[order], place[order], present, shift


def matches(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, doc place, item place) of the maximal matches of `least` units or more, from seeds at doc i, item j."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i - j) != 0) | (np.diff(i) != 1)
    begin = np.flatnonzero(new)
    run = np.diff(begin, append=len(i)) + least - 1
    rows = zip(run.tolist(), i[begin].tolist(), j[begin].tolist())
    return [(n, d, q) for n, d, q in rows if np.array_equal(doc[d : d + n], item[q : q + n])]


def tiles(found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """The (length, doc place, item place) tiles of the matches with an item of `size` units, longest first, none overlapping."""
    if len(found) == 1:
        return found
    first = min((d for _, d, _ in found), default=0)
    in_doc = np.zeros(max((d + n for n, d, _ in found), default=0) - first, bool)
    in_item = np.zeros(size, bool)
    queue = [(-n, q, d) for n, d, q in found]
    heapq.heapify(queue)
    out = []
    while queue:
        n, q, d = heapq.heappop(queue)
        taken = in_doc[d - first : d - first - n] | in_item[q : q - n]
        if not taken.any():
            in_doc[d - first : d - first - n] = in_item[q : q - n] = True
            out.append((-n, d, q))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):  # what is free in both
            heapq.heappush(queue, (start - stop, q + start, d + start))
    return out


def scan(texts: list[str], items: Items) -> list[tuple[int, int, int, int]]:
    """(text number, item number, matched units, units) of each leak in a batch of texts."""
    units = Units(texts)
    hits = []
    for size, (key, item, place, present, shift) in items.tables.items():
        windows = rolling(units.h, size)
        if not len(windows):
            continue
        at = np.flatnonzero(present[(windows >> shift).astype(np.int64)])
        at = at[units.doc[at] == units.doc[at + size - 1]]
        low, high = np.searchsorted(key, windows[at], "left"), np.searchsorted(key, windows[at], "right")
        count = high - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        seed = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        where = np.repeat(at, count)
        hits.append((units.doc[where], item[seed], where, place[seed]))
    if not hits:
        return []
    doc, item, where, place = (np.concatenate(x) for x in zip(*hits))
    pair = doc * len(items.ids) + item
    order = np.argsort(pair, kind="stable")
    out = []
    for group in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
        if not len(group):
            continue
        d, q = int(doc[group[0]]), int(item[group[0]])
        found = matches(units.h, items.h[q], where[group], place[group], int(items.least[q]))
        matched = sum(n for n, _, _ in tiles(found, len(items.h[q])))
        if matched * SHARE[1] >= len(items.h[q]) * SHARE[0]:
            out.append((d, q, matched, len(items.h[q])))
    return out


def _scan(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = []
        for part in chunks([len(t) for t in texts]):
            rows += [(ids[part.start + d], items.ids[q], m, n) for d, q, m, n in scan(texts[part], items)]
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "matched", "units"])


def leaks(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, matched, units): each document of (doc_id, text) and item of (item_id, text) it leaks."""
    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-total // block_chars)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    out = spark.createDataFrame([], LEAK)
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about block_chars characters
        shared = spark.sparkContext.broadcast(Items([(r.item_id, r.text) for r in rows]))
        found = docs.mapInArrow(lambda it, shared=shared: _scan(it, shared.value), LEAK)
        out = found if blocks == 1 else out.unionByName(found)
    return out
