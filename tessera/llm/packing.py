"""Problem 6: filling fixed-capacity containers with documents sized in tokens of a public tokenizer.

Method: pattern packing by non-negative least squares. Patterns of few documents whose lengths nearly fill a container
are enumerated; their repeat counts are fitted to the histogram of lengths, rounded down and cut to what is there; the
residual documents are packed by best fit, again in whole patterns with repeat counts. A document is split only where it
exceeds the capacity: into full pieces, each a container of its own, and a last piece that is packed like a document.

Scale: documents are tokenized once and numbered within their task and length; all that reaches the driver is the
histogram (one number for each length up to the capacity), and all that is broadcast is the plan, a few intervals of
numbers for each length. A document's number among those of its length is its task's offset and its own, so that no
task ever gathers the documents of a common length. The offsets, a row for each length in each task, grow with the number
of tasks and are joined by a shuffle, never broadcast.

Defined results: a null or empty document has 0 tokens, takes one place and counts as one token in packing; repeated
documents are packed as often as they occur; an empty table gives no containers. max_items null means no limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import materialise

#: The default rank file; its folder is a parameter of `pack`.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Patterns tried for each length: partners near the best fit, and second members to build on.
NEAR, SECONDS = 2, 4
FIT_ROUNDS = 150
SIZED = "spec_no int, doc_id long, tokens long, full long, rest int, part int, nth long, nth_full long"
PLACED = "spec_no int, doc_id long, piece int, tokens long, container_id long"


def counter(folder: str = TOKENIZERS, ranks: str = RANKS):
    """A function that counts the tokens of a text."""
    import tiktoken

    with open(f"{folder}/{ranks}", "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def _sized(batches: Iterator[pa.RecordBatch], capacities: list[int], folder: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    count = counter(folder)
    seen = [np.zeros(c + 1, np.int64) for c in capacities]
    seen_full = [0] * len(capacities)
    for batch in batches:
        ids = batch.column("doc_id")
        n = np.array([count(t) for t in batch.column("text").to_pylist()], dtype=np.int64)
        for spec, capacity in enumerate(capacities):
            size = np.maximum(n, 1)
            full = (size - 1) // capacity
            rest = (size - full * capacity).astype(np.int64)
            order = np.argsort(rest, kind="stable")
            ordered = rest[order]
            begin = np.searchsorted(ordered, ordered, "left")
            nth = np.empty(len(rest), np.int64)
            nth[order] = np.arange(len(rest)) - begin
            nth += seen[spec][rest]
            seen[spec] += np.bincount(rest, minlength=capacity + 1)
            nth_full = seen_full[spec] + np.cumsum(full) - full
            seen_full[spec] += int(full.sum())
            columns = [np.full(len(n), spec, np.int32), ids, n, full, rest.astype(np.int32), np.full(len(n), part, np.int32), nth, nth_full]
            names = ["spec_no", "doc_id", "tokens", "full", "rest", "part", "nth", "nth_full"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def patterns_of(lengths: np.ndarray, capacity: int, most: int) -> list[tuple[int, ...]]:
    """Patterns of one to four of the lengths (ascending) that nearly fill the capacity."""
    out: set[tuple[int, ...]] = set()

    def fitting(gap: int) -> list[int]:
        at = int(np.searchsorted(lengths, gap, "right"))
        return [int(x) for x in lengths[max(0, at - NEAR) : at]]

    seconds = lengths[np.linspace(0, len(lengths) - 1, min(SECONDS, len(lengths))).astype(int)].tolist()
    for a in lengths.tolist():
        tight = max(1, (capacity - a) // 100)
        if capacity - a <= tight:
            out.add((a,))
        if most >= 2:
            out.update(tuple(sorted((a, b))) for b in fitting(capacity - a))
        half, third = (capacity - a) // 2, (capacity - a) // 3
        if most >= 3 and capacity - a > 2:
            for b in {*seconds, *fitting(half)}:
                if a + b < capacity:
                    out.update(tuple(sorted((a, b, c))) for c in fitting(capacity - a - b)[-1:])
        if most >= 4 and capacity - a > 3:
            for b in fitting(third)[-1:]:
                for c in fitting(third)[-1:]:
                    if a + b + c < capacity:
                        out.update(tuple(sorted((a, b, c, d))) for d in fitting(capacity - a - b - c)[-1:])
    # Only patterns that leave little room: the fit then cannot buy a close histogram with waste.
    return sorted(p for p in out if capacity - sum(p) <= max(1, capacity // 50))


def repeats(patterns: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative least squares of the patterns to the histogram, by accelerated projected gradients."""
    row = np.array([x for p in patterns for x in p])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    size = len(histogram)
    apply = lambda x: np.bincount(row, weights=x[col], minlength=size)
    back = lambda r: np.bincount(col, weights=r[row], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(15):
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(apply(y) - histogram) / (norm * 1.01))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, capacity: int, max_items: int | None) -> list[tuple[dict[int, int], int]]:
    """(lengths with their multiplicity, repeat count) of each pattern; together they use up the histogram exactly."""
    most = max_items or capacity
    left = histogram.astype(np.int64).copy()
    lengths = np.flatnonzero(left)
    out: list[tuple[dict[int, int], int]] = []
    few = patterns_of(lengths, capacity, most) if len(lengths) else []
    if few:
        fitted = repeats(few, left.astype(float))
        for i in np.argsort(-fitted, kind="stable"):
            if fitted[i] < 1:
                break
            members: dict[int, int] = {}
            for x in few[i]:
                members[x] = members.get(x, 0) + 1
            times = min(int(fitted[i]), *(int(left[x]) // m for x, m in members.items()))
            if times:
                for x, m in members.items():
                    left[x] -= m * times
                out.append((members, times))
    # Best fit for the rest, again in patterns: the longest first, then whatever fills the gap best.
    present = np.flatnonzero(left).tolist()
    import bisect

    while present:
        members, gap, items, limit = {}, capacity, 0, len(present)
        while limit and items < most:
            at = bisect.bisect_right(present, gap, 0, limit) - 1
            if at < 0:
                break
            x = present[at]
            take = min(int(left[x]), gap // x, most - items)
            if most - items < len(present) and items:
                take = min(take, 1)  # places are scarce: choose anew after each
            members[x] = take
            gap, items, limit = gap - take * x, items + take, at
        times = min(int(left[x]) // m for x, m in members.items())
        for x, m in members.items():
            left[x] -= m * times
            if not left[x]:
                present.pop(bisect.bisect_left(present, x))
        out.append((members, times))
    return out


@dataclass
class Places:
    """For one spec: at which number of which length which container begins."""

    start: np.ndarray  # length << 40 | first number, ascending
    container: np.ndarray
    each: np.ndarray
    containers: int

    @classmethod
    def of(cls, patterns: list[tuple[dict[int, int], int]]) -> Places:
        used: dict[int, int] = {}
        rows, first = [], 0
        for members, times in patterns:
            for x, m in members.items():
                rows.append(((x << 40) | used.get(x, 0), first, m))
                used[x] = used.get(x, 0) + m * times
            first += times
        rows.sort()
        start, container, each = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        return cls(start, container, each, first)

    def find(self, length: np.ndarray, number: np.ndarray) -> np.ndarray:
        key = (length.astype(np.int64) << 40) | number
        at = np.searchsorted(self.start, key, "right") - 1
        return self.container[at] + (key - self.start[at]) // self.each[at]


def _place(batches: Iterator[pa.RecordBatch], places: list[Places], capacities: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        for spec in np.unique(get("spec_no")).tolist():
            mine = np.flatnonzero(get("spec_no") == spec)
            tokens, full, rest = (get(c)[mine] for c in ("tokens", "full", "rest"))
            container = places[spec].find(rest, get("number")[mine])
            of = np.repeat(np.arange(len(mine)), full)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
            whole = places[spec].containers + get("number_full")[mine][of] + piece
            columns = [
                np.full(len(mine) + len(of), spec, np.int32),
                batch.column("doc_id").take(pa.array(np.concatenate([mine, mine[of]]))),  # may be null
                np.concatenate([full, piece]).astype(np.int32),
                np.concatenate([tokens - full * capacities[spec], np.full(len(of), capacities[spec])]).astype(np.int64),
                np.concatenate([container, whole]).astype(np.int64),
            ]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=["spec_no", "doc_id", "piece", "tokens", "container_id"])


def pack(documents: DataFrame, specs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(spec, doc_id, piece, tokens, container_id) of (doc_id, text) for each row of (spec, capacity_tokens, max_items).

    A container never holds more than its capacity or max_items pieces; pieces are numbered from 0 in text order, and
    all but the last of a split document are capacity_tokens long.
    """
    spark = documents.sparkSession
    sizes = specs.select("spec", "capacity_tokens", "max_items").filter("capacity_tokens > 0").distinct()
    wanted = sizes.orderBy("spec", "capacity_tokens", "max_items").collect()  # a stated set
    if not wanted:
        return spark.createDataFrame([], "spec string, doc_id long, piece int, tokens long, container_id long")
    capacities = [r.capacity_tokens for r in wanted]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = materialise(docs.mapInArrow(lambda it: _sized(it, capacities, folder), SIZED), "sized")
    counts = materialise(sized.groupBy("spec_no", "rest", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    places = []
    histograms = [np.zeros(c + 1, np.int64) for c in capacities]
    for r in counts.groupBy("spec_no", "rest").agg(F.sum("n").alias("n")).collect():  # a number for each length
        histograms[r.spec_no][r.rest] = r.n
    for histogram, r in zip(histograms, wanted):
        places.append(Places.of(plan(histogram, r.capacity_tokens, r.max_items)))
    before = F.sum("n").over(Window.partitionBy("spec_no", "rest").orderBy("part")) - F.col("n")
    fulls = sized.groupBy("spec_no", "part").agg(F.sum("full").alias("n_full"))
    before_full = F.sum("n_full").over(Window.partitionBy("spec_no").orderBy("part")) - F.col("n_full")
    fulls = fulls.withColumn("before_full", before_full).drop("n_full")
    offsets = counts.withColumn("before", before).drop("n").join(fulls.hint("merge"), ["spec_no", "part"])
    numbered = sized.join(offsets.hint("merge"), ["spec_no", "rest", "part"])
    numbered = numbered.withColumns({"number": F.col("nth") + F.col("before"), "number_full": F.col("nth_full") + F.col("before_full")})
    shared = spark.sparkContext.broadcast((places, capacities))
    columns = ["spec_no", "doc_id", "tokens", "full", "rest", "number", "number_full"]
    placed = numbered.select(*columns).mapInArrow(lambda it: _place(it, *shared.value), PLACED)
    names = F.create_map(*[F.lit(x) for i, r in enumerate(wanted) for x in (i, r.spec)])
    return placed.select(names[F.col("spec_no")].alias("spec"), "doc_id", "piece", "tokens", "container_id")


def summary(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Of each spec: containers, pieces, tokens, the share of all room that is used, and the fewest containers any packing needs."""
    each = packed.groupBy("spec", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    total = each.groupBy("spec").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("pieces"), F.sum("tokens").alias("tokens"),
        F.max("items").alias("most_items"), F.max("tokens").alias("most_tokens"),
    )
    bound = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return total.join(specs.select("spec", "capacity_tokens"), "spec").select(
        "spec", "containers", "pieces", "tokens", "most_items", "most_tokens",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"), bound.alias("least_containers"),
    )
