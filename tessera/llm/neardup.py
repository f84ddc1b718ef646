"""Problem 5: near-duplicate records with small edits, as an exact set-similarity self-join.

Method: universe-partition pigeonhole. Tokens are hashed into segments by size band; the subsets in the segments, and
for some segments their one-deletion neighbourhoods, are indexed with a cost-based allocation (segments.py), joined on
their keys, cut down by the parity sketch, which never drops a similar pair, and verified exactly on the tokens.

Only distinct token sets are compared. A set's members are brought in at the end, grouped by canonical key, so that
neither copies nor equal sets are compared with each other, and copies (problem 4) are not reported as pairs.

Scale: one pass of Python over the texts, after which they are not read again: the tokens' 64-bit hashes go with the sets,
and candidates are verified on them. The keys (about 30 a set) are shuffled once, into as many tasks as their number asks
for, and both sides of the join read that shuffle. The allocation skips each set's most common segments, so that keys stay
rare; sets repeated within a task are emitted once, so that a group of copies holding a third of all rows costs one row a
task and key. AQE splits what is still skewed.

Defined results: null texts and texts without tokens have no pairs; equal token sets have similarity 1 and are a pair
unless they are copies; repeated rows with one id give no pair with themselves; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import segments
from tessera.llm.canonical import with_copy_key
from tessera.llm.segments import Bands, Threshold
from tessera.llm.tokens import BATCH_TOKENS, hashed_sets
from tessera.runtime import join_sized, materialise, remove, shuffled, work_path

SIMILAR = Threshold(4, 5)
KEYS = "key long, s long, n int, sketch long"
#: Bytes of a row of KEYS in a shuffle, with its share of both sides of the join.
KEY_BYTES = 40


def features(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2, s, n, sketch, toks) of a table of texts, written to the shared folder."""
    named = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    keyed = with_copy_key(named, "_text")
    return materialise(hashed_sets(keyed, "_text", ["id", "k1", "k2"]), "features")


def flat_tokens(batch: pa.RecordBatch, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a batch, cut to 32 bits, and the end of each set."""
    column = batch.column("toks")
    if rows is not None:
        column = column.take(pa.array(rows))
    flat = np.asarray(column.flatten()).astype(np.uint64).astype(np.uint32)
    lengths = np.asarray(pa.compute.list_value_length(column).fill_null(0))
    return flat, np.cumsum(lengths).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about BATCH_TOKENS tokens, or of one set that has more."""
    for batch in batches:
        lengths = np.asarray(pa.compute.list_value_length(batch.column("toks")).fill_null(0)).astype(np.int64)
        part = np.cumsum(lengths) // BATCH_TOKENS
        for first, end in zip(*(np.flatnonzero(x) for x in (np.diff(part, prepend=-1), np.diff(part, append=part[-1:] + 1)))):
            yield batch.slice(first, end + 1 - first)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(segments.SLOTS, dtype=np.int64)
    for batch in batches:
        flat, _ = flat_tokens(batch)
        seen += np.bincount(flat & np.uint32(segments.SLOTS - 1), minlength=segments.SLOTS)
    slot = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(seen[slot])], names=["slot", "df"])


def token_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets the tokens of each slot occur, over all rows; SLOTS numbers, whatever the size of the table."""
    rows = sets.select("toks").mapInArrow(_slots, "slot int, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(segments.SLOTS, dtype=np.int64)
    for r in rows:
        out[r.slot] = r.df
    return out


def size_counts(sets: DataFrame) -> dict[int, int]:
    """How many sets there are of each size."""
    return {r.n: r.c for r in sets.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}


def _emit(batches: Iterator[pa.RecordBatch], bands: Bands, index: bool, more: bool, ids: bool) -> Iterator[pa.RecordBatch]:
    seen: dict[int, tuple[int, int]] = {}
    for batch in _parts(batches):
        s, sketch = np.asarray(batch.column("s")), np.asarray(batch.column("sketch"))
        # Of the rows of a set, the one with the smallest id; ids need not be given.
        own = np.asarray(batch.column("id")) if ids else np.zeros(len(s), np.int64)
        order = np.lexsort((own, sketch, s))
        new = np.ones(len(s), bool)
        new[1:] = (np.diff(s[order]) != 0) | (np.diff(sketch[order]) != 0)
        first = np.sort(order[new])
        if len(seen) > 500_000:
            seen.clear()  # only saves repeated rows, which the join's distinct removes as well
        rows = []
        for i, key, parity, number in zip(first.tolist(), s[first].tolist(), sketch[first].tolist(), own[first].tolist()):
            known = seen.get(key)
            if known is None or known[0] != parity or known[1] > number:
                rows.append(i)
                seen[key] = parity, number
        rows = np.array(rows, dtype=np.int64)
        if not len(rows):
            continue
        n = np.asarray(batch.column("n"))[rows]
        flat, ends = flat_tokens(batch, rows)
        rec, key, band, step = segments.emit(bands, flat, ends, n, index)
        columns = [pa.array(key), pa.array(s[rows][rec]), pa.array(n[rec]), pa.array(sketch[rows][rec])]
        names = ["key", "s", "n", "sketch"]
        if more:
            columns, names = columns + [pa.array(band.astype(np.int32)), pa.array(step.astype(np.int32))], [*names, "band", "step"]
        if ids:
            columns, names = [*columns, pa.array(own[rows][rec])], [*names, "id"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def emit_keys(sets: DataFrame, bands: Bands, index: bool = True, more: bool = False, ids: bool = False) -> DataFrame:
    """(key, s, n, sketch) rows of (s, n, sketch, toks); with `more` band and step, with `ids` the set's smallest id in the task."""
    kind = KEYS + (", band int, step int" if more else "") + (", id long" if ids else "")
    columns = ["s", "n", "sketch", "toks", *(["id"] if ids else [])]
    return sets.select(*columns).mapInArrow(lambda it: _emit(it, bands, index, more, ids), kind)


def close_enough(threshold: Threshold, a: str, b: str):
    """A condition that all similar pairs meet: few differing sketch bits and sizes within the ratio."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    differing = F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch")))
    return (
        (differing * (threshold.den + threshold.num) <= total * (threshold.den - threshold.num))
        & (F.col(f"{a}.n") * threshold.den >= F.col(f"{b}.n") * threshold.num)
        & (F.col(f"{b}.n") * threshold.den >= F.col(f"{a}.n") * threshold.num)
    )


def similar_enough(candidates: DataFrame, threshold: Threshold) -> DataFrame:
    """The rows of (toks_a, toks_b, ...) whose sets are similar indeed, with `similarity`, without the sets."""
    shared = F.size(F.array_intersect("toks_a", "toks_b"))
    either = F.size("toks_a") + F.size("toks_b") - F.col("_shared")
    return (
        candidates.withColumn("_shared", shared)
        .withColumn("_either", either)
        .filter(F.col("_shared") * threshold.den >= F.col("_either") * threshold.num)
        .withColumn("similarity", F.col("_shared") / F.col("_either"))
        .drop("toks_a", "toks_b", "_shared", "_either")
    )


def similar_sets(sets: DataFrame, threshold: Threshold = SIMILAR) -> DataFrame:
    """(s_a, sketch_a, s_b, sketch_b, similarity): pairs of different token sets that are similar; sets is a result of `features`."""
    spark, sizes = sets.sparkSession, size_counts(sets)
    bands = segments.allocate(sizes, token_counts(sets), threshold, self_join=True)
    rows = emit_keys(sets, bands)
    a, b = rows.alias("a"), rows.alias("b")
    before = (F.col("a.s") < F.col("b.s")) | ((F.col("a.s") == F.col("b.s")) & (F.col("a.sketch") < F.col("b.sketch")))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & before & close_enough(threshold, "a", "b"))
    pairs = met.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("s", "sketch")]).distinct()
    with shuffled(spark, segments.rows_of(bands, sizes), KEY_BYTES):
        path = work_path(spark, "candidates")
        pairs = materialise(pairs, "candidates", path)
    # One row of tokens for each set in some candidate.
    in_pairs = pairs.select(F.col("s_a").alias("s"), F.col("sketch_a").alias("sketch")).union(pairs.select("s_b", "sketch_b")).distinct()
    needed_path, tokens_path = work_path(spark, "needed"), work_path(spark, "needed-tokens")
    needed = materialise(in_pairs, "needed", needed_path)
    tokens = join_sized(sets.select("s", "sketch", "toks"), needed, ["s", "sketch"], "left_semi").dropDuplicates(["s", "sketch"])
    tokens = materialise(tokens, "needed-tokens", tokens_path)
    both = pairs.join(tokens.toDF("s_a", "sketch_a", "toks_a"), ["s_a", "sketch_a"]).join(tokens.toDF("s_b", "sketch_b", "toks_b"), ["s_b", "sketch_b"])
    similar = materialise(similar_enough(both, threshold).select("s_a", "sketch_a", "s_b", "sketch_b", "similarity"), "similar")
    remove(spark, path, needed_path, tokens_path)
    return similar


def near_duplicates(texts: DataFrame, threshold: Threshold = SIMILAR) -> DataFrame:
    """(id_a, id_b, similarity): every pair of rows of (id, text) that is similar but not a copy; id_a < id_b."""
    sets = features(texts)
    similar = similar_sets(sets, threshold)
    members = sets.filter("n > 0 and k1 is not null").select("s", "sketch", "k1", "k2", "id").distinct()
    units = members.select("s", "sketch", "k1", "k2").distinct()
    # Equal sets under different canonical keys are pairs of similarity 1.
    several = units.groupBy("s", "sketch").count().filter("count > 1")
    several = several.select("s", "sketch", F.col("s").alias("s_b"), F.col("sketch").alias("sketch_b"), F.lit(1.0).alias("similarity"))
    pairs = similar.unionByName(several.withColumnsRenamed({"s": "s_a", "sketch": "sketch_a"}))
    side = lambda df, x: df.toDF(*[f"{c}_{x}" for c in df.columns])
    key_a, key_b = ["s_a", "sketch_a"], ["s_b", "sketch_b"]
    met = pairs.join(side(units, "a"), key_a).join(side(units, "b"), key_b)
    same = "s_a = s_b and sketch_a = sketch_b"
    met = met.filter(f"(k1_a <> k1_b or k2_a <> k2_b) and (not ({same}) or k1_a < k1_b or (k1_a = k1_b and k2_a < k2_b))")
    full = met.join(side(members, "a"), [*key_a, "k1_a", "k2_a"]).join(side(members, "b"), [*key_b, "k1_b", "k2_b"]).filter("id_a <> id_b")
    return full.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, group_id): the smallest id reachable over the pairs, for each id of `nodes`.

    Labels spread by large and small stars, a round being two shuffles and a written table; the rounds needed grow with
    the logarithm of the longest chain. Only counts of changed links reach the driver.
    """
    spark, path = pairs.sparkSession, work_path(pairs.sparkSession, "links")
    links = materialise(pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).distinct(), "links", path)
    while True:  # ends, as each round makes some link's ends smaller and none larger
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = links.union(links.select("v", "u")).join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(down, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        new_path = work_path(spark, "links")
        new = materialise(small.union(down.toDF("u", "v")).filter("u <> v").distinct(), "links", new_path)
        changed = new.join(links, ["u", "v"], "left_anti").limit(1).count() + links.join(new, ["u", "v"], "left_anti").limit(1).count()
        remove(spark, path)
        links, path = new, new_path
        if not changed:
            break
    root = links.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.select("id").distinct().join(root, F.col("id") == F.col("u"), "left").select("id", F.coalesce("root", "id").alias("group_id"))


def groups(texts: DataFrame, threshold: Threshold = SIMILAR) -> DataFrame:
    """(id, copy_class, group_id, links): one row per text; copies share copy_class, the smallest id of its copies.

    group_id joins classes over links between similar ones; links counts the other classes a class is similar to. This
    form never expands copies into pairs, so it stays linear where copies abound.
    """
    sets = features(texts)
    similar = similar_sets(sets, threshold)
    rows = sets.select("id", "s", "sketch", "k1", "k2", "n").distinct()
    classes = rows.groupBy("k1", "k2").agg(F.min("id").alias("copy_class"))
    classed = rows.join(classes, ["k1", "k2"], "left").withColumn("copy_class", F.coalesce("copy_class", "id"))
    classed = materialise(classed, "classed")
    unit = classed.filter("n > 0").select("s", "sketch", "copy_class").distinct()
    # Equal sets link each class to the set's smallest class; a chain of links is enough for the groups.
    equal = unit.groupBy("s", "sketch").agg(F.min("copy_class").alias("one")).join(unit, ["s", "sketch"]).filter("one <> copy_class")
    equal = equal.select(F.col("one").alias("id_a"), F.col("copy_class").alias("id_b"))
    near = similar.join(unit.toDF("s_a", "sketch_a", "id_a"), ["s_a", "sketch_a"]).join(unit.toDF("s_b", "sketch_b", "id_b"), ["s_b", "sketch_b"]).filter("id_a <> id_b").select("id_a", "id_b")
    links = materialise(near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).union(equal).distinct(), "near")
    sides = links.select(F.col("id_a").alias("copy_class")).union(links.select("id_b"))
    degree = sides.groupBy("copy_class").agg(F.count(F.lit(1)).alias("links"))
    found = components(links, classed.select(F.col("copy_class").alias("id")))
    out = classed.select("id", "copy_class").distinct().join(found.toDF("copy_class", "group_id"), "copy_class", "left")
    return out.join(degree, "copy_class", "left").select("id", "copy_class", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
