"""The typed, weighted graph: repair, statistics, diffusion, PageRank, causal chains, links from shared keywords."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.fixed import EDGE_TYPES, GENERAL
from tessera.runtime import TASK_BYTES, freed, join_sized, materialise, remove, work_path


def tidy(edges: DataFrame) -> DataFrame:
    """Edges with a type in lower case (`related` where there is none) and a weight (1 where there is none)."""
    return edges.select(
        "src", "dst", F.lower(F.coalesce(F.when(F.trim("type") != "", F.trim("type")), F.lit("related"))).alias("type"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "source"
    )


def judged(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tidy edges with `verdict`: ok, self, dangling, or duplicate (of another one with the same ends and type: the heaviest counts)."""
    known = nodes.select("id")
    t = tidy(edges)
    t = t.join(known.select(F.col("id").alias("src"), F.lit(1).alias("has_src")), "src", "left").join(known.select(F.col("id").alias("dst"), F.lit(1).alias("has_dst")), "dst", "left")
    rank = F.row_number().over(Window.partitionBy("src", "dst", "type").orderBy(F.desc("weight"), F.col("source").asc_nulls_last()))
    verdict = (
        F.when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "dangling").when(F.col("src") == F.col("dst"), "self").when(rank > 1, "duplicate").otherwise("ok")
    )
    return t.withColumn("verdict", verdict).select("src", "dst", "type", "weight", "source", "verdict")


def repaired(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return judged(edges, nodes).filter("verdict = 'ok'").select("src", "dst", "type", F.round("weight", 4).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its mirror image."""
    return edges.select("src", "dst", "type", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")).distinct()


def statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, valid directed and undirected edges, nodes with edges, orphans, live orphans, invalid and repeated edges."""
    j = materialise(judged(edges, nodes), "judged")
    ok = j.filter("verdict = 'ok'")
    pair = F.struct(F.least("src", "dst"), F.greatest("src", "dst"), F.col("type"))
    a = ok.agg(F.count(F.lit(1)).alias("directed_edges"), F.countDistinct(pair).alias("unique_edges"))
    b = j.agg(F.sum(F.col("verdict").isin("self", "dangling").cast("long")).alias("invalid_edges"), F.sum((F.col("verdict") == "duplicate").cast("long")).alias("duplicate_edges"))
    linked = j.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(1))
    live = F.coalesce(~F.col("status").isin("merged", "archived"), F.lit(True))
    c = nodes.select("id", "status").join(linked, "id", "left").agg(
        F.count(F.lit(1)).alias("nodes"), F.count("linked").alias("nodes_with_edges"), F.sum(F.col("linked").isNull().cast("long")).alias("orphan_nodes"),
        F.sum((F.col("linked").isNull() & live).cast("long")).alias("active_orphan_nodes"),
    )
    return c.crossJoin(a).crossJoin(b)  # one row each


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Live nodes without an edge of their own."""
    live = nodes.filter(F.coalesce(~F.col("status").isin("merged", "archived"), F.lit(True)))
    return live.join(tidy(edges).select(F.col("src").alias("id")), "id", "left_anti").select("id")


def diffuse(edges: DataFrame, seeds: DataFrame, hops: int = 2, k: int = 15) -> DataFrame:
    """(id, score): nodes reached from the seeds over edges in both directions, scored by the best product of weights, with a
    factor 0.7 for each hop after the first; rounded at each hop; the best k. A join and an aggregation a hop.
    """
    links = both_ways(edges).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    front = seeds.select("id", F.lit(1.0).alias("score"))
    reached = None
    for hop in range(hops):
        step = front.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.round(F.col("score") * F.col("weight") * 0.7**hop, 4).alias("score"))
        front = step.groupBy("id").agg(F.max("score").alias("score"))
        reached = front if reached is None else reached.unionByName(front).groupBy("id").agg(F.max("score").alias("score"))
    return reached.join(seeds.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(k)


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 20, excluded: tuple[str, ...] = ("测试数据",)) -> DataFrame:
    """(id, pr): ranks over undirected neighbour sets of live nodes, without redistribution from nodes that have none.

    Both joins of a round are on the node, so links and ranks are shuffled on it once a round; the lineage is cut with a
    written table every five rounds.
    """
    live = nodes.filter(~F.coalesce("category", F.lit("")).isin(*excluded) & ~F.coalesce("status", F.lit("active")).isin("archived", "merged")).select("id")
    live = materialise(live, "ranked")
    n = live.count()
    if n <= 1:
        return live.select("id", F.lit(1.0).alias("pr"))
    links = both_ways(edges).select("src", "dst").distinct()
    links = links.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = materialise(links.join(degree, "src"), "links")
    ranks = live.select("id", F.lit(1.0 / n).alias("pr"))
    for i in range(iterations):
        sent = links.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("pr") / F.col("degree")).alias("got"))
        ranks = live.join(sent, F.col("id") == F.col("dst"), "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("pr"))
        if i % 5 == 4:
            ranks = materialise(ranks, "ranks")
    return ranks.select("id", F.round("pr", 6).alias("pr"))


def causal_chain(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """(id, depth): what is reached from the seed (one row of id) over `cause` edges in both directions, and in how many steps.

    One join and anti-join a round, until nothing new is reached; the front is written each round, never collected.
    """
    links = materialise(both_ways(edges).filter("type = 'cause'").select("src", "dst").distinct(), "causes")
    seen = front = materialise(seed.select("id", F.lit(0).alias("depth")), "front")
    for depth in count(1):
        new = front.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = materialise(new.withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            return seen
        seen = materialise(seen.unionByName(front), "seen")


def keyword_sets(nodes: DataFrame, k: int = 12) -> DataFrame:
    """(id, category, words): the distinct ones of the first k keywords of live nodes."""
    live = nodes.filter(F.coalesce(~F.col("status").isin("merged", "archived"), F.lit(True)))
    words = F.array_distinct(T.maintenance_keywords(F.col("text"), k))
    category = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit(GENERAL))
    return live.select("id", category.alias("category"), words.alias("words")).filter(F.size("words") > 0)


def ranked_sets(nodes: DataFrame, k: int = 12) -> DataFrame:
    """(id, category, n, words) of the keyword sets of live nodes, written: words as numbers, the rarest word first."""
    spark = nodes.sparkSession
    path = work_path(spark, "keywords")
    sets = materialise(keyword_sets(nodes.filter("id is not null"), k).withColumn("category", F.xxhash64("category")), "keywords", path)
    each = sets.select("id", "category", F.explode("words").alias("word"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = each.groupBy("word").agg(F.count(F.lit(1)).alias("df")).repartitionByRange(parts, "df", "word").sortWithinPartitions("df", "word")
    placed = materialise(counted.select("word", F.monotonically_increasing_id().alias("_at")), "placed")
    # The number of a partition is in the upper bits; one row for each of them tells how many words come before.
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    number = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("number")
    numbers = placed.withColumn("_part", part).join(F.broadcast(before), "_part").select("word", number)
    numbered = each.join(numbers, "word").groupBy("id", "category").agg(F.sort_array(F.collect_set("number")).alias("words"))
    with freed(spark):
        ranked = materialise(numbered.select("id", "category", F.size("words").cast("int").alias("n"), "words"), "ranked")
    remove(spark, path)
    return ranked


MET = "src long, dst long, shared int, total int, same boolean"
#: Pairs that are held at once while groups are compared, and the size from which a group is compared by itself.
PAIRS, LARGE = 1_000_000, 64


def _needed(threshold: float, total):
    """Words that two sets of `total` words together must share; the rounding of scores is allowed for."""
    return np.maximum(1, np.ceil(total * (threshold / (1 + threshold)) - 1e-6)).astype(np.int64)


def _words(lists: pa.ListArray, n: np.ndarray, k: int) -> np.ndarray:
    """A row of k numbers for each list, -1 where there are fewer."""
    out = np.full((len(n), k), -1, np.int32)
    out[np.arange(k)[None, :] < n[:, None]] = np.asarray(lists.flatten())
    return out


def _compared(keys, kind, ids, category, n, word, seeking, words, threshold: float, within: bool, k: int, half: bool):
    """Arrays of MET for all rows of whole groups, sorted by key."""
    slot = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    bit = np.where(words >= 0, np.uint64(1) << (slot & np.uint64(63)), np.uint64(0))
    low, high = (np.bitwise_xor.reduce(np.where(x, bit, np.uint64(0)), axis=1) for x in (slot < 64, slot >= 64))
    totals = np.arange(2 * k + 1)
    fits = totals - 2 * _needed(threshold, totals)
    start = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1) != 0) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))

    def verified(i: np.ndarray, j: np.ndarray):
        same = category[i] == category[j]
        keep = (ids[i] < ids[j] if half else ids[i] != ids[j]) & (same == within) & (word[i] == word[j])
        keep &= (kind[i] == 0) | (n[i] < k - 1) | (n[j] < k - 1)  # two large sets have groups of their own
        i, j, same = i[keep], j[keep], same[keep]
        for at in range(0, len(i), 100_000):
            x, y = i[at : at + 100_000], j[at : at + 100_000]
            a, b = words[x], words[y]
            member = np.zeros(a.shape, bool)
            for c in range(k):
                member |= a == b[:, c : c + 1]
            member &= a >= 0
            shared, total = member.sum(axis=1), n[x] + n[y]
            first = a[np.arange(len(x)), member.argmax(axis=1)]
            good = (shared >= _needed(threshold, total)) & (first == word[x])
            if good.any():
                yield ids[x][good], ids[y][good], shared[good].astype(np.int32), total[good].astype(np.int32), same[at : at + 100_000][good]

    for g in np.flatnonzero(size > LARGE):
        rows = np.arange(start[g], start[g] + size[g])
        mine = rows[seeking[rows]]
        step = max(1, PAIRS // len(rows))
        for at in range(0, len(mine), step):
            own = mine[at : at + step]
            differing = np.bitwise_count(low[own, None] ^ low[None, rows]) + np.bitwise_count(high[own, None] ^ high[None, rows])
            i, j = np.nonzero(differing <= fits[n[own, None] + n[None, rows]])
            yield from verified(own[i], rows[j])
    few = (size > 1) & (size <= LARGE)
    mine = np.repeat(few, size) & seeking
    first, width = np.repeat(start, size)[mine], np.repeat(size, size)[mine]
    mine = np.flatnonzero(mine)
    step = PAIRS // LARGE
    for at in range(0, len(mine), step):
        w = width[at : at + step]
        i = np.repeat(mine[at : at + step], w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w - first[at : at + step], w)
        near = np.bitwise_count(low[i] ^ low[j]) + np.bitwise_count(high[i] ^ high[j]) <= fits[n[i] + n[j]]
        yield from verified(i[near], j[near])


def _groups(batches: Iterator[pa.RecordBatch], threshold: float, within: bool, k: int, half: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in MET.split(", ")]
    rest: list[pa.RecordBatch] = []
    waiting = 0

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, kind, ids, category, n, word, seeking = (table.column(c).to_numpy() for c in ("key", "kind", "id", "category", "n", "word", "seeking"))
        words = _words(table.column("words").combine_chunks(), n, k)
        for columns in _compared(key, kind, ids, category, n.astype(np.int64), word, seeking, words, threshold, within, k, half):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for batch in batches:
        rest.append(batch)
        waiting += batch.num_rows
        if waiting < 100_000:
            continue
        table = pa.Table.from_batches(rest)
        key = table.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
        if last:
            yield from compared(table.slice(0, last))
            rest = table.slice(last).combine_chunks().to_batches()
        waiting = table.num_rows - last
    if rest:
        yield from compared(pa.Table.from_batches(rest))


def met_pairs(sets: DataFrame, least: float, bonus: float, k: int, half: bool = False, sides: tuple[bool, ...] = (True, False)) -> DataFrame:
    """(src, dst, score) of the seeking rows of `sets` (a result of `ranked_sets` with `seeking`) with all others that score
    `least` or more; exact, each pair once, or only where src < dst. `sides` has True for pairs within categories, False for those across.

    Two sets that score so share so many words that they share one of the rarest of each, by which they are grouped: once
    within categories, where the bonus lowers the similarity that is needed and the category is part of the key, and once
    across them. Nearly all sets have k or k - 1 words, and two of these share more than two of any size must, so they have
    groups of their own. In a group, the parity of the words in 128 slots, in which two sets differ in no more slots than
    words, drops most pairs; the words of the rest are compared, and a pair counts only in the group of the first word it
    shares, so that nothing is shuffled but the sets.
    """

    def rows(df: DataFrame, threshold: float, within: bool, smallest: Column, kind: int) -> DataFrame:
        needed = F.greatest(F.lit(1), F.ceil((F.col("n") + smallest) * (threshold / (1 + threshold)) - 1e-6).cast("int"))
        each = df.select("*", F.explode(F.slice("words", F.lit(1), F.col("n") - needed + 1)).alias("word"))
        return each.withColumn("kind", F.lit(kind)).withColumn("key", F.xxhash64("kind", "word", *(["category"] if within else [])))

    big, small = sets.filter(F.col("n") >= k - 1), sets.filter(F.col("n") < k - 1)
    counted = sets.count()
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted * k * 100 // (4 * TASK_BYTES)))
    out = None
    for within in sides:
        threshold = max(least - bonus, 1e-9) if within else least
        # The smallest set that one of n words can be similar to.
        any_size = F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-6).cast("int"))
        few = rows(small, threshold, within, any_size, 1)
        wanted = materialise(few.select("key").distinct(), "wanted")
        grouped = rows(big, threshold, within, F.lit(k - 1), 0).unionByName(few)
        grouped = grouped.unionByName(join_sized(rows(big, threshold, within, any_size, 1), wanted, "key", "left_semi"))
        columns = ["key", "kind", "id", "category", "n", "word", "seeking", "words"]
        sorted_ = grouped.select(*columns).repartition(parts, "key").sortWithinPartitions("key")
        met = sorted_.mapInArrow(lambda it, t=threshold, w=within: _groups(it, t, w, k, half), MET)
        out = met if out is None else out.unionByName(met)
    score = F.round(F.col("shared") / (F.col("total") - F.col("shared")) + F.when(F.col("same"), bonus).otherwise(0.0), 9)
    return out.select("src", "dst", score.alias("score")).filter(F.col("score") >= least)


def related_pairs(nodes: DataFrame, least: float = 0.46, bonus: float = 0.18, k: int = 12) -> DataFrame:
    """(a, b, score), a < b: live nodes whose keyword sets are similar, with a bonus within a category; exact."""
    sets = ranked_sets(nodes, k).withColumn("seeking", F.lit(True))
    return met_pairs(sets, least, bonus, k, half=True).withColumnsRenamed({"src": "a", "dst": "b"})


#: Scores at which the best pairs of nodes are sought, before the least that counts.
LEVELS = (0.6, 0.5, 0.3)


def best_pairs(nodes: DataFrame, least: float, most: int, known: DataFrame | None = None, only: DataFrame | None = None, bonus: float = 0.18, k: int = 12) -> DataFrame:
    """(src, dst, score): the `most` best pairs of each live node, or of those in `only` (id), that score `least` or more and are
    not in `known` (src, dst); ties go to the larger dst. Exact.

    Pairs are sought at falling scores, each time only for nodes that have too few so far: what scores less than a level
    can't be better than what was found at it. So a node that has good pairs never meets its many weak ones.
    """
    sets = ranked_sets(nodes, k)
    wanted = F.lit(True)
    sought = sets.withColumn("seeking", wanted) if only is None else sets.join(only.select("id", wanted.alias("seeking")).distinct(), "id", "left").fillna(False, "seeking")
    path = work_path(nodes.sparkSession, "sought")
    sought = materialise(sought, "sought", path)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), F.desc("dst")))
    top = lambda pairs: pairs.withColumn("r", rank).filter(F.col("r") <= most)
    known = known.select("src", "dst").distinct() if known is not None else None
    found = []
    for level in [*(x for x in LEVELS if x > least), least]:
        sides = []
        for within in (True, False):  # one after the other, as each shuffles the sets
            pairs = met_pairs(sought, level, bonus, k, sides=(within,))
            if known is not None:
                pairs = pairs.join(known, ["src", "dst"], "left_anti")
            with freed(nodes.sparkSession):
                sides.append(materialise(top(pairs).drop("r"), "side"))
        with freed(nodes.sparkSession):
            best = materialise(top(sides[0].unionByName(sides[1])), "best")
        if level == least:
            found.append(best)
            break
        done = materialise(best.filter(F.col("r") == most).select("src"), "done")
        found.append(best.join(done, "src", "left_semi"))
        still = F.col("seeking") & F.col("src").isNull()
        used, path = path, work_path(nodes.sparkSession, "sought")
        with freed(nodes.sparkSession):
            sought = materialise(sought.join(done, F.col("id") == F.col("src"), "left").select("id", "category", "n", "words", still.alias("seeking")), "sought", path)
        remove(nodes.sparkSession, used)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select("src", "dst", "score")


def neighbours(edges: DataFrame, seeds: DataFrame, k: int = 3) -> DataFrame:
    """(id, neighbour, weight): the k neighbours of each seed (id) over the heaviest edges in either direction; ties go to the smaller id."""
    near = both_ways(edges).join(seeds, F.col("src") == F.col("id")).filter("dst <> id").groupBy("id", F.col("dst").alias("neighbour")).agg(F.max("weight").alias("weight"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "neighbour"))
    return near.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")


def auto_links(nodes: DataFrame, new: DataFrame, key: str, least: float = 0.35, k: int = 5, newest: int = 50) -> DataFrame:
    """(key, node_id, weight): for each new note (key, text, workspace, category) the k most similar of the newest nodes of its
    workspace and category, by token sets.

    Only `newest` rows of each group are met, so that the pairs grow with the new notes alone.
    """
    last = F.row_number().over(Window.partitionBy("workspace", "category").orderBy(F.desc("id")))
    window = nodes.filter("workspace is not null and category is not null").select("id", "workspace", "category", "text").withColumn("r", last).filter(F.col("r") <= newest)
    old = window.select(F.col("id").alias("node_id"), "workspace", "category", F.array_distinct(T.tokens(F.col("text"))).alias("old"))
    mine = new.select(key, "workspace", "category", F.array_distinct(T.tokens(F.col("text"))).alias("new")).filter(F.size("new") > 0)
    met = mine.join(old.filter(F.size("old") > 0), ["workspace", "category"]).withColumn("s", T.jaccard(F.col("new"), F.col("old"))).filter(F.col("s") >= least)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("s", 6)), "node_id"))
    return met.withColumn("nth", nth).filter(F.col("nth") <= k).select(key, "node_id", F.round("s", 6).alias("weight"))


def mirrored(best: DataFrame) -> DataFrame:
    """(src, dst, weight): pairs in both directions, the larger score counting."""
    both = best.select("src", "dst", "score").unionByName(best.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
    return both.groupBy("src", "dst").agg(F.round(F.max("score"), 4).alias("weight"))


def linked(nodes: DataFrame, known: DataFrame, least: float = 0.46, k: int = 2) -> DataFrame:
    """(src, dst, weight): for each node its k best pairs that are no edges yet, in both directions."""
    return mirrored(best_pairs(nodes, least, k, known=known))


def rescue(nodes: DataFrame, edges: DataFrame, least: float = 0.25) -> DataFrame:
    """(src, dst, weight): the best pair of each live orphan, in both directions."""
    return mirrored(best_pairs(nodes, least, 1, only=orphans(edges, nodes)))


def known_type(c: Column) -> Column:
    return c.isin(EDGE_TYPES)
