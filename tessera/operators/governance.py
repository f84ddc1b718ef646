"""Writing, review and upkeep as functions from tables to tables: nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions import text as T
from tessera.functions.fixed import EDGE_TYPES
from tessera.operators import similarity
from tessera.operators.classify import classify_simply, weak
from tessera.runtime import materialise

#: Columns that an update may set.
UPDATABLE = (
    "text workspace category simhash access_count tags confidence trust_score learned_at updated_at last_accessed_at session_id source para created_by visibility"
    " source_url content_hash fetched_at status confirmed_by"
).split()


class ValidationError(ValueError):
    """A change that is not allowed."""


def numbered(df: DataFrame, *order: str | Column, first: int | Column = 1, name: str = "number") -> DataFrame:
    """`df` with consecutive numbers in the given order, without a window over all rows: a range-partitioned sort is
    written, rows are numbered within their partitions, and each partition begins where those before it end.
    """
    ordered = materialise(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part, local = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each partition
    rows = ordered.withColumn("_p", part).join(F.broadcast(before), "_p")
    start = F.lit(first) if isinstance(first, int) else first
    return rows.withColumn(name, (start + F.col("_before") + local).cast("long")).drop("_m", "_p", "_before")


def inserted(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """(id, pending_id, text, category, norm_hash): notes of (pending_id, text, category) with the ids after the largest one."""
    largest = nodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = numbered(new.filter(T.stripped(F.col("text")) != ""), "created_at", "pending_id", first=largest + 1, name="id")
    category = F.coalesce(F.when(F.col("category") != "", F.col("category")), classify_simply(F.col("text")))
    return rows.select("id", "pending_id", category.alias("category"), hashing.normalised_hash(F.col("text")).alias("norm_hash"))


def deduplicated_insert(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """(pending_id, existing_id, first_pending, action): which notes of (pending_id, text) are new, which repeat a node (same
    hash of the trimmed text), and which repeat an earlier one of the batch. Blank notes are rejected.
    """
    rows = new.select("pending_id", T.stripped(F.col("text")).alias("t"), hashing.content_hash(F.col("text")).alias("h"))
    known = nodes.select(hashing.content_hash(F.col("text")).alias("h"), "id").groupBy("h").agg(F.min("id").alias("existing_id"))
    firsts = rows.filter("t <> ''").groupBy("h").agg(F.min("pending_id").alias("first_pending"))
    out = rows.join(known, "h", "left").join(firsts, "h", "left")
    action = F.when(F.coalesce("t", F.lit("")) == "", "reject").when(F.col("existing_id").isNotNull(), "merge").when(F.col("pending_id") == F.col("first_pending"), "insert").otherwise("merge")
    blank = F.coalesce("t", F.lit("")) == ""
    return out.select("pending_id", F.when(~blank, F.col("existing_id")).alias("existing_id"), F.when(~blank, F.col("first_pending")).alias("first_pending"), action.alias("action"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of (id), and without edges at either end of them."""
    left = nodes.join(gone.select("id"), "id", "left_anti")
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return left, kept.select(*edges.columns)


def updated(nodes: DataFrame, which: Column, **values) -> DataFrame:
    """Nodes with columns set where `which` holds; columns that may not be updated raise ValidationError."""
    unknown = set(values) - set(UPDATABLE)
    if unknown:
        raise ValidationError(f"these columns can't be updated: {', '.join(sorted(unknown))}")
    return nodes.withColumns({c: F.when(which, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def touched(nodes: DataFrame, accesses: DataFrame) -> DataFrame:
    """(id, access_count, last_accessed_at): counts and times after the accesses of (id, at), aggregated before they are joined."""
    folded = accesses.groupBy("id").agg(F.count(F.lit(1)).alias("more"), F.max("at").alias("at"))
    out = nodes.select("id", "access_count", "last_accessed_at").join(folded, "id", "left")
    return out.select(
        "id", (F.coalesce("access_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("access_count"),
        F.greatest("last_accessed_at", F.col("at").cast("timestamp_ntz")).alias("last_accessed_at"),
    )


def with_edge(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of `new` (src, dst, type, weight) whose ends exist and that are not there yet with their type."""
    ends = new.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    fresh = ends.dropDuplicates(["src", "dst", "type"]).join(edges, ["src", "dst", "type"], "left_anti")
    return edges.select("src", "dst", "type", "weight").unionByName(fresh.select("src", "dst", "type", "weight"))


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those of (src, dst, type); a missing end or type is a value like any other."""
    g = gone.select("src", "dst", "type").distinct().toDF("gs", "gd", "gt")
    same = F.col("src").eqNullSafe(F.col("gs")) & F.col("dst").eqNullSafe(F.col("gd")) & F.col("type").eqNullSafe(F.col("gt"))
    return edges.join(g, same, "left_anti")


def queued(new: DataFrame) -> DataFrame:
    """Notes of (origin, content, ...) as they enter the queue: trimmed, none blank, with an id of eight hex digits of where they come from and what they say."""
    rows = new.withColumn("content", T.stripped(F.col("content"))).filter("content <> ''")
    return rows.withColumn("id", F.substring(F.sha2(F.concat_ws("\x1f", "origin", "content"), 256), 1, 8)).drop("origin")


def without_pending(pending: DataFrame, gone: DataFrame) -> DataFrame:
    """The queue without the notes of (id)."""
    return pending.join(gone.select("id"), "id", "left_anti")


def confirm_pending(pending: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """The notes of the queue where `which` holds as they enter the store (see promoted), and the queue without them. Blank notes stay."""
    done = promoted(pending.filter(which))
    return done, without_pending(pending, done)


def history(log: DataFrame, most: int = 20) -> DataFrame:
    """The newest `most` entries of each node, numbered by nth from the newest. Each entry counts once."""
    newest = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("timestamp"), F.desc("id")))
    return log_entries(log).filter("node_id is not null").withColumn("nth", newest).filter(F.col("nth") <= most)


def with_simhash(nodes: DataFrame) -> DataFrame:
    """Nodes whose simhash was never computed get it; only their texts are hashed."""
    missing = nodes.filter(F.coalesce("simhash", F.lit(0)) == 0)
    known = nodes.filter(F.coalesce("simhash", F.lit(0)) != 0)
    hashed = hashing.simhash(missing, "id", "text").filter("id is not null").dropDuplicates(["id"])
    return known.unionByName(missing.drop("simhash").join(hashed, "id", "left").select(*nodes.columns))


def promoted(pending: DataFrame) -> DataFrame:
    """(id, text, category, source_url, content_hash): confirmed notes as they enter the store."""
    url = F.coalesce("source_url", F.lit(""))
    link = F.lower(F.coalesce("source", F.lit(""))).rlike("^https?://")
    return pending.filter(T.stripped(F.col("content")) != "").select(
        "id", F.col("content").alias("text"), F.coalesce(F.when(F.col("category") != "", F.col("category")), classify_simply(F.col("content"))).alias("category"),
        F.when(url != "", url).when(link, F.col("source")).otherwise("").alias("source_url"),
        F.coalesce(F.when(F.col("content_hash") != "", F.col("content_hash")), hashing.normalised_hash(F.col("content"))).alias("content_hash"),
    )


def confirmed(nodes: DataFrame, which: Column, by: str = "user", trust: float | None = 1.0) -> DataFrame:
    values = {"status": "confirmed", "confirmed_by": by} | ({} if trust is None else {"trust_score": trust})
    return updated(nodes, which, **values)


def log_entries(log: DataFrame, most: int = 200) -> DataFrame:
    """The change log with each entry once, actions in lower case and texts cut."""
    cut = lambda c: F.substring(c, 1, most).alias(c)
    return log.dropDuplicates(["id"]).select("id", "node_id", F.lower("action").alias("action"), cut("old_text"), cut("new_text"), "timestamp")


def orphan_history(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, node_id): log entries of nodes that are not there."""
    return log.dropDuplicates(["id"]).join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("id", "node_id")


def selfcheck(nodes: DataFrame, edges: DataFrame, pending: DataFrame, log: DataFrame) -> DataFrame:
    """One row of counts; one aggregation a table."""
    a = nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.sum((F.coalesce("simhash", F.lit(0)) == 0).cast("long")).alias("without_simhash"),
        F.sum((T.stripped(F.coalesce("text", F.lit(""))) == "").cast("long")).alias("empty"), F.countDistinct("workspace").alias("workspaces"),
        F.sum(weak(F.col("category")).cast("long")).alias("uncategorised"),
    )
    b = edges.agg(F.count(F.lit(1)).alias("edges"), F.sum((~F.coalesce(F.col("type").isin(EDGE_TYPES), F.lit(False))).cast("long")).alias("odd_types"))
    c = pending.agg(F.count(F.lit(1)).alias("pending"), F.sum((T.stripped(F.coalesce("content", F.lit(""))) == "").cast("long")).alias("blank_pending"))
    d = log.agg(F.max("timestamp").alias("last_change"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def learn(nodes: DataFrame, new: DataFrame, bits: int = 2, least: float = 0.5) -> DataFrame:
    """(pending_id, l1_id, l2_id, action, target_id): the learning cascade over a batch of (pending_id, text).

    l1: the smallest node in the same simhash bucket within `bits` bits; l2: the smallest node whose token set is more
    similar than `least`; a note with neither is inserted. Simhashes of nodes are computed anew, as stored ones may be 0.
    """
    batch = new.filter(T.stripped(F.col("text")) != "").select("pending_id", "text")
    hashes = hashing.simhash(nodes, "id", "text").filter("simhash <> 0")
    asked = hashing.simhash(batch, "pending_id", "text").filter("simhash <> 0").toDF("pending_id", "h")
    near = l1_matches(asked, hashes, bits)
    alike = l2_matches(batch, nodes, least)
    out = batch.select("pending_id").join(near, "pending_id", "left").join(alike, "pending_id", "left")
    action = F.when(F.col("l1_id").isNotNull() | F.col("l2_id").isNotNull(), "merge").otherwise("insert")
    return out.select("pending_id", "l1_id", "l2_id", action.alias("action"), F.coalesce("l1_id", "l2_id").alias("target_id"))


def l1_matches(asked: DataFrame, hashes: DataFrame, bits: int) -> DataFrame:
    """(pending_id, l1_id). Hashes within `bits` bits agree in one of bits+1 blocks, which they are joined on, within buckets."""
    width = 63 // (bits + 1)

    def blocks(c: str) -> Column:
        cuts = [F.struct(F.lit(i).alias("block"), F.shiftright(F.col(c), i * width).bitwiseAND((1 << (width if i < bits else 63 - bits * width)) - 1).alias("value")) for i in range(bits + 1)]
        return F.explode(F.array(*cuts)).alias("cut")

    a = asked.select("pending_id", "h", blocks("h")).select("pending_id", "h", F.col("h").bitwiseAND(15).alias("bucket"), "cut.block", "cut.value")
    one = hashes.groupBy("simhash").agg(F.min("id").alias("id"))  # equal hashes are one candidate: the smallest id
    b = one.select("id", "simhash", blocks("simhash")).select("id", "simhash", F.col("simhash").bitwiseAND(15).alias("bucket"), "cut.block", "cut.value")
    met = a.join(b, ["bucket", "block", "value"]).filter(hashing.hamming(F.col("h"), F.col("simhash")) <= bits)
    return met.groupBy("pending_id").agg(F.min("id").alias("l1_id"))


def l2_matches(batch: DataFrame, nodes: DataFrame, least: float, exact: bool = False) -> DataFrame:
    """(pending_id, l2_id): the smallest node that shares a minhash band and is more similar than `least`; with `exact`, of all such nodes."""
    new_sets, new_members = similarity.classes(batch.withColumn("tk", T.tokens(F.col("text"))), "pending_id", "tk")
    old_sets, _ = similarity.classes(nodes.select("id", T.tokens(F.col("text")).alias("tk")), "id", "tk")
    new_sets, old_sets = materialise(new_sets, "new-sets"), materialise(old_sets, "old-sets")
    join = similarity.join if exact else similarity.lsh_join
    pairs = join(new_sets, old_sets, least).filter(F.col("similarity") > least)
    best = pairs.groupBy("a").agg(F.min("b").alias("l2_id"))
    return new_members.join(best.withColumnRenamed("a", "class_id"), "class_id").select(F.col("key").alias("pending_id"), "l2_id")


