"""Queries of what changes the store: edges, updates, the review queue, rules, history, repairs, links and pages that come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import classify, governance, graph, retrieval
from tessera.plans.base import ORACLE, PHRASE, QUERIES, SIMHASH_SQL, load, query, strip, tokens
from tessera.plans.graph_queries import ADJ
from tessera.plans.search_queries import visible_sql
from tessera.runtime import work_path
from tessera.sources import exports, imports


@query("SELECT id, CASE WHEN status = 'archived' THEN 'X' ELSE para END AS para, CASE WHEN status = 'archived' THEN coalesce(trust_score, 0.0) * 0.5 ELSE trust_score END AS trust_score FROM nodes", "nodes")
def update_nodes(nodes: DataFrame) -> DataFrame:
    """Archived nodes go to the archive class and lose half of their trust."""
    which = F.coalesce(F.col("status") == "archived", F.lit(False))
    return governance.updated(nodes, which, para="X", trust_score=F.coalesce("trust_score", F.lit(0.0)) * 0.5).select("id", "para", "trust_score")


@query(
    "WITH new AS (SELECT id AS src, id + 1 AS dst, 'refines' AS type, 0.5::DOUBLE AS weight FROM nodes WHERE status = 'confirmed'), fresh AS (SELECT * FROM new WHERE dst IN (SELECT id FROM nodes) AND NOT EXISTS"
    " (SELECT 1 FROM edges e WHERE e.src = new.src AND e.dst = new.dst AND e.type = new.type)) SELECT src, dst, type, weight FROM edges UNION ALL SELECT * FROM fresh",
    "edges", "nodes",
)
def add_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each confirmed node refines the next one, where there is one and no such edge yet."""
    new = nodes.filter("status = 'confirmed'").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("refines").alias("type"), F.lit(0.5).alias("weight"))
    return governance.with_edge(edges, nodes, new)


@query(
    "WITH gone AS (SELECT DISTINCT src, dst, type FROM edges WHERE weight IS NULL) SELECT src, dst, type, weight FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src IS NOT DISTINCT FROM e.src AND g.dst IS NOT DISTINCT FROM e.dst AND g.type IS NOT DISTINCT FROM e.type)",
    "edges",
)
def remove_edges(edges: DataFrame) -> DataFrame:
    """Edges without those that some row gives without a weight."""
    return governance.without_edges(edges, edges.filter("weight is null")).select("src", "dst", "type", "weight")


@query(
    f"SELECT id, content, category FROM pending UNION ALL SELECT substr(sha256(id::VARCHAR || chr(31) || {strip('text')}), 1, 8) AS id, {strip('text')} AS content, category FROM nodes WHERE status = 'disputed' AND {strip('text')} <> ''",
    "pending", "nodes",
)
def pending_add(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """Disputed nodes queued for review again."""
    new = nodes.filter("status = 'disputed'").select(F.col("id").cast("string").alias("origin"), F.col("text").alias("content"), "category")
    return pending.select("id", "content", "category").unionByName(governance.queued(new).select("id", "content", "category"))


@query("SELECT id, workspace FROM pending WHERE coalesce(category, '') <> ''", "pending")
def pending_reject(pending: DataFrame) -> DataFrame:
    """The queue without the notes that have no category."""
    return governance.without_pending(pending, pending.filter(F.coalesce("category", F.lit("")) == "")).select("id", "workspace")


@query(f"SELECT id, CASE WHEN workspace = 'global' AND {strip('content')} <> '' THEN 'promoted' ELSE 'waiting' END AS state FROM pending", "pending")
def pending_confirm(pending: DataFrame) -> DataFrame:
    """Notes of the global workspace leave the queue as they enter the store; blank ones stay."""
    promoted, waiting = governance.confirm_pending(pending, F.coalesce(F.col("workspace") == "global", F.lit(False)))
    return promoted.select("id", F.lit("promoted").alias("state")).unionByName(waiting.select("id", F.lit("waiting").alias("state")))


_SEED = ", ".join(f"('{c}', '{w}', 'seed')" for c, w in classify.BUILT_IN)


def rule_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules with words added, those that are there already once."""
    return classify.with_rules(classify.seeded(spark), "技术", "python, spark，集群, spark ")


QUERIES["rule_insert"] = rule_insert
ORACLE["rule_insert"] = f"SELECT * FROM (VALUES {_SEED}, ('技术', 'spark', 'user'), ('技术', '集群', 'user')) AS r(category, keyword, source)"


@query(
    "WITH lg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp) AS r FROM change_log) WHERE r = 1), h AS (SELECT node_id, id, lower(action) AS action, timestamp, row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC, id DESC)::INT AS nth FROM lg WHERE node_id IS NOT NULL)"
    " SELECT node_id, nth, id, action, timestamp FROM h WHERE nth <= 20",
    "change_log",
)
def node_history(change_log: DataFrame) -> DataFrame:
    """The newest twenty changes of each node, the newest first."""
    return governance.history(change_log, 20).select("node_id", "nth", "id", "action", "timestamp")


@query(
    f"WITH t AS (SELECT id, text FROM nodes), {SIMHASH_SQL.replace('{tokens}', tokens('text'))} SELECT n.id, CASE WHEN coalesce(n.simhash, 0) = 0 THEN sh.simhash ELSE n.simhash END AS simhash FROM nodes n JOIN sh USING (id)",
    "nodes",
)
def repair_simhash(nodes: DataFrame) -> DataFrame:
    """Nodes with the simhash computed where it never was."""
    return governance.with_simhash(nodes).select("id", "simhash")


@query(f"SELECT id, workspace FROM nodes WHERE {strip('coalesce(text, chr(32))')} <> ''", "nodes")
def repair_empty_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without the empty ones."""
    return nodes.filter(T.stripped(F.coalesce("text", F.lit(""))) != "").select("id", "workspace")


@query(
    f"WITH {ADJ}, top AS (SELECT id FROM ({visible_sql(PHRASE, 3)})), near AS (SELECT top.id, a.dst AS neighbour, max(a.weight) AS weight FROM top JOIN adj a ON a.src = top.id WHERE a.dst <> top.id GROUP BY ALL),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, neighbour) AS nth FROM near) SELECT id, neighbour, weight FROM r WHERE nth <= 3",
    "edges", "nodes",
)
def reason_neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The three nearest neighbours of each of the first three notes about a phrase."""
    top = retrieval.visible(nodes, PHRASE, k=3).select("id")
    return graph.neighbours(graph.repaired(edges, nodes), top, 3)


@query(
    f"WITH old AS (SELECT id, workspace, category, list_distinct({tokens('text')}) AS tk FROM (SELECT *, row_number() OVER (PARTITION BY workspace, category ORDER BY id DESC) AS r FROM nodes WHERE workspace IS NOT NULL AND category IS NOT NULL) WHERE r <= 50),"
    f" new AS (SELECT id AS pending_id, workspace, category, list_distinct({tokens('content')}) AS tk FROM pending), p AS (SELECT pending_id, id AS node_id, len(list_intersect(new.tk, old.tk)) / (len(new.tk) + len(old.tk) - len(list_intersect(new.tk, old.tk))) AS s FROM new JOIN old USING (workspace, category) WHERE len(new.tk) > 0 AND len(old.tk) > 0),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY pending_id ORDER BY round(s, 6) DESC, node_id) AS nth FROM p WHERE s >= 0.35) SELECT pending_id, node_id, round(s, 6) AS weight FROM r WHERE nth <= 5",
    "nodes", "pending",
)
def auto_link(nodes: DataFrame, pending: DataFrame) -> DataFrame:
    """The links that each pending note would get: the five most similar of the newest fifty nodes of its workspace and category."""
    new = pending.select(F.col("id").alias("pending_id"), F.col("content").alias("text"), "workspace", "category")
    return graph.auto_links(nodes, new, "pending_id")


def vault_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault of the notes, written, read again and merged into a store that has lost every third note and the text of every fifth."""
    nodes = load(spark, sf_dir, "nodes")
    root = work_path(spark, "vault")
    exports.write_pages(exports.vault_pages(nodes), root)
    store = nodes.filter("id % 3 <> 0").withColumn("text", F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("text")))
    changed, fresh = imports.merged_vault(store, imports.vault(spark, root))
    return changed.select(F.lit("changed").alias("what"), F.sha1(F.encode("text", "utf-8")).alias("digest")).unionByName(fresh.select(F.lit("new").alias("what"), "digest"))


QUERIES["vault_import"] = vault_import
_BODY = strip("text")
ORACLE["vault_import"] = (
    f"WITH pages AS (SELECT id, {_BODY} AS body, sha1({_BODY}) AS digest FROM nodes WHERE coalesce(status <> 'archived', true) AND length(trim(text)) >= 10 AND length({_BODY}) >= 10), store AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'old' ELSE text END AS text FROM nodes WHERE id % 3 <> 0)"
    f" SELECT 'changed' AS what, p.digest FROM pages p JOIN store s USING (id) WHERE p.body <> s.text UNION ALL (SELECT DISTINCT 'new', digest FROM pages WHERE id % 3 = 0 AND digest NOT IN (SELECT sha1({strip('text')}) FROM store WHERE text IS NOT NULL))"
)
