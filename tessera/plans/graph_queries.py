"""Queries over the graph, categories, upkeep and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed as X
from tessera.functions import text as T
from tessera.operators import classify, conflicts, governance, graph, retrieval
from tessera.plans.base import AS_OF, CJK_WORD, ORACLE, PHRASE, QUERIES, WORD, keywords, live, query, quoted, strip, tokens
from tessera.plans.search_queries import find_sql, visible_sql
from tessera.plans.text_queries import normalised_sql
from tessera.runtime import load, materialise, work_path
from tessera.sources import exports, imports



def _mean(c: F.Column, steps: int) -> F.Column:
    """A mean in whole steps, which no order of addition changes."""
    return F.round(F.sum(F.round(c * steps).cast("long")) / F.count(F.lit(1)) / float(steps), 6)


TIDY = "tidy AS (SELECT src, dst, lower(coalesce(CASE WHEN trim(type) <> '' THEN trim(type) END, 'related')) AS type, coalesce(weight, 1.0) AS weight, source FROM edges)"
JUDGED = (
    TIDY + ", judged AS (SELECT t.*, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'dangling' WHEN src = dst THEN 'self' WHEN row_number() OVER (PARTITION BY src, dst, t.type ORDER BY weight DESC, t.source NULLS LAST) > 1 THEN 'duplicate'"
    " ELSE 'ok' END AS verdict FROM tidy t LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst)"
)
FIXED = JUDGED + ", fixed AS (SELECT src, dst, type, round(weight, 4) AS weight FROM judged WHERE verdict = 'ok')"
ADJ = FIXED + ", adj AS (SELECT src, dst, type, weight FROM fixed UNION SELECT dst, src, type, weight FROM fixed)"


@query(f"WITH {JUDGED} SELECT verdict, count(*) AS edges FROM judged GROUP BY verdict", "edges", "nodes")
def edge_repair_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.judged(edges, nodes).groupBy("verdict").agg(F.count(F.lit(1)).alias("edges"))


@query(f"WITH {FIXED} SELECT * FROM fixed", "edges", "nodes")
def edge_repair(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.repaired(edges, nodes)


@query(f"WITH {JUDGED} SELECT src, dst, type, weight FROM judged WHERE verdict = 'self'", "edges", "nodes")
def repair_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.judged(edges, nodes).filter("verdict = 'self'").select("src", "dst", "type", "weight")


@query(f"WITH {JUDGED} SELECT src, dst, type, count(*) AS extra FROM judged WHERE verdict = 'duplicate' GROUP BY ALL", "edges", "nodes")
def repair_dup_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.judged(edges, nodes).filter("verdict = 'duplicate'").groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("extra"))


EDGE_STATS = (
    f"WITH {JUDGED} SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) FILTER (verdict = 'ok') AS directed_edges, count(DISTINCT CASE WHEN verdict = 'ok' THEN least(src, dst) || ' ' || greatest(src, dst) || ' ' || type END) AS unique_edges,"
    " (SELECT count(*) FROM nodes WHERE id IN (SELECT src FROM judged)) AS nodes_with_edges, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM judged)) AS orphan_nodes,"
    f" (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM judged) AND {live()}) AS active_orphan_nodes, count(*) FILTER (verdict IN ('self', 'dangling')) AS invalid_edges,"
    " count(*) FILTER (verdict = 'duplicate') AS duplicate_edges FROM judged"
)


@query(EDGE_STATS, "edges", "nodes")
def edge_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.statistics(edges, nodes)


@query(f"WITH {FIXED} SELECT type, count(*) AS edges, round(sum(round(weight * 10000)::BIGINT) / count(*) / 10000.0::DOUBLE, 6) AS mean_weight FROM fixed GROUP BY type", "edges", "nodes")
def edge_stats_by_type(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.repaired(edges, nodes).groupBy("type").agg(F.count(F.lit(1)).alias("edges"), _mean(F.col("weight"), 10_000).alias("mean_weight"))


@query(f"SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND {live()}", "edges", "nodes")
def orphan_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.orphans(edges, nodes)


SEEDS = f"seeds AS (SELECT id FROM ({find_sql(PHRASE)}))"


@query(
    f"WITH {ADJ}, {SEEDS}, links AS (SELECT src, dst, max(weight) AS weight FROM adj GROUP BY ALL), h1 AS (SELECT dst AS id, max(round(weight, 4)) AS score FROM links WHERE src IN (SELECT id FROM seeds) GROUP BY dst),"
    " h2 AS (SELECT dst AS id, max(round(score * weight * 0.7::DOUBLE, 4)) AS score FROM h1 JOIN links ON h1.id = links.src GROUP BY dst), u AS (SELECT id, max(score) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY id)"
    " SELECT id, score FROM u WHERE id NOT IN (SELECT id FROM seeds) ORDER BY score DESC, id LIMIT 15",
    "edges", "nodes",
)
def diffuse_2hop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    seeds = materialise(retrieval.find(nodes, PHRASE, AS_OF).select("id"), "seeds")
    return graph.diffuse(graph.repaired(edges, nodes), seeds)


def pagerank_sql(iterations: int = 20) -> str:
    steps = [
        f"WITH {ADJ}, live AS (SELECT id FROM nodes WHERE coalesce(category, '') <> '测试数据' AND coalesce(status, 'active') NOT IN ('archived', 'merged')), links AS (SELECT DISTINCT src, dst FROM adj WHERE src IN (SELECT id FROM live)"
        " AND dst IN (SELECT id FROM live)), w AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM links), p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM live) AS pr FROM live)"
    ]
    for i in range(iterations):
        steps.append(
            f"g{i} AS (SELECT w.dst AS id, sum(p.pr / w.degree) AS got FROM w JOIN p{i} p ON p.id = w.src GROUP BY w.dst), p{i + 1} AS MATERIALIZED (SELECT live.id, 0.15::DOUBLE / (SELECT count(*) FROM live) + 0.85::DOUBLE * coalesce(got, 0) AS pr"
            f" FROM live LEFT JOIN g{i} USING (id))"
        )
    return ", ".join(steps) + f" SELECT id, round(pr, 6) AS pr FROM p{iterations}"


@query(pagerank_sql(), "edges", "nodes")
def pagerank_top(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return graph.pagerank(graph.repaired(edges, nodes), nodes)


@query(
    f"WITH RECURSIVE {ADJ}, c AS (SELECT DISTINCT src, dst FROM adj WHERE type = 'cause'), first AS (SELECT min(src) AS id FROM c), r AS (SELECT id FROM first UNION SELECT c.dst FROM r JOIN c ON c.src = r.id) SELECT id FROM r", "edges", "nodes"
)
def causal_chain(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is reached over causes from the smallest node that has one."""
    fixed = materialise(graph.repaired(edges, nodes), "fixed")
    seed = graph.both_ways(fixed).filter("type = 'cause'").agg(F.min("src").alias("id"))
    return graph.causal_chain(fixed, seed.filter("id is not null")).select("id")


WORDS = [PHRASE, CJK_WORD, "firewall"]


def _found(nodes: DataFrame) -> DataFrame:
    each = [retrieval.find(nodes, w, AS_OF).select(F.lit(i).alias("word"), "id") for i, w in enumerate(WORDS)]
    return materialise(each[0].unionByName(each[1]).unionByName(each[2]), "found")


FOUND = "f AS (" + " UNION ALL ".join(f"SELECT {i} AS word, id FROM ({find_sql(w)})" for i, w in enumerate(WORDS)) + ")"


@query(f"WITH {FOUND}, k AS (SELECT * FROM (VALUES (0, 1), (0, 2), (1, 2)) v(a, b)) SELECT k.a, k.b, (SELECT count(*) FROM f x JOIN f y ON x.id = y.id WHERE x.word = k.a AND y.word = k.b) AS common FROM k", "nodes")
def entangle_common(nodes: DataFrame) -> DataFrame:
    """How many notes two words find in common."""
    f = _found(nodes)
    a, b = f.toDF("a", "id"), f.toDF("b", "id")
    pairs = nodes.sparkSession.createDataFrame([(0, 1), (0, 2), (1, 2)], "a int, b int")
    met = a.join(b, "id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    return pairs.join(met, ["a", "b"], "left").fillna(0)


@query(f"WITH {ADJ}, {FOUND} SELECT x.word AS a, y.word AS b, count(DISTINCT adj.src || ' ' || adj.dst || ' ' || adj.type) AS links FROM adj JOIN f x ON x.id = adj.src JOIN f y ON y.id = adj.dst WHERE x.word < y.word GROUP BY ALL", "edges", "nodes")
def entangle_indirect(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from the notes of one word to those of another."""
    f = _found(nodes)
    links = graph.both_ways(graph.repaired(edges, nodes)).join(f.toDF("a", "src"), "src").join(f.toDF("b", "dst"), "dst").filter("a < b")
    return links.groupBy("a", "b").agg(F.countDistinct("src", "dst", "type").alias("links"))


KEYWORDS = (
    f"k AS (SELECT id, coalesce(CASE WHEN category <> '' THEN category END, '{X.GENERAL}') AS category, list_distinct({keywords('text', 12)}) AS words FROM nodes WHERE {live()}), w AS (SELECT id, category, len(words) AS n, unnest(words) AS word FROM k)"
)


def related_sql(least: float) -> str:
    return (
        KEYWORDS + ", s AS (SELECT x.id AS a, y.id AS b, x.category AS ca, y.category AS cb, x.n AS na, y.n AS nb, count(*) AS s FROM w x JOIN w y ON x.word = y.word AND x.id < y.id GROUP BY ALL), rel AS (SELECT a, b, round(s / (na + nb - s)"
        f" + CASE WHEN ca = cb THEN 0.18::DOUBLE ELSE 0 END, 9) AS score FROM s), pairs AS (SELECT * FROM rel WHERE score >= {least})"
    )


SIDES = "sides AS (SELECT a AS src, b AS dst, score FROM pairs UNION ALL SELECT b, a, score FROM pairs)"
TOP2 = "best AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.src ORDER BY score DESC, s.dst DESC) AS r FROM sides s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = s.src AND e.dst = s.dst)) WHERE r <= {k})"
LINKED = "SELECT src, dst, round(max(score), 4) AS weight FROM (SELECT src, dst, score FROM best UNION ALL SELECT dst, src, score FROM best) GROUP BY ALL"


@query(f"WITH {related_sql(0.46)} SELECT a, b, score FROM pairs", "nodes")
def related_pairs(nodes: DataFrame) -> DataFrame:
    return graph.related_pairs(nodes)


@query(f"WITH {related_sql(0.46)}, {SIDES}, {TOP2.format(k=2)} {LINKED}", "nodes", "edges")
def related_edges_top2(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each node its two best pairs that are no edges yet, in both directions."""
    return graph.linked(nodes, edges)


RESCUE = "best AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst DESC) AS r FROM sides s WHERE src NOT IN (SELECT src FROM edges)) WHERE r = 1)"


@query(f"WITH {related_sql(0.25)}, {SIDES}, {RESCUE} {LINKED}", "nodes", "edges")
def orphan_rescue(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.rescue(nodes, edges)


@query(f"WITH {related_sql(0.25)}, {SIDES}, {TOP2.format(k=1)} {LINKED}", "nodes", "edges")
def deep_orphan_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.linked(nodes, edges, 0.25, 1)


STATED = "stated AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM fixed WHERE type = 'contradicts' AND src <> dst)"
PROPAGATED = "propagated AS (SELECT DISTINCT least(c.src, d.src) AS a, greatest(c.src, d.src) AS b FROM adj c JOIN adj d ON c.dst = d.dst WHERE c.type = 'cause' AND d.type = 'contradicts' AND c.src <> d.src)"
OPPOSITES = "ops(x, y) AS (VALUES " + ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in X.OPPOSITES) + ")"
LEXICAL = (
    OPPOSITES + f", held AS (SELECT id, simhash, unnest(list_distinct({tokens('text')})) AS token FROM nodes WHERE simhash <> 0), hop AS (SELECT DISTINCT held.* FROM held JOIN ops ON token = x), lexical AS (SELECT DISTINCT least(p.id, q.id) AS a,"
    " greatest(p.id, q.id) AS b FROM hop p JOIN ops ON p.token = ops.x JOIN hop q ON q.token = ops.y WHERE p.id <> q.id AND bit_count(xor(p.simhash, q.simhash)) <= 12 AND ((q.simhash & 15) - (p.simhash & 15) + 16) % 16 <= 3)"
)


@query(f"WITH {FIXED}, {STATED} SELECT * FROM stated", "edges", "nodes")
def conflict_l1(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return conflicts.stated(graph.repaired(edges, nodes))


@query(f"WITH {LEXICAL} SELECT * FROM lexical", "nodes")
def conflict_l2_candidates(nodes: DataFrame) -> DataFrame:
    return conflicts.lexical(nodes)


@query(f"WITH {ADJ}, {PROPAGATED} SELECT * FROM propagated", "edges", "nodes")
def conflict_l3(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return conflicts.propagated(graph.repaired(edges, nodes))


@query(
    f"WITH {ADJ}, {STATED}, {PROPAGATED}, {LEXICAL} SELECT a, b, min(layer)::INT AS layer FROM (SELECT a, b, 1 AS layer FROM stated UNION ALL SELECT a, b, 2 FROM lexical UNION ALL SELECT a, b, 3 FROM propagated) GROUP BY a, b",
    "edges", "nodes",
)
def conflicts_all(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return conflicts.all_layers(nodes, materialise(graph.repaired(edges, nodes), "fixed"))


# Categories


def category_sql(hay: str, weighted: bool) -> str:
    rules = [(c, w, 2 if weighted and len(w) >= 3 else 1) for c, w in classify.BUILT_IN]
    order = sorted({c for c, _, _ in rules})
    scores = ", ".join(
        "{'score': " + " + ".join(f"CASE WHEN contains({hay}, '{w}') THEN {p} ELSE 0 END" for c, w, p in rules if c == name) + f", 'o': {-i}, 'c': '{name}'" + "}" for i, name in enumerate(order)
    )
    return f"(SELECT CASE WHEN b.score > 0 THEN b.c END FROM (SELECT list_max([{scores}]) AS b))"


HAY = "lower(coalesce(text, '') || ' ' || coalesce(array_to_string(tags, ' '), ''))"
CLASSIFIED = (
    f"cl AS (SELECT *, coalesce({category_sql('hay', True)}, CASE WHEN contains(lower(coalesce(source, '')), 'rss') THEN '实时热点' WHEN contains(hay, 'http') OR contains(hay, 'www.') THEN '资源' ELSE '{X.TO_CATEGORISE}' END) AS new"
    f" FROM (SELECT *, {HAY} AS hay FROM nodes))"
)


def _map_sql(c: str, table: dict[str, str], default: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


MERGED = _map_sql("new", X.CATEGORY_MERGE, "new")
PARA = X.PARA_OF_CATEGORY
WEAK = f"(category IS NULL OR category IN ({quoted(X.WEAK_CATEGORIES)}))"


@query(f"WITH {CLASSIFIED} SELECT id, new AS category FROM cl", "nodes")
def classify_text(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", classify.classify(F.col("text"), F.col("tags"), F.col("source")).alias("category"))


@query(f"SELECT id, coalesce({category_sql('lower(text)', False)}, '{X.TO_CATEGORISE}') AS category FROM nodes", "nodes")
def classify_simple(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", classify.classify_simply(F.col("text")).alias("category"))


RECLASSIFIED = f"{CLASSIFIED}, mg AS (SELECT id, text, category AS old, {MERGED} AS category, para FROM cl WHERE {WEAK} AND new IS DISTINCT FROM category), rc AS (SELECT id, text, old, category, coalesce(CASE WHEN para <> '' THEN para END, {_map_sql('category', PARA, chr(39) + 'R' + chr(39))}) AS para FROM mg)"


@query(f"WITH {RECLASSIFIED} SELECT id, old, category, para FROM rc", "nodes")
def batch_classify(nodes: DataFrame) -> DataFrame:
    return classify.reclassified(nodes)


@query(f"WITH {RECLASSIFIED} SELECT DISTINCT category, unnest({keywords('text', 5)}) AS keyword, 'learned' AS source FROM rc WHERE old = '{X.TO_CATEGORISE}' AND category <> '{X.TO_CATEGORISE}'", "nodes")
def learned_rules(nodes: DataFrame) -> DataFrame:
    return classify.learned_rules(nodes)


@query(f"SELECT id, {_map_sql('category', PARA, chr(39) + 'R' + chr(39))} AS para FROM (SELECT id, {_map_sql('coalesce(category, ' + chr(39) * 2 + ')', X.CATEGORY_MERGE, 'category')} AS category FROM nodes)", "nodes")
def para_assign(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", classify.para_of(classify.merged(F.coalesce("category", F.lit("")))).alias("para"))


@query(f"SELECT category AS old, CASE WHEN coalesce(category, '') = '' THEN '{X.GENERAL}' ELSE {_map_sql('category', X.CATEGORY_MERGE, 'category')} END AS category, count(*) AS nodes FROM nodes GROUP BY ALL", "nodes")
def normalize_category(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("category").alias("old"), classify.normalised(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT coalesce(upper(CASE WHEN para <> '' THEN para END), '') AS para, count(*) AS nodes FROM nodes GROUP BY 1", "nodes")
def para_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce(F.upper("para"), F.lit("")).alias("para")).agg(F.count(F.lit(1)).alias("nodes"))


# Statistics

GROUP = f"coalesce(CASE WHEN category <> '' THEN category END, '{X.UNCATEGORISED}')"


def _group() -> F.Column:
    return F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit(X.UNCATEGORISED))


@query("SELECT category, count(*) AS nodes FROM nodes GROUP BY category", "nodes")
def store_stats_category(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("category").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT workspace, count(*) AS nodes, count(DISTINCT category) AS categories, max(learned_at) AS last_learned FROM nodes GROUP BY workspace", "nodes")
def store_stats_workspace(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("workspace").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("category").alias("categories"), F.max("learned_at").alias("last_learned"))


@query("SELECT workspace, count(*) AS nodes FROM nodes GROUP BY workspace", "nodes")
def workspace_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("workspace").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"SELECT {GROUP} AS category, count(*) AS nodes FROM nodes GROUP BY 1", "nodes")
def category_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(_group().alias("category")).agg(F.count(F.lit(1)).alias("nodes"))


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT {WEAK}) AS categorised, count(*) FILTER ({WEAK}) AS uncategorised, round(count(*) FILTER (NOT {WEAK}) / greatest(count(*), 1) * 100, 2) AS coverage FROM nodes", "nodes")
def category_coverage(nodes: DataFrame) -> DataFrame:
    weak = classify.weak(F.col("category")).cast("long")
    out = nodes.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(1 - weak), F.lit(0)).alias("categorised"), F.coalesce(F.sum(weak), F.lit(0)).alias("uncategorised"))
    return out.withColumn("coverage", F.round(F.col("categorised") / F.greatest("total", F.lit(1)) * 100, 2))


@query("SELECT source, count(*) AS nodes FROM nodes WHERE status <> 'merged' GROUP BY source", "nodes")
def qa_stats_source(nodes: DataFrame) -> DataFrame:
    return nodes.filter("status <> 'merged'").groupBy("source").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT coalesce(status, 'active') AS status, count(*) AS nodes, round(sum(round(coalesce(trust_score, confidence, 0.0) * 1000000)::BIGINT) / count(*) / 1000000.0::DOUBLE, 6) AS trust FROM nodes GROUP BY 1", "nodes")
def status_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("status", F.lit("active")).alias("status")).agg(F.count(F.lit(1)).alias("nodes"), _mean(retrieval.trust(), 1_000_000).alias("trust"))


@query(f"SELECT {GROUP} AS category, count(*) AS nodes FROM ({visible_sql(PHRASE, 50)}) GROUP BY 1 ORDER BY nodes DESC, category LIMIT 5", "nodes")
def reason_categories(nodes: DataFrame) -> DataFrame:
    rows = retrieval.visible(nodes, PHRASE, k=50)
    return rows.groupBy(_group().alias("category")).agg(F.count(F.lit(1)).alias("nodes")).orderBy(F.desc("nodes"), "category").limit(5)


@query(f"SELECT {GROUP} AS category, count(*) AS nodes FROM nodes GROUP BY 1 ORDER BY nodes DESC, category LIMIT 3", "nodes")
def context_file(nodes: DataFrame) -> DataFrame:
    """The three largest categories."""
    return nodes.groupBy(_group().alias("category")).agg(F.count(F.lit(1)).alias("nodes")).orderBy(F.desc("nodes"), "category").limit(3)


# Upkeep


@query("SELECT id, workspace, category, created_at FROM pending WHERE workspace = 'global'", "pending")
def pending_list(pending: DataFrame) -> DataFrame:
    return pending.filter("workspace = 'global'").orderBy(F.desc("created_at"), "id").select("id", "workspace", "category", "created_at")


LOG = "lg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp) AS r FROM change_log) WHERE r = 1)"


@query(f"WITH {LOG} SELECT node_id, count(*) AS changes, max(timestamp) AS last_change FROM lg WHERE node_id IS NOT NULL GROUP BY node_id", "change_log")
def change_history(change_log: DataFrame) -> DataFrame:
    log = governance.log_entries(change_log).filter("node_id is not null")
    return log.groupBy("node_id").agg(F.count(F.lit(1)).alias("changes"), F.max("timestamp").alias("last_change"))


@query(f"WITH {LOG} SELECT lower(action) AS action, count(*) AS changes FROM lg GROUP BY 1", "change_log")
def change_log_actions(change_log: DataFrame) -> DataFrame:
    return governance.log_entries(change_log).groupBy("action").agg(F.count(F.lit(1)).alias("changes"))


@query("SELECT DISTINCT id, node_id FROM change_log WHERE node_id IS NULL OR node_id NOT IN (SELECT id FROM nodes)", "change_log", "nodes")
def repair_orphan_history(change_log: DataFrame, nodes: DataFrame) -> DataFrame:
    return governance.orphan_history(change_log, nodes)


@query(f"SELECT id, content FROM pending WHERE {strip('content')} <> ''", "pending")
def repair_blank_pending(pending: DataFrame) -> DataFrame:
    """Pending notes without the blank ones."""
    return pending.filter(T.stripped(F.col("content")) != "").select("id", "content")


@query(
    f"SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE coalesce(simhash, 0) = 0) AS without_simhash, (SELECT count(*) FROM nodes WHERE {strip('coalesce(text, chr(32))')} = '') AS empty,"
    f" (SELECT count(DISTINCT workspace) FROM nodes) AS workspaces, (SELECT count(*) FROM nodes WHERE {WEAK}) AS uncategorised, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE type IS NULL OR type NOT IN ({quoted(X.EDGE_TYPES)})) AS odd_types,"
    f" (SELECT count(*) FROM pending) AS pending, (SELECT count(*) FROM pending WHERE {strip('coalesce(content, chr(32))')} = '') AS blank_pending, (SELECT max(timestamp) FROM change_log) AS last_change",
    "nodes", "edges", "pending", "change_log",
)
def selfcheck_counts(nodes: DataFrame, edges: DataFrame, pending: DataFrame, change_log: DataFrame) -> DataFrame:
    return governance.selfcheck(nodes, edges, pending, change_log)


PROMOTED = (
    f"SELECT id, content AS text, coalesce(CASE WHEN category <> '' THEN category END, {category_sql('lower(content)', False)}, '{X.TO_CATEGORISE}') AS category, CASE WHEN coalesce(source_url, '') <> '' THEN source_url WHEN regexp_matches(lower(coalesce(source, '')),"
    f" '^https?://') THEN source ELSE '' END AS source_url, coalesce(CASE WHEN content_hash <> '' THEN content_hash END, substr(sha256({normalised_sql('content')}), 1, 16)) AS content_hash FROM pending WHERE {strip('content')} <> ''"
)


@query(PROMOTED, "pending")
def pending_promote(pending: DataFrame) -> DataFrame:
    return governance.promoted(pending)


@query(
    f"WITH p AS (SELECT id AS pending_id, row_number() OVER (ORDER BY created_at, id) AS r, coalesce(CASE WHEN category <> '' THEN category END, {category_sql('lower(content)', False)}, '{X.TO_CATEGORISE}') AS category,"
    f" substr(sha256({normalised_sql('content')}), 1, 16) AS norm_hash FROM pending WHERE {strip('content')} <> '') SELECT (SELECT max(id) FROM nodes) + r AS id, pending_id, category, norm_hash FROM p",
    "nodes", "pending",
)
def insert_nodes(nodes: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending notes as nodes, numbered after the largest id in the order of their time."""
    return governance.inserted(nodes, pending.select(F.col("id").alias("pending_id"), F.col("content").alias("text"), "category", "created_at"))


@query(
    f"WITH p AS (SELECT id, {strip('content')} AS t FROM pending), n AS (SELECT sha256({strip('text')}) AS h, min(id) AS existing_id FROM nodes GROUP BY 1), f AS (SELECT sha256(t) AS h, min(id) AS first_pending FROM p WHERE t <> '' GROUP BY 1)"
    " SELECT p.id AS pending_id, CASE WHEN t <> '' THEN coalesce(existing_id, 0) ELSE 0 END AS existing_id, CASE WHEN t <> '' THEN first_pending ELSE '' END AS first_pending, CASE WHEN t = '' THEN 'reject' WHEN existing_id IS NOT NULL THEN 'merge'"
    " WHEN p.id = first_pending THEN 'insert' ELSE 'merge' END AS action FROM p LEFT JOIN n ON n.h = sha256(t) LEFT JOIN f ON f.h = sha256(t)",
    "nodes", "pending",
)
def safe_insert(nodes: DataFrame, pending: DataFrame) -> DataFrame:
    """What an insert with exact deduplication does with each pending note; 0 stands for no node."""
    out = governance.deduplicated_insert(nodes, pending.select(F.col("id").alias("pending_id"), F.col("content").alias("text")))
    return out.withColumns({"existing_id": F.coalesce("existing_id", F.lit(0)), "first_pending": F.coalesce("first_pending", F.lit(""))})


@query("SELECT src, dst, type FROM edges WHERE coalesce(src NOT IN (SELECT id FROM nodes WHERE status = 'archived'), true) AND coalesce(dst NOT IN (SELECT id FROM nodes WHERE status = 'archived'), true)", "nodes", "edges")
def delete_cascade(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that are left when the archived nodes are deleted."""
    return governance.without_nodes(nodes, edges, nodes.filter("status = 'archived'"))[1].select("src", "dst", "type")


@query("SELECT id, CASE WHEN status = 'pending' THEN 'confirmed' ELSE status END AS status, CASE WHEN status = 'pending' THEN 'user' ELSE confirmed_by END AS confirmed_by, CASE WHEN status = 'pending' THEN 1.0 ELSE trust_score END AS trust_score FROM nodes", "nodes")
def confirm_nodes(nodes: DataFrame) -> DataFrame:
    return governance.confirmed(nodes, F.coalesce(F.col("status") == "pending", F.lit(False))).select("id", "status", "confirmed_by", "trust_score")


@query(
    "WITH a AS (SELECT user_id AS id, count(*) AS more, max(ts) AS at_time FROM events GROUP BY user_id) SELECT n.id, coalesce(access_count, 0) + coalesce(more, 0) AS access_count, greatest(last_accessed_at, at_time) AS last_accessed_at FROM nodes n LEFT JOIN a USING (id)",
    "nodes", "events",
)
def touch_fold(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Access counts and times after a log of accesses."""
    return governance.touched(nodes, events.select(F.col("user_id").alias("id"), F.col("ts").alias("at")))


BEFORE_AFTER = (
    f"WITH {RECLASSIFIED}, {FIXED}, after AS (SELECT n.id, coalesce(rc.category, n.category) AS category FROM nodes n LEFT JOIN rc USING (id)) SELECT 'before' AS moment, (SELECT count(*) FROM nodes WHERE {WEAK}) AS uncategorised, (SELECT count(*) FROM edges) AS edges"
    f" UNION ALL SELECT 'after', (SELECT count(*) FROM after WHERE {WEAK}), (SELECT count(*) FROM fixed)"
)


@query(BEFORE_AFTER, "nodes", "edges")
def maintenance_before_after(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Uncategorised nodes and edges before and after classification and repair."""
    new = classify.reclassified(nodes).select("id", F.col("category").alias("new"))
    after = nodes.select("id", "category").join(new, "id", "left").select(F.coalesce("new", "category").alias("category"))
    count = lambda df, name, moment: df.agg(F.sum(classify.weak(F.col("category")).cast("long")).alias("uncategorised")).crossJoin(name).select(F.lit(moment).alias("moment"), "uncategorised", "edges")
    return count(nodes, edges.agg(F.count(F.lit(1)).alias("edges")), "before").unionByName(count(after, graph.repaired(edges, nodes).agg(F.count(F.lit(1)).alias("edges")), "after"))


# Sources and sinks


@query("SELECT id, category, confidence FROM nodes WHERE workspace = 'global'", "nodes")
def live_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("workspace = 'global'").select("id", "category", "confidence")


@query("SELECT id, text FROM nodes WHERE id = 42", "nodes")
def point_lookup(nodes: DataFrame) -> DataFrame:
    return nodes.filter("id = 42").select("id", "text")


ESC = "replace(replace(replace(replace(substr(coalesce(text, ''), 1, 50), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
FIRST = "pr AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(type) AS type FROM fixed GROUP BY 1, 2)"


@query(f"SELECT id, '  <node id=\"n' || id || '\"><data key=\"label\">' || {ESC} || '</data></node>' AS line FROM nodes", "nodes")
def export_graphml_nodes(nodes: DataFrame) -> DataFrame:
    return exports.graphml_nodes(nodes)


@query(f"WITH {FIXED}, {FIRST} SELECT '  <edge source=\"n' || a || '\" target=\"n' || b || '\"/>' AS line FROM pr", "edges", "nodes")
def export_graphml_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return exports.graphml_edges(graph.repaired(edges, nodes))


@query(
    f"WITH {FIXED}, {FIRST} SELECT '  N' || a || ' ' || {_map_sql('type', X.EDGE_STYLES, chr(39) + '---' + chr(39))} || '|' || type || '| N' || b AS line FROM pr JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE contains(lower(x.text), '{WORD}') AND contains(lower(y.text), '{WORD}')",
    "edges", "nodes",
)
def mermaid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The diagram's edges among the notes that hold a word."""
    return exports.mermaid_edges(graph.repaired(edges, nodes), nodes.filter(F.lower("text").contains(WORD)))


@query("SELECT id, '  N' || id || '[\"[' || coalesce(category, '未分类') || '] ' || replace(substr(text, 1, 30), '\"', '''') || '\"]' AS line FROM nodes", "nodes")
def mermaid_nodes(nodes: DataFrame) -> DataFrame:
    return exports.mermaid_nodes(nodes)


@query(f"SELECT id, text, category, array_to_string(tags, ',') AS tags, confidence, source FROM nodes WHERE contains(lower(text), '{WORD}')", "nodes")
def export_json_projection(nodes: DataFrame) -> DataFrame:
    return exports.json_rows(nodes, WORD)


@query("SELECT id, workspace, category, text, array_to_string(tags, ',') AS tags, confidence, learned_at FROM nodes", "nodes")
def export_csv_rows(nodes: DataFrame) -> DataFrame:
    return exports.csv_rows(nodes)


@query(
    "SELECT coalesce(category, '未分类') AS category, id, '- **#' || id || '** ' || text || CASE WHEN len(tags) > 0 THEN ' `#' || array_to_string(tags, ', ') || '`' ELSE '' END || CASE WHEN confidence < 1 THEN ' (置信度:' || (floor(confidence * 100 + 0.5)::INT // 100) || '.' || lpad((floor(confidence * 100 + 0.5)::INT % 100)::VARCHAR, 2, '0') || ')' ELSE '' END AS line FROM nodes", "nodes"
)
def export_markdown_lines(nodes: DataFrame) -> DataFrame:
    return exports.markdown_lines(nodes)


def _manifest_sql() -> str:
    from tessera.plans.text_queries import _title_sql

    safe = lambda c, n: f"substr(CASE WHEN regexp_replace(regexp_replace(regexp_replace({c}, '[/\\\\:*?\"<>|\\n\\r\\t]', '_', 'g'), '_+', '_', 'g'), '^[_ ]+|[_ ]+$', '', 'g') = '' THEN 'untitled' ELSE regexp_replace(regexp_replace(regexp_replace({c}, '[/\\\\:*?\"<>|\\n\\r\\t]', '_', 'g'), '_+', '_', 'g'), '^[_ ]+|[_ ]+$', '', 'g') END, 1, {n})"
    cat = "coalesce(category, '未分类')"
    return (
        f"WITH ti AS ({_title_sql()}) SELECT n.id, CASE WHEN {cat} IN ('踩坑', '踩坑库') THEN '04-踩坑库' WHEN {cat} IN ('未分类', '_待分类_', '') THEN '00-收件箱' WHEN {cat} IN ('项目管理', '项目') THEN '01-项目' WHEN {cat} IN ('方法论', 'Skills', 'SOP') THEN '05-Skills'"
        f" WHEN {cat} IN ('输出', '报告') THEN '03-输出' ELSE '02-知识库/' || {safe(cat, 20)} END AS folder, coalesce({safe('title', 35)}, {safe(cat, 20)}) || printf('-%06d.md', n.id) AS filename, md5('---' || chr(10) || 'node_id: ' || n.id || chr(10) || 'category: ' || {cat} || chr(10)"
        " || 'source: ' || coalesce(source, '') || chr(10) || 'created: ' || coalesce(strftime(created_at, '%Y-%m-%d'), '') || chr(10) || CASE WHEN len(tags) > 0 THEN 'tags: [' || array_to_string(tags, ', ') || ']' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || text) AS content"
        " FROM nodes n JOIN ti USING (id) WHERE coalesce(status <> 'archived', true) AND length(trim(text)) >= 10"
    )


@query(_manifest_sql(), "nodes")
def vault_export_manifest(nodes: DataFrame) -> DataFrame:
    pages = exports.vault_pages(nodes)
    return pages.select("id", "folder", "filename", F.md5("content").alias("content"))


def legacy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store written as legacy JSON, read and migrated."""
    nodes = load(spark, sf_dir, "nodes").select("id", "text", "workspace", "category", "tags", "confidence", F.col("learned_at").cast("string").alias("learned_at"), "source")
    path = work_path(spark, "legacy")
    # Every hundred or so rows make one file {"nodes": [...]}; no task gathers more.
    part = nodes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    part.groupBy("part", (F.col("id") % 997).alias("g")).agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes")).select("nodes").write.json(path)
    read = spark.read.schema("nodes array<struct<id:long,text:string,workspace:string,category:string,tags:array<string>,confidence:double,learned_at:string,source:string>>").json(path)
    rows = imports.with_defaults(read.select(F.explode("nodes").alias("n")).select("n.*"))
    return rows.select("id", "workspace", "category", F.size("tags").alias("tags"), F.md5("text").alias("text"))


QUERIES["legacy_roundtrip"] = legacy_roundtrip
ORACLE["legacy_roundtrip"] = f"SELECT id, coalesce(workspace, 'global') AS workspace, coalesce(category, '{X.TO_CATEGORISE}') AS category, coalesce(len(tags), 0)::INT AS tags, md5(text) AS text FROM nodes"


@query(
    f"WITH {FIXED}, m AS (SELECT src, dst, type, max(weight) AS weight FROM fixed GROUP BY ALL) SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dst, type) - 1)::INT AS pos, dst AS target, type, weight FROM m", "edges", "nodes"
)
def edges_json_roundtrip(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge lists written as JSON on their nodes and parsed again."""
    dumped = imports.dumped_edges(graph.repaired(edges, nodes))
    return imports.parsed_edges(dumped, "src", "edges_json").filter("ok").select("src", "pos", "target", "type", "weight")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a backup that was written and restored."""
    nodes = load(spark, sf_dir, "nodes")
    return materialise(nodes, "backup").groupBy("status").agg(F.count(F.lit(1)).alias("nodes"))


QUERIES["snapshot"] = snapshot
ORACLE["snapshot"] = "SELECT status, count(*) AS nodes FROM nodes GROUP BY status"


@query("SELECT source, max(fetched_at) AS last_fetched, arg_max(doc_id, (fetched_at, doc_id)) AS last_doc, count(*) AS docs FROM documents WHERE fetched_at IS NOT NULL GROUP BY source", "documents")
def sync_state(documents: DataFrame) -> DataFrame:
    """The last page that each source delivered."""
    known = documents.filter("fetched_at is not null")
    return known.groupBy("source").agg(F.max("fetched_at").alias("last_fetched"), F.max_by("doc_id", F.struct("fetched_at", "doc_id")).alias("last_doc"), F.count(F.lit(1)).alias("docs"))


