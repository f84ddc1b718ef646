"""Queries that search, score and compare notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions import text as T
from tessera.functions.hashing import simhash_of
from tessera.operators import governance, retrieval, scoring, similarity
from tessera.plans.base import AS_OF, CJK_WORD, PHRASE, SIMHASH_SQL, WORD, query, strip, tokens
from tessera.runtime import against_all

TAGS = "coalesce(array_to_string(tags, ','), '')"
TRUST = "coalesce(trust_score, confidence, 0.0)"
STATUS = "CASE coalesce(status, 'active') " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in retrieval.STATUS_RANK.items()) + " ELSE 5 END"


@query(f"SELECT id, category FROM nodes WHERE contains(lower(text), '{CJK_WORD}') OR contains(lower(category), '{CJK_WORD}') ORDER BY id LIMIT 20", "nodes")
def like_search(nodes: DataFrame) -> DataFrame:
    return retrieval.like(nodes, CJK_WORD).select("id", "category")


def _holds(t: str) -> str:
    return f"(contains(lower(coalesce(text, '')), '{t}') OR contains(lower(coalesce(category, '')), '{t}') OR contains(lower({TAGS}), '{t}'))"


@query("SELECT id FROM nodes WHERE " + " AND ".join(_holds(t) for t in retrieval.terms_of(PHRASE)), "nodes")
def fts_match(nodes: DataFrame) -> DataFrame:
    return retrieval.full_text(nodes, PHRASE).select("id")


def bm25_sql(phrase: str) -> str:
    terms = retrieval.terms_of(phrase)
    columns = ["lower(coalesce(text, ''))", "lower(coalesce(category, ''))", f"lower({TAGS})"]
    d = " + ".join(f"greatest(length({c}) - 2, 0)" for c in columns)
    f = [" + ".join(f"CAST((length({c}) - length(replace({c}, '{t}', ''))) / {len(t)} AS INT)" for c in columns) + f" AS f{i}" for i, t in enumerate(terms)]
    has = [f"(SELECT count(*) FROM c WHERE f{i} > 0)" for i in range(len(terms))]
    idf = [f"CASE WHEN ln(((SELECT count(*) FROM c) - {h} + 0.5) / ({h} + 0.5)) <= 0 THEN 1e-6 ELSE ln(((SELECT count(*) FROM c) - {h} + 0.5) / ({h} + 0.5)) END" for h in has]
    parts = [f"({i}) * f{n} * 2.2 / (f{n} + 1.2 * (0.25 + 0.75 * d / (SELECT avg(d) FROM c)))" for n, i in enumerate(idf)]
    return f"WITH c AS (SELECT id, {d} AS d, {', '.join(f)} FROM nodes) SELECT id, round(-({' + '.join(parts)}), 6) AS rank FROM c WHERE " + " AND ".join(f"f{i} > 0" for i in range(len(terms)))


@query(f"SELECT * FROM ({bm25_sql(PHRASE)}) ORDER BY rank, id LIMIT 20", "nodes")
def fts_bm25_topk(nodes: DataFrame) -> DataFrame:
    return retrieval.bm25(nodes, PHRASE).orderBy("rank", "id").limit(20)


def visible_sql(phrase: str, k: int = 20) -> str:
    held = " OR ".join(f"contains(lower(text), '{w}')" for w in [phrase, *[w for w in phrase.split() if len(w) >= 2]])
    return (
        f"WITH p1 AS (SELECT id FROM ({bm25_sql(phrase)}) ORDER BY rank, id LIMIT {min(2 * k, 40)}), p2 AS (SELECT id FROM nodes WHERE simhash <> 0 AND (simhash & 15) = {simhash_of(phrase) & 15}"
        f" AND id NOT IN (SELECT id FROM p1) AND (SELECT count(*) FROM p1) < {k}), p12 AS (SELECT id FROM p1 UNION SELECT id FROM p2), p3 AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS r"
        f" FROM nodes WHERE id NOT IN (SELECT id FROM p12) AND ({held})) WHERE (SELECT count(*) FROM p12) < {k} AND r <= {3 * k} - (SELECT count(*) FROM p12)), found AS (SELECT id FROM p12 UNION SELECT id FROM p3)"
        f" SELECT * FROM nodes WHERE id IN (SELECT id FROM found) ORDER BY {STATUS}, round({TRUST} + 0.02, 9) DESC, id DESC LIMIT {k}"
    )


@query(f"SELECT id, status, {TRUST} AS trust FROM ({visible_sql(PHRASE)})", "nodes")
def visible_rows(nodes: DataFrame) -> DataFrame:
    return retrieval.visible(nodes, PHRASE).select("id", "status", retrieval.trust().alias("trust"))


@query(f"SELECT id, status, {TRUST} AS trust FROM nodes ORDER BY {STATUS}, round({TRUST} + 0.02, 9) DESC, id DESC LIMIT 20", "nodes")
def list_rows(nodes: DataFrame) -> DataFrame:
    """What an empty keyword shows."""
    return retrieval.visible(nodes, "").select("id", "status", retrieval.trust().alias("trust"))


def _days(*columns: str) -> str:
    return f"date_sub('second', coalesce({', '.join(columns)}), TIMESTAMP '{AS_OF}') / 86400.0"


VELOCITY = f"coalesce(access_count, 0) / greatest(coalesce(floor({_days('last_accessed_at', 'learned_at')}), 365), 1)"


def find_sql(phrase: str, k: int = 10) -> str:
    h = simhash_of(phrase)
    return (
        f"WITH t AS (SELECT *, list_distinct({tokens('text')}) AS tk, list_distinct({tokens(chr(39) + phrase + chr(39))}) AS q, coalesce(simhash, 0) AS sh FROM nodes), p AS (SELECT *, CASE WHEN sh = {h} THEN 0"
        f" WHEN list_has_any(tk, q) OR (sh <> 0 AND (sh & 15) = {h & 15} AND bit_count(xor(sh, {h})) <= 5) THEN 1 WHEN contains(text, '{phrase}') THEN 2 END AS path FROM t),"
        " s AS (SELECT id, path, round(len(list_intersect(tk, q)) / (len(tk) + len(q) - len(list_intersect(tk, q))), 4) AS j, round("
        + VELOCITY
        + " , 6) AS velocity FROM p WHERE path IS NOT NULL), b AS (SELECT id, path, CASE WHEN j > 0.3 THEN j ELSE 0 END AS similarity, velocity FROM s WHERE path = (SELECT min(path) FROM s))"
        f" SELECT id, similarity, velocity FROM (SELECT * FROM b WHERE path > 0 OR id = (SELECT max(id) FROM b WHERE path = 0) ORDER BY similarity DESC, velocity DESC, id LIMIT {k})"
    )


@query(find_sql(PHRASE), "nodes")
def find_topk(nodes: DataFrame) -> DataFrame:
    return retrieval.find(nodes, PHRASE, AS_OF)


@query(f"SELECT id, round({VELOCITY}, 9) AS velocity FROM nodes", "nodes")
def access_velocity(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.round(retrieval.velocity(AS_OF), 9).alias("velocity"))


def _context_sql() -> str:
    days, access = _days("last_accessed_at", "learned_at", "created_at"), "coalesce(access_count, 0)"
    return (
        f"CASE coalesce(status, 'active') WHEN 'confirmed' THEN 0.35::DOUBLE WHEN 'active' THEN 0.2 WHEN 'pending' THEN 0.05 ELSE 0 END + {TRUST} + least({access}, 10) / 100.0 + CASE WHEN {days} IS NULL THEN 0"
        f" WHEN {days} <= 7 THEN greatest(0.0, 0.1::DOUBLE * (1 - {days} / 7.0)) WHEN {days} > 30 THEN -least(0.15::DOUBLE, 0.003::DOUBLE * ({days} - 30)) * (1 - least(1.0::DOUBLE, {access} / 15.0) * 0.7) ELSE 0 END"
    )


@query(f"SELECT id, round({_context_sql()}, 6) AS score FROM nodes", "nodes")
def context_score(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.round(retrieval.context_score(AS_OF), 6).alias("score"))


@query(f"SELECT id, score, pitfall FROM (SELECT id, round({_context_sql()}, 6) AS score, false AS pitfall FROM ({visible_sql(PHRASE, 15)})) WHERE score >= 0.55 ORDER BY score DESC, id LIMIT 10", "nodes")
def pre_answer_context(nodes: DataFrame) -> DataFrame:
    return retrieval.pre_answer(nodes, PHRASE, AS_OF)


def question_sql(select: str) -> str:
    q = r"list_distinct(list_concat(list_transform(range(1, length({f})::BIGINT), lambda i: substr({f}, i, 2)), list_filter(string_split({f}, ''), lambda x: x <> '')))"
    flat = r"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]', ' ', 'g')"
    words = "list_distinct(list_filter(flatten(list_transform(range(2, 7), lambda w: list_transform(range(1, greatest(length(question) - w + 2, 1)::BIGINT), lambda i: substr(question, i, w)))), lambda x: regexp_full_match(x, '[一-鿿]+')))"
    return (
        f"WITH a AS (SELECT subject AS question_id, label_zh || ' ' || scope AS question FROM subjects), q AS (SELECT question_id, {q.format(f='f')} AS q, {words} AS words FROM (SELECT *, {flat.format(c='question')} AS f FROM a)),"
        f" n AS (SELECT id, text, confidence, tags, {q.format(f='f')} AS t FROM (SELECT *, {flat.format(c='text')} AS f FROM nodes WHERE status <> 'merged')), s AS (SELECT question_id, id, confidence,"
        " round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t))) END * 0.6 + least(coalesce(list_sum(list_transform(words, lambda w:"
        " CASE WHEN contains(text, w) THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN list_contains(tags, w) THEN 0.1 ELSE 0 END)), 0), 0.4) + coalesce(confidence, 0.5) * 0.05, 6) AS score FROM n, q),"
        " r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, confidence DESC, id) AS r FROM s WHERE score >= 0.05) " + select
    )


def _asked(subjects: DataFrame) -> DataFrame:
    return subjects.select(F.col("subject").alias("question_id"), F.concat_ws(" ", "label_zh", "scope").alias("question"))


@query(question_sql("SELECT question_id, id, score, r::INT AS rank FROM r WHERE r <= 5"), "nodes", "subjects")
def qa_search(nodes: DataFrame, subjects: DataFrame) -> DataFrame:
    return retrieval.questions(nodes, _asked(subjects))


@query(question_sql("SELECT question_id, id, CASE WHEN score >= 0.5 THEN '高' WHEN score >= 0.3 THEN '中' ELSE '低' END AS band FROM r WHERE r = 1"), "nodes", "subjects")
def qa_confidence_band(nodes: DataFrame, subjects: DataFrame) -> DataFrame:
    best = retrieval.questions(nodes, _asked(subjects), k=1)
    return best.select("question_id", "id", retrieval.confidence_band(F.col("score")).alias("band"))


@query(
    f"SELECT id, confidence FROM nodes WHERE status <> 'merged' AND (contains(lower(text), '{WORD}') OR contains(lower(coalesce(category, '')), '{WORD}') OR contains(lower({TAGS}), '{WORD}')) ORDER BY confidence DESC, id LIMIT 10", "nodes"
)
def quick_lookup(nodes: DataFrame) -> DataFrame:
    return retrieval.quick(nodes, WORD).select("id", "confidence")


@query(f"SELECT learned_at, id, category FROM nodes WHERE contains(text, '{CJK_WORD}')", "nodes")
def timeline(nodes: DataFrame) -> DataFrame:
    """Notes about a word, in the order in which they were learned."""
    return nodes.filter(F.col("text").contains(CJK_WORD)).select("learned_at", "id", "category").orderBy(F.asc_nulls_first("learned_at"), "id")


@query("SELECT id, created_at FROM nodes WHERE created_at >= (SELECT max(created_at) FROM nodes) - INTERVAL 24 HOUR ORDER BY id DESC LIMIT 20", "nodes")
def history_window(nodes: DataFrame) -> DataFrame:
    """Notes created in the last 24 hours before the newest, by falling id."""
    newest = nodes.agg(F.max("created_at").alias("newest"))
    recent = nodes.crossJoin(F.broadcast(newest)).filter("created_at >= newest - interval 24 hours")  # one row
    return recent.orderBy(F.desc("id")).limit(20).select("id", "created_at")


@query("SELECT workspace, count(*) AS pending FROM nodes WHERE status = 'pending' GROUP BY workspace", "nodes")
def pending_count(nodes: DataFrame) -> DataFrame:
    return nodes.filter("status = 'pending'").groupBy("workspace").agg(F.count(F.lit(1)).alias("pending"))


@query(f"SELECT id, category FROM ({visible_sql('pitfall', 50)}) WHERE contains(coalesce(category, ''), '踩坑') OR contains(text, '踩坑') OR contains(lower(text), 'pitfall')", "nodes")
def pitfall_search(nodes: DataFrame) -> DataFrame:
    rows = retrieval.visible(nodes, "pitfall", k=50)
    hit = F.coalesce(F.col("category"), F.lit("")).contains("踩坑") | F.col("text").contains("踩坑") | F.lower("text").contains("pitfall")
    return rows.filter(hit).select("id", "category")


@query(f"SELECT id FROM (SELECT id, CASE WHEN text = '{PHRASE}' THEN 0 WHEN contains(text, '{PHRASE}') THEN 1 END AS path FROM nodes) WHERE path IS NOT NULL ORDER BY path, id LIMIT 1", "nodes")
def find_node_by_text(nodes: DataFrame) -> DataFrame:
    return retrieval.by_text(nodes, PHRASE)


EVAL_HASH = "WITH t AS (SELECT item_id AS id, text FROM eval_items), " + SIMHASH_SQL.format(tokens=tokens("text"))


@query(
    EVAL_HASH + ", d AS (SELECT sh.id AS item_id, n.id, bit_count(xor(sh.simhash, n.simhash))::INT AS distance FROM sh, nodes n WHERE n.simhash <> 0), r AS (SELECT *, row_number() OVER"
    " (PARTITION BY item_id ORDER BY distance, id) AS r FROM d) SELECT item_id, id, distance FROM r WHERE r = 1 AND distance <= 20",
    "eval_items", "nodes",
)
def nearest_simhash(eval_items: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node nearest in simhash to each evaluation item, a stated query set of fixed size, within 20 bits."""
    asked = hashing.simhash(eval_items, "item_id", "text").withColumnRenamed("simhash", "h")
    rows = against_all(nodes.filter("simhash <> 0").select("id", "simhash"), asked, 100_000)
    best = rows.groupBy("item_id").agg(F.min(F.struct(hashing.hamming(F.col("h"), F.col("simhash")).alias("distance"), "id")).alias("b"))
    return best.select("item_id", "b.id", "b.distance").filter("distance <= 20")


CLASSES = f"t AS (SELECT id, list_sort(list_distinct({tokens('text')})) AS tk FROM nodes), c AS (SELECT min(id) AS id, tk FROM t WHERE len(tk) > 0 GROUP BY tk)"
PAIRS = (
    "WITH " + CLASSES + ", e AS (SELECT id, len(tk) AS n, unnest(tk) AS w FROM c), p AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS s FROM e x JOIN e y ON x.w = y.w AND x.id < y.id GROUP BY ALL)"
    " SELECT a, b, round(s / (na + nb - s), 9) AS similarity FROM p WHERE s * 9 >= 4 * (na + nb)"
)


@query(PAIRS.replace("any_value(x.n) AS na, any_value(y.n) AS nb", "x.n AS na, y.n AS nb"), "nodes")
def jaccard_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of token-set classes with similarity 0.8 or more."""
    sets, _ = similarity.classes(nodes.select("id", T.tokens(F.col("text")).alias("tk")), "id", "tk")
    return similarity.join(sets, sets, 0.8, same=True).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("WITH " + CLASSES + " SELECT t.id AS key, c.id AS class_id FROM t JOIN c USING (tk)", "nodes")
def token_classes(nodes: DataFrame) -> DataFrame:
    """The class of equal token sets of each node."""
    return similarity.classes(nodes.select("id", T.tokens(F.col("text")).alias("tk")), "id", "tk")[1]


SEEDS = "perm(i, a, b) AS (VALUES " + ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(hashing.SEEDS)) + ")"


def bands_sql(name: str, source: str) -> str:
    """Bands of (id, tk) rows: `name`(id, band, k)."""
    return (
        f"{name}_e AS (SELECT id, unnest(tk) AS w FROM {source}), {name}_s AS (SELECT id, i, min((('0x' || substr(md5(w), 26, 7))::BIGINT * a + b) % {hashing.P}) AS m FROM {name}_e, perm GROUP BY id, i),"
        f" {name} AS (SELECT id, i // {hashing.ROWS} AS band, list(m ORDER BY i) AS k FROM {name}_s GROUP BY ALL)"
    )


@query(
    "WITH " + CLASSES + f", {SEEDS}, {bands_sql('bd', 'c')}, p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bd x JOIN bd y ON x.band = y.band AND x.k = y.k AND x.id < y.id), j AS (SELECT a, b, len(list_intersect(x.tk, y.tk)) AS s, len(x.tk) + len(y.tk) AS n"
    " FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b) SELECT a, b, round(s / (n - s), 9) AS similarity FROM j WHERE s / (n - s) >= 0.8",
    "nodes",
)
def lsh_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs that share a minhash band and are similar; a subset of jaccard_pairs, nearly all of it."""
    return similarity.lsh_pairs(nodes.select("id", "text"), "id", "text", 0.8).withColumn("similarity", F.round("similarity", 9))


@query(
    f"WITH h AS (SELECT id, sha256({strip('text')}) AS h FROM nodes), g AS (SELECT h, min(id) AS keep_id, count(*) AS copies FROM h GROUP BY h HAVING count(*) > 1) SELECT h.id, g.keep_id, g.copies FROM h JOIN g USING (h)",
    "nodes",
)
def exact_duplicates(nodes: DataFrame) -> DataFrame:
    """Nodes with the same trimmed text, with the first of them and their number."""
    h = nodes.select("id", hashing.content_hash(F.col("text")).alias("h"))
    g = h.groupBy("h").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return h.join(g, "h").select("id", "keep_id", "copies")


NEW = f"(SELECT id, content AS text FROM pending WHERE {strip('content')} <> '')"
L1_SQL = (
    "WITH t AS (SELECT 'n' || id AS id, text FROM nodes UNION ALL SELECT 'p' || id, text FROM " + NEW + "), " + SIMHASH_SQL.format(tokens=tokens("text"))
    + ", a AS (SELECT substr(id, 2) AS pending_id, simhash FROM sh WHERE id[1] = 'p' AND simhash <> 0), b AS (SELECT substr(id, 2)::BIGINT AS id, simhash FROM sh WHERE id[1] = 'n' AND simhash <> 0),"
    " l1 AS (SELECT a.pending_id, min(b.id) AS l1_id FROM a JOIN b ON (a.simhash & 15) = (b.simhash & 15) AND bit_count(xor(a.simhash, b.simhash)) <= 2 GROUP BY a.pending_id)"
)
L2_SQL = (
    f"nt AS (SELECT id, list_sort(list_distinct({tokens('text')})) AS tk FROM nodes), nc AS (SELECT min(id) AS id, tk FROM nt WHERE len(tk) > 0 GROUP BY tk), mt AS (SELECT id AS pid, list_sort(list_distinct({tokens('text')})) AS tk FROM {NEW}),"
    f" mc AS (SELECT min(pid) AS id, tk FROM mt WHERE len(tk) > 0 GROUP BY tk), {SEEDS}, {bands_sql('nb', 'nc')}, {bands_sql('mb', 'mc')}, met AS (SELECT DISTINCT mb.id AS a, nb.id AS b FROM mb JOIN nb ON mb.band = nb.band AND mb.k = nb.k),"
    " o AS (SELECT a, b, len(list_intersect(mc.tk, nc.tk)) AS s, len(mc.tk) + len(nc.tk) AS n FROM met JOIN mc ON mc.id = a JOIN nc ON nc.id = b), g AS (SELECT a, min(b) AS l2_id FROM o WHERE s / (n - s) > 0.5 GROUP BY a),"
    " l2 AS (SELECT mt.pid AS pending_id, g.l2_id FROM mt JOIN mc USING (tk) JOIN g ON g.a = mc.id)"
)


def _batch(pending: DataFrame) -> DataFrame:
    return pending.select(F.col("id").alias("pending_id"), F.col("content").alias("text")).filter(T.stripped(F.col("text")) != "")


@query(L1_SQL + " SELECT * FROM l1", "nodes", "pending")
def learn_dedup_l1(nodes: DataFrame, pending: DataFrame) -> DataFrame:
    hashes = hashing.simhash(nodes, "id", "text").filter("simhash <> 0")
    asked = hashing.simhash(_batch(pending), "pending_id", "text").filter("simhash <> 0").toDF("pending_id", "h")
    return governance.l1_matches(asked, hashes, 2)


@query("WITH " + L2_SQL + " SELECT * FROM l2", "nodes", "pending")
def learn_dedup_l2(nodes: DataFrame, pending: DataFrame) -> DataFrame:
    return governance.l2_matches(_batch(pending), nodes, 0.5)


@query(
    L1_SQL + ", " + L2_SQL + f" SELECT x.id AS pending_id, coalesce(l1_id, 0) AS l1_id, coalesce(l2_id, 0) AS l2_id, CASE WHEN l1_id IS NULL AND l2_id IS NULL THEN 'insert' ELSE 'merge' END AS action, coalesce(l1_id, l2_id, 0) AS target_id FROM {NEW} x"
    " LEFT JOIN l1 ON l1.pending_id = x.id LEFT JOIN l2 ON l2.pending_id = x.id",
    "nodes", "pending",
)
def learn_dedup_decision(nodes: DataFrame, pending: DataFrame) -> DataFrame:
    """What becomes of each pending note; 0 stands for no node."""
    return governance.learn(nodes, _batch(pending)).fillna(0)


DECAY_DAYS = _days("last_accessed_at", "learned_at")


@query(
    f"WITH d AS (SELECT id, confidence, {DECAY_DAYS} AS days, coalesce(access_count, 0) AS a FROM nodes), n AS (SELECT *, greatest(0.1::DOUBLE, confidence * exp(-ln(2) / 30 * days) + least(1.0::DOUBLE, a / 20) * 0.3) AS new FROM d WHERE days > 0)"
    " SELECT id, round(confidence, 4) AS old, round(new, 4) AS new, round(days::DOUBLE, 1) AS days FROM n WHERE abs(new - confidence) > 0.01",
    "nodes",
)
def confidence_decay(nodes: DataFrame) -> DataFrame:
    return scoring.confidence_decay(nodes, AS_OF)


@query(
    f"WITH d AS (SELECT id, coalesce(trust_score, confidence, 1.0) AS old, 0.9::DOUBLE + (1 - 0.9::DOUBLE) * least(1.0::DOUBLE, coalesce(access_count, 0) / 20) * 0.5 AS kept FROM nodes WHERE last_accessed_at IS NULL OR last_accessed_at < TIMESTAMP"
    f" '{AS_OF}' - INTERVAL 30 DAY), n AS (SELECT id, old, round(greatest(0.1::DOUBLE, old * kept), 2) AS new FROM d WHERE old > 0.1) SELECT * FROM n WHERE abs(new - old) >= 0.01",
    "nodes",
)
def trust_decay(nodes: DataFrame) -> DataFrame:
    return scoring.trust_decay(nodes, AS_OF)


CONTEXT_LINE = "'  #' || id || ' [' || coalesce(category, '') || ']' || CASE WHEN len(tags) > 0 THEN ' [' || array_to_string(tags, ', ') || ']' ELSE '' END || ' ' || substr(text, 1, 100)"


@query(f"SELECT id, {CONTEXT_LINE} AS line FROM nodes WHERE id IN (SELECT id FROM ({find_sql(PHRASE, 5)}))", "nodes")
def context_lines(nodes: DataFrame) -> DataFrame:
    """The lines that the five best notes give a prompt."""
    best = retrieval.find(nodes, PHRASE, AS_OF, k=5).select("id")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("  #"), F.col("id").cast("string"), F.lit(" ["), F.coalesce("category", F.lit("")), F.lit("]"), tags, F.lit(" "), F.substring("text", 1, 100))
    return nodes.join(best, "id", "left_semi").select("id", line.alias("line"))


@query(
    f"SELECT id, '  - #' || id || ' [' || coalesce(category, '') || '] [' || coalesce(status, 'active') || '] ' || substr(text, 1, 120) AS line FROM ({visible_sql(PHRASE)})", "nodes"
)
def result_lines(nodes: DataFrame) -> DataFrame:
    line = F.concat(F.lit("  - #"), F.col("id").cast("string"), F.lit(" ["), F.coalesce("category", F.lit("")), F.lit("] ["), F.coalesce("status", F.lit("active")), F.lit("] "), F.substring("text", 1, 120))
    return retrieval.visible(nodes, PHRASE).select("id", line.alias("line"))


