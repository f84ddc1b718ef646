"""Queries over single texts: tokens, keywords, sentences, hashes, safety, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fixed as X
from tessera.functions import hashing, safety
from tessera.functions import text as T
from tessera.plans.base import SIMHASH_SQL, clip, keywords, query, quoted, strip, tokens


@query(f"SELECT doc_id, length({clip('text')}) AS clipped_chars, md5({clip('text')}) AS clipped FROM documents", "documents")
def text_clip(documents: DataFrame) -> DataFrame:
    c = T.clip(F.col("text"))
    return documents.select("doc_id", F.length(c).cast("long").alias("clipped_chars"), F.md5(c).alias("clipped"))


@query(
    f"SELECT id, len(tk)::INT AS tokens, len(list_distinct(tk))::INT AS different FROM (SELECT id, {tokens('text')} AS tk FROM nodes)", "nodes"
)
def tokenize_counts(nodes: DataFrame) -> DataFrame:
    t = nodes.select("id", T.tokens(F.col("text")).alias("tk"))
    return t.select("id", F.size("tk").alias("tokens"), F.size(F.array_distinct("tk")).alias("different"))


@query(
    rf"SELECT doc_id, len(t)::INT AS tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_slice(regexp_extract_all(lower({clip('text')}),"
    rf" '[a-z0-9_]{{2,}}|[一-鿿]{{2,6}}'), 1, {X.MAX_TOKENS}) AS t FROM documents)",
    "documents",
)
def index_tokens(documents: DataFrame) -> DataFrame:
    t = T.index_tokens(F.col("text"))
    return documents.select("doc_id", F.size(t).alias("tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(
    f"WITH t AS (SELECT id, {tokens('text')} AS tk FROM nodes), e AS (SELECT id, unnest(tk) AS token, generate_subscripts(tk, 1) AS pos FROM t),"
    " c AS (SELECT id, token, count(*) AS n, min(pos) AS first_pos FROM e GROUP BY ALL), r AS (SELECT id, token, n,"
    " row_number() OVER (PARTITION BY id ORDER BY n DESC, first_pos) AS r FROM c) SELECT id, token, n, r::INT AS rank FROM r WHERE r <= 10",
    "nodes",
)
def top_keywords(nodes: DataFrame) -> DataFrame:
    """The ten most frequent tokens of each node; ties go to the first."""
    each = nodes.select("id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    counted = each.groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "at")
    return counted.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("id", "token", "n", "rank")


@query(f"SELECT id, len(k)::INT AS n, array_to_string(k, ' ') AS keywords FROM (SELECT id, {keywords('text', 10)} AS k FROM nodes)", "nodes")
def maint_keywords(nodes: DataFrame) -> DataFrame:
    k = T.maintenance_keywords(F.col("text"))
    return nodes.select("id", F.size(k).alias("n"), F.array_join(k, " ").alias("keywords"))


QUESTION_TOKENS = (
    r"(SELECT {id}, list_concat(list_transform(range(1, length(f)::BIGINT), lambda i: substr(f, i, 2)), list_filter(string_split(f, ''), lambda x: x <> '')) AS q"
    r" FROM (SELECT *, regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}_]', ' ', 'g') AS f FROM {table}))"
)


@query(
    "SELECT id, len(q)::INT AS tokens, len(list_distinct(q))::INT AS different FROM " + QUESTION_TOKENS.format(id="id", text="text", table="nodes"),
    "nodes",
)
def char_bigrams(nodes: DataFrame) -> DataFrame:
    q = nodes.select("id", T.question_tokens(F.col("text")).alias("q"))
    return q.select("id", F.size("q").alias("tokens"), F.size(F.array_distinct("q")).alias("different"))


@query(
    f"WITH t AS (SELECT id, {tokens('text')} AS tk FROM nodes), e AS (SELECT id, unnest(tk) AS token, generate_subscripts(tk, 1) AS pos FROM t),"
    " c AS (SELECT id, token, count(*) AS tf, min(pos) AS first_pos FROM e GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM c GROUP BY token),"
    " s AS (SELECT c.id, c.token, c.first_pos, round(c.tf / max(c.tf) OVER (PARTITION BY c.id) * (ln(((SELECT count(*) FROM nodes) + 1) / (d.df + 1)) + 1), 4) AS score"
    " FROM c JOIN d USING (token) WHERE length(c.token) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, first_pos) AS r FROM s)"
    " SELECT id, token, score, r::INT AS rank FROM r WHERE r <= 5",
    "nodes",
)
def tfidf_tags(nodes: DataFrame) -> DataFrame:
    """The five tokens of two characters or more with the largest tf-idf; ties go to the first."""
    each = nodes.select("id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token")).filter(F.length("token") >= 2)
    counted = each.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("at"))
    frequency = counted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    scored = counted.withColumn("most", F.max("tf").over(Window.partitionBy("id"))).join(frequency, "token").crossJoin(F.broadcast(total))  # one row
    scored = scored.withColumn("score", F.round(F.col("tf") / F.col("most") * (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1), 4))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "at")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("id", "token", "score", "rank")


NUMBERS_SQL = (
    r"SELECT {id}, unnest(list_transform(regexp_extract_all({text}, '-?\d+\.?\d*%?'), lambda n: CAST(rtrim(rtrim(n, '%'), '.') AS DECIMAL(38, 6)))) AS v FROM {table}"
)


@query(
    "WITH v AS (" + NUMBERS_SQL.format(id="id", text="text", table="nodes") + ") SELECT id, count(*) AS n, round(sum(v), 2)::DOUBLE AS total, max(v)::DOUBLE AS largest,"
    " min(v)::DOUBLE AS smallest FROM v GROUP BY id",
    "nodes",
)
def numeric_stats(nodes: DataFrame) -> DataFrame:
    """Count, sum, largest and smallest of the numbers in each text; exact decimals, so that no order of addition shows."""
    bare = F.transform(T.numbers(F.col("text")), lambda n: F.rtrim(F.rtrim(n, F.lit("%")), F.lit(".")).cast("decimal(38,6)"))
    v = nodes.select("id", F.explode(bare).alias("v"))
    return v.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).cast("double").alias("total"), F.max("v").cast("double").alias("largest"), F.min("v").cast("double").alias("smallest")
    )


def _count_sql(words) -> str:
    return " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) / {len(w)}" for w in words)


@query(
    f"SELECT id, CASE WHEN u > d THEN '上升' WHEN d > u THEN '下降' ELSE '平稳' END AS trend FROM (SELECT id, {_count_sql(X.RISING)} AS u, {_count_sql(X.FALLING)} AS d FROM nodes)",
    "nodes",
)
def trend_label(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", T.trend(F.col("text")).alias("trend"))


def sentences_sql(c: str, marks: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '{marks}'), lambda s: {strip('s')}), lambda s: length(s) > 5)"


@query(
    f"WITH t AS (SELECT id, text, {tokens('text')} AS tk, " + sentences_sql("text", r"[。！？!?\n]+") + " AS ss FROM nodes),"
    " s AS (SELECT id, tk, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM t),"
    f" q AS (SELECT id, s, i, tk, {tokens('s')} AS st FROM s),"
    " sc AS (SELECT id, s, coalesce(list_sum(list_transform(st, lambda x: len(list_filter(tk, lambda y: y = x)))), 0) / greatest(len(st), 1) + 0.5 / i AS score FROM q),"
    " b AS (SELECT id, string_agg(s, '。' ORDER BY score DESC, s DESC) || '。' AS summary FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, s DESC) AS r FROM sc)"
    " WHERE r <= 3 GROUP BY id) SELECT t.id, md5(coalesce(b.summary, substr(t.text, 1, 200))) AS summary FROM t LEFT JOIN b USING (id)",
    "nodes",
)
def summary_top3(nodes: DataFrame) -> DataFrame:
    return T.with_summary(nodes.select("id", "text"), "text").select("id", F.md5("summary").alias("summary"))


@query(
    "SELECT id, pos::INT AS pos, sentence FROM (SELECT id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM (SELECT id, "
    + sentences_sql("content", r"[。！？!?\n;；]+")
    + " AS ss FROM pending))",
    "pending",
)
def auto_learn_sentences(pending: DataFrame) -> DataFrame:
    """Sentences of pending notes that are candidates for notes of their own."""
    return pending.select("id", F.posexplode(T.sentences(F.col("content"), r"[。！？!?\n;；]+")).alias("pos", "sentence"))


@query(
    f"WITH a AS (SELECT id, node_id, {tokens('old_text')} AS o, new_text, {tokens('new_text')} AS n FROM (SELECT DISTINCT * FROM change_log) WHERE lower(action) = 'update'"
    " AND old_text IS NOT NULL AND new_text IS NOT NULL AND new_text <> ''), e AS (SELECT id, unnest(o) AS tok, generate_subscripts(o, 1) AS i, n FROM a), f AS (SELECT id, tok, min(i) AS i FROM e"
    " WHERE NOT list_contains(n, tok) GROUP BY id, tok), x AS (SELECT id, string_agg(tok, '' ORDER BY i) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM f) WHERE r <= 10 GROUP BY id)"
    " SELECT a.id, a.new_text || CASE WHEN x.extra IS NULL THEN '' ELSE '；旧记录补充：' || x.extra END AS merged FROM a LEFT JOIN x USING (id)",
    "change_log",
)
def consolidate_pairs(change_log: DataFrame) -> DataFrame:
    """New texts with up to ten tokens, in order, that only the old one had."""
    log = change_log.distinct().filter(F.lower("action") == "update").filter("old_text is not null and new_text <> ''")
    only = F.slice(F.array_except(T.token_set(F.col("old_text")), T.token_set(F.col("new_text"))), 1, 10)
    extra = F.when(F.size(only) > 0, F.concat(F.lit("；旧记录补充："), F.array_join(only, ""))).otherwise("")
    return log.select("id", F.concat("new_text", extra).alias("merged"))


@query("WITH t AS (SELECT id, text FROM nodes), " + SIMHASH_SQL.format(tokens=tokens("text")) + " SELECT id, simhash FROM sh", "nodes")
def simhash(nodes: DataFrame) -> DataFrame:
    return hashing.simhash(nodes, "id", "text")


@query("SELECT (simhash & 15)::INT AS bucket, count(*) AS nodes FROM nodes WHERE simhash <> 0 GROUP BY ALL", "nodes")
def simhash_buckets(nodes: DataFrame) -> DataFrame:
    return nodes.filter("simhash <> 0").groupBy(F.col("simhash").bitwiseAND(15).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("nodes"))


@query(
    f"SELECT doc_id, len(b)::INT AS bounded, md5(array_to_string(b, ' ')) AS digest FROM (SELECT doc_id, CASE WHEN len(t) <= 256 THEN t ELSE list_concat(list_concat(list_slice(t, 1, 153),"
    f" list_slice(t, CAST(floor((len(t) - 51) / 2) AS INT) + 1, CAST(floor((len(t) - 51) / 2) AS INT) + 51)), list_slice(t, len(t) - 51, len(t))) END AS b FROM (SELECT doc_id, {tokens('text')} AS t FROM documents))",
    "documents",
)
def lsh_bounded_tokens(documents: DataFrame) -> DataFrame:
    t = documents.select("doc_id", T.bounded_tokens(T.tokens(F.col("text"))).alias("b"))
    return t.select("doc_id", F.size("b").alias("bounded"), F.md5(F.array_join("b", " ")).alias("digest"))


def normalised_sql(c: str) -> str:
    out = rf"regexp_replace({c}, '(?i)https?://[^\s\p{{Z}}]+', '', 'g')"
    for p in (hashing.DATE, hashing.DATE, hashing.TIME, hashing.TIME):
        out = rf"regexp_replace({out}, '{p}', '\1\2', 'g')"
    spaced = rf"regexp_replace({out}, '[\s\p{{Z}}]+', ' ', 'g')"
    return f"lower({strip(spaced)})"


@query("SELECT id, substr(sha256(" + normalised_sql("content") + "), 1, 16) AS norm_hash FROM pending", "pending")
def normalized_content_hash(pending: DataFrame) -> DataFrame:
    return pending.select("id", hashing.normalised_hash(F.col("content")).alias("norm_hash"))


# RE2 counts only ASCII as blank, word and boundary, as Java's expressions do here.
def injection_sql(c: str) -> str:
    bare = f"regexp_replace({c}, '{X.PSEUDO_TAGS}', '', 'g')"
    each = [f"CASE WHEN regexp_matches({c}, '{X.PSEUDO_TAGS}') THEN 2 ELSE 0 END"]
    each += [f"CASE WHEN regexp_matches({bare}, '{'(?s)' + r if '.*' in r else r}') THEN {p} ELSE 0 END" for p, r in X.PSEUDO_INSTRUCTIONS]
    return f"coalesce({' + '.join(each)}, 0)"


@query(f"SELECT doc_id, {injection_sql('text')} AS risk FROM documents", "documents")
def injection_risk(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", safety.injection_score(F.col("text")).alias("risk"))


@query(
    f"SELECT CASE WHEN r <= 1 THEN 'low' WHEN r <= 3 THEN 'medium' ELSE 'high' END AS level, count(*) AS notes FROM (SELECT {injection_sql('content')} AS r FROM pending) GROUP BY 1",
    "pending",
)
def injection_level(pending: DataFrame) -> DataFrame:
    return pending.groupBy(safety.injection_level(safety.injection_score(F.col("content"))).alias("level")).agg(F.count(F.lit(1)).alias("notes"))


VALUABLE = (
    "coalesce(length(s) >= 10 AND NOT (length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g')) / length(s) > 0.95 AND length(s) < 30)"
    " AND NOT (starts_with(s, 'http') AND len(regexp_split_to_array(s, '[\\s\\p{Z}]+')) <= 2), false)"
)


@query(f"SELECT id, {VALUABLE} AS valuable FROM (SELECT id, {strip('content')} AS s FROM pending)", "pending")
def valuable_content(pending: DataFrame) -> DataFrame:
    return pending.select("id", safety.valuable(F.col("content")).alias("valuable"))


KEEP = " + ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN 1 ELSE 0 END" for p in X.KEEP_SIGNALS)
KEEP += r" + CASE WHEN length(s) > 100 THEN 1 ELSE 0 END + CASE WHEN length(s) > 300 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(s, '\d') THEN 1 ELSE 0 END"


@query(f"SELECT id, {KEEP} AS score FROM (SELECT id, {strip('content')} AS s FROM pending)", "pending")
def auto_extract_score(pending: DataFrame) -> DataFrame:
    return pending.select("id", safety.keep_score(F.col("content")).alias("score"))


SKIP = " OR ".join(f"contains(substr(s, 1, 30), '{w}')" for w in X.SKIP_SIGNALS)


@query(
    f"SELECT id, k AS text, 0.6 AS trust_score, 'auto_extract' AS source FROM (SELECT id, s, {strip(f'regexp_replace(s, {chr(39)}{X.KEEP_PREFIX}{chr(39)}, {chr(39)}{chr(39)})')} AS k FROM (SELECT id, {strip('content')} AS s FROM pending))"
    f" WHERE length(s) >= 20 AND NOT ({SKIP}) AND {KEEP} >= 2 AND length(k) >= 10",
    "pending",
)
def auto_extract_rows(pending: DataFrame) -> DataFrame:
    c = F.col("content")
    return pending.filter(safety.worth_keeping(c)).select("id", safety.kept_text(c).alias("text"), F.lit(0.6).alias("trust_score"), F.lit("auto_extract").alias("source"))


REDACT = "text"
for _p in X.SECRETS:
    REDACT = rf"regexp_replace({REDACT}, '{_p}', '\1[REDACTED]', 'g')"


@query(f"SELECT doc_id, md5({REDACT}) AS redacted FROM documents", "documents")
def redact_secrets(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.md5(safety.redacted(F.col("text"))).alias("redacted"))


@query(
    "SELECT id, CASE WHEN content IS NULL OR content = '' OR starts_with(content, '[Z] 引擎错误') OR starts_with(content, '[Z] 无') OR contains(content, '不可信记忆引用') THEN content"
    f" ELSE '{X.UNTRUSTED_HEADER}' || content END AS wrapped FROM pending",
    "pending",
)
def wrap_untrusted(pending: DataFrame) -> DataFrame:
    return pending.select("id", safety.wrapped(F.col("content")).alias("wrapped"))


def _intent_sql() -> str:
    cases = ""
    for name, first, anywhere in X.INTENTS:
        c = "lower(s)" if name == "pagerank" else "s"
        tests = " OR ".join([f"starts_with(s, '{w}')" for w in first] + [f"contains({c}, '{w}')" for w in anywhere])
        cases += f" WHEN {tests} THEN '{name}'"
    return f"CASE{cases} ELSE '{X.DEFAULT_INTENT}' END"


@query(f"SELECT id, {_intent_sql()} AS intent FROM (SELECT id, {strip('content')} AS s FROM pending)", "pending")
def intent_route(pending: DataFrame) -> DataFrame:
    return pending.select("id", safety.intent(F.col("content")).alias("intent"))


@query(
    f"SELECT source, CASE WHEN s = '' THEN 'user_direct' WHEN s IN ({quoted(X.SOURCES)}) THEN s ELSE 'user_direct' END AS coerced, count(*) AS nodes FROM (SELECT source, coalesce({strip('source')}, '') AS s FROM nodes) GROUP BY ALL",
    "nodes",
)
def coerce_source(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("source", safety.coerced_source(F.col("source")).alias("coerced")).agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT workspace, coalesce(regexp_matches(workspace, '^[A-Za-z0-9_-]{1,64}$'), false) AS valid, count(*) AS nodes FROM nodes GROUP BY ALL", "nodes")
def valid_workspace(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("workspace", safety.valid_workspace(F.col("workspace")).alias("valid")).agg(F.count(F.lit(1)).alias("nodes"))


@query(
    r"SELECT doc_id, coalesce(regexp_matches(source_url, '^(?i)https?://') AND h <> '' AND h <> 'localhost' AND NOT ends_with(h, '.localhost') AND NOT regexp_matches(h,"
    r" '^(?:10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.|22[4-9]\.|23\d\.|24\d\.|25[0-5]\.)[\d.]+$'), false) AS allowed FROM"
    r" (SELECT doc_id, source_url, lower(regexp_extract(source_url, '^(?i)https?://(?:[^/@\s]*@)?([^/:?#\s]+)', 1)) AS h FROM documents)",
    "documents",
)
def url_allowed_static(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", safety.url_allowed(F.col("source_url")).alias("allowed"))


def _front_matter_sql() -> str:
    name, value = strip("substr(x, 1, instr(x, ':') - 1)"), strip("substr(x, instr(x, ':') + 1)")
    return (
        r"WITH b AS (SELECT doc_id, regexp_extract(text, '(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)', 1) AS b FROM documents), l AS (SELECT doc_id, unnest(string_split(b, chr(10))) AS x FROM b)"
        f" SELECT DISTINCT doc_id, {name} AS field, regexp_replace({value}, '^[\"'']+|[\"'']+$', '', 'g') AS value FROM l WHERE contains(x, ':')"
    )


@query(_front_matter_sql(), "documents")
def frontmatter_fields(documents: DataFrame) -> DataFrame:
    """Front-matter fields of imported pages."""
    return documents.select("doc_id", F.explode(T.front_matter(F.col("text"))).alias("field", "value"))


def _title_sql() -> str:
    first = strip(r"regexp_split_to_array(text, '[。！？；\n]')[1]")
    clean = strip("split_part(regexp_replace(f, '[（(][^）)]*[）)]', '', 'g'), '——', 1)")
    return (
        f"WITH f AS (SELECT id, text AS x, {first} AS f FROM nodes), c AS (SELECT id, {clean} AS c, regexp_extract_all(x, '[一-鿿]{{2,}}') AS runs FROM f),"
        " r AS (SELECT id, c, list_reduce(list_prepend('', runs), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS longest FROM c)"
        " SELECT id, CASE WHEN regexp_matches(substr(c, 1, 10), '[一-鿿]') AND length(c) >= 2 THEN regexp_replace(substr(c, 1, 35), '[，, ]+$', '')"
        " WHEN longest <> '' THEN substr(longest, 1, 35) END AS title FROM r"
    )


@query(_title_sql(), "nodes")
def node_titles(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", T.title(F.col("text")).alias("title"))
