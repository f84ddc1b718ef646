"""The registry of queries with their oracle SQL, and SQL snippets that spell the shared definitions in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import fixed as X
from tessera.runtime import load, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The time that scores refer to, and the words that searches look for.
AS_OF = "2026-11-01 00:00:00"
WORD, CJK_WORD, PHRASE = "balancer", "负载均衡", "load balancer"


#: Tables with texts, whose rows cost most to compute on.
TEXTS = ("nodes", "pending", "documents")


def query(sql: str | None = None, *tables: str, name: str | None = None):
    """Register f(**tables as DataFrames) under its name, with the SQL that DuckDB runs on the same tables."""

    def register(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(spread(load(spark, sf_dir, t)) if t in TEXTS else load(spark, sf_dir, t) for t in tables))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLE[key] = sql
        return f

    return register


def quoted(words) -> str:
    return ", ".join("'" + str(w).replace("'", "''") + "'" for w in words)


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def clip(c: str) -> str:
    return (
        f"CASE WHEN length({c}) <= {X.CLIP_CHARS} THEN {c} ELSE substr({c}, 1, {X.CLIP_HEAD}) || chr(10) || substr({c},"
        f" CAST(floor((length({c}) - {X.CLIP_MIDDLE}) / 2) AS INT) + 1, {X.CLIP_MIDDLE}) || chr(10) || right({c}, {X.CLIP_TAIL}) END"
    )


def tokens(c: str) -> str:
    return (
        rf"list_slice(list_filter(flatten(list_transform(regexp_extract_all(lower({clip(c)}), '[\p{{L}}\p{{N}}_]+'), lambda w:"
        rf" CASE WHEN regexp_full_match(w, '[一-鿿]+') THEN string_split(w, '') ELSE [w] END)), lambda t: t <> '' AND NOT"
        rf" list_contains([{quoted(X.STOP_CHARACTERS)}], t)), 1, {X.MAX_TOKENS})"
    )


def keywords(c: str, k: int) -> str:
    return rf"list_slice(list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]{{2,}}|[一-鿿]{{2,}}'), lambda t: t NOT IN ({quoted(X.MAINTENANCE_STOP)})), 1, {k})"


def live(alias: str = "") -> str:
    return f"({alias}status IS NULL OR {alias}status NOT IN ('merged', 'archived'))"


#: Simhash of (id, text) rows named t.
SIMHASH_SQL = (
    "tok AS (SELECT id, unnest({tokens}) AS token FROM t), tf AS (SELECT id, token, count(*) AS n FROM tok GROUP BY ALL),"
    " hs AS (SELECT id, n, (('0x' || substr(md5(token), 17, 16))::UBIGINT & 9223372036854775807)::BIGINT AS h FROM tf),"
    " votes AS (SELECT id, i, sum(n * (2 * ((h >> i) & 1) - 1)) AS v FROM hs, range(63) r(i) GROUP BY id, i),"
    " sh AS (SELECT t.id, coalesce(s.simhash, 0)::BIGINT AS simhash FROM t LEFT JOIN (SELECT id, sum(CASE WHEN v > 0 THEN 1::BIGINT << i ELSE 0 END) AS simhash"
    " FROM votes GROUP BY id) s ON s.id = t.id)"
)
