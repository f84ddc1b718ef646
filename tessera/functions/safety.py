"""Text safety and quality as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.fixed import (
    DEFAULT_INTENT, INTENTS, KEEP_PREFIX, KEEP_SIGNALS, POLICY_MARK, POLICY_PREFIX, PSEUDO_INSTRUCTIONS, PSEUDO_TAGS, RULE_MARK, RULE_PREFIX, SECRETS, SKIP_SIGNALS,
    SOURCES, UNTRUSTED_HEADER,
)
from tessera.functions.text import stripped


def _points(conditions: list[tuple[int, Column]]) -> Column:
    total = F.lit(0)
    for points, condition in conditions:
        total = total + F.when(condition, points).otherwise(0)
    return total


def injection_score(c: Column) -> Column:
    """Points for pseudo tags, and for each pattern of pseudo instructions in what is left without them; 0 for null."""
    bare = F.regexp_replace(c, PSEUDO_TAGS, "")
    return F.coalesce(_points([(2, c.rlike(PSEUDO_TAGS)), *((p, bare.rlike("(?s)" + r if ".*" in r else r)) for p, r in PSEUDO_INSTRUCTIONS)]), F.lit(0))


def injection_level(score: Column) -> Column:
    return F.when(score <= 1, "low").when(score <= 3, "medium").otherwise("high")


def sanitised(c: Column) -> Column:
    bare = F.regexp_replace(c, PSEUDO_TAGS, "")
    marked = F.regexp_replace(F.regexp_replace(bare, POLICY_PREFIX, POLICY_MARK), RULE_PREFIX, RULE_MARK)
    return F.when(injection_score(c) >= 2, marked).otherwise(bare)


def valuable(c: Column) -> Column:
    """Long enough, no short ASCII fragment and no bare link; false for null."""
    s = stripped(c)
    ascii_share = F.length(F.regexp_replace(s, "[^\\x00-\\x7F]", "")) / F.length(s)
    link = s.startswith("http") & (F.size(F.split(s, r"[\s\p{Z}]+")) <= 2)
    return F.coalesce((F.length(s) >= 10) & ~((ascii_share > 0.95) & (F.length(s) < 30)) & ~link, F.lit(False))


def keep_score(c: Column) -> Column:
    s = stripped(c)
    return _points([*((1, s.rlike(p)) for p in KEEP_SIGNALS), (1, F.length(s) > 100), (2, F.length(s) > 300), (1, s.rlike(r"\d"))])


def worth_keeping(c: Column) -> Column:
    s = stripped(c)
    head = F.substring(s, 1, 30)
    skip = F.lit(False)
    for word in SKIP_SIGNALS:
        skip = skip | head.contains(word)
    return F.coalesce((F.length(s) >= 20) & ~skip & (keep_score(c) >= 2) & (F.length(kept_text(c)) >= 10), F.lit(False))


def kept_text(c: Column) -> Column:
    return stripped(F.regexp_replace(stripped(c), KEEP_PREFIX, ""))


def redacted(c: Column) -> Column:
    for pattern in SECRETS:
        c = F.regexp_replace(c, pattern, "$1[REDACTED]")
    return c


def wrapped(c: Column) -> Column:
    plain = c.isNull() | (c == "") | c.startswith("[Z] 引擎错误") | c.startswith("[Z] 无") | c.contains("不可信记忆引用")
    return F.when(plain, c).otherwise(F.concat(F.lit(UNTRUSTED_HEADER), c))


def intent(c: Column) -> Column:
    """The first intent with a word in the text; `learn` therefore hides `auto_learn`, as documented."""
    s, out = stripped(c), None
    for name, first, anywhere in INTENTS:
        hit = F.lit(False)
        for w in first:
            hit = hit | s.startswith(w)
        for w in anywhere:
            # Only the words of this intent are compared in lower case.
            hit = hit | (F.lower(s) if name == "pagerank" else s).contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(DEFAULT_INTENT)


def coerced_source(c: Column, auto: bool = False) -> Column:
    s = F.coalesce(stripped(c), F.lit(""))
    return F.when(s == "", "auto_extract" if auto else "user_direct").when(s.isin(SOURCES), s).otherwise("user_direct")


def valid_workspace(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def url_allowed(c: Column) -> Column:
    """The syntactic part of the fetch guard: http(s), a host, no local and no private or metadata address."""
    host = F.lower(F.regexp_extract(c, r"^(?i)https?://(?:[^/@\s]*@)?([^/:?#\s]+)", 1))
    private = host.rlike(r"^(?:10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|0\.|22[4-9]\.|23\d\.|24\d\.|25[0-5]\.)[\d.]+$")
    local = (host == "localhost") | host.endswith(".localhost")
    return F.coalesce(c.rlike(r"^(?i)https?://") & (host != "") & ~local & ~private, F.lit(False))
