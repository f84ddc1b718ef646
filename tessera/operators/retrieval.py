"""Searching: substring, full text with BM25, merged strategies, questions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions import text as T
from tessera.functions.fixed import ERROR_WORDS
from tessera.runtime import against_all

STATUS_RANK = {"confirmed": 0, "active": 1, "pending": 2, "disputed": 3, "archived": 9}


def like(nodes: DataFrame, word: str, k: int = 20) -> DataFrame:
    """Nodes whose text or category holds the word in any case, by id."""
    w = word.lower()
    hit = F.lower("text").contains(w) | F.lower("category").contains(w)
    return nodes.filter(hit).orderBy("id").limit(k)


def terms_of(phrase: str) -> list[str]:
    """The terms of a phrase that full text can search: words of three characters or more."""
    return [t for t in re.findall(r"[\w一-鿿]+", phrase.lower()) if len(t) >= 3]


def _columns(nodes: DataFrame) -> DataFrame:
    tags = F.coalesce(F.array_join("tags", ","), F.lit(""))
    return nodes.withColumns({"_t": F.lower(F.coalesce("text", F.lit(""))), "_c": F.lower(F.coalesce("category", F.lit(""))), "_g": F.lower(tags)})


def full_text(nodes: DataFrame, phrase: str) -> DataFrame:
    """Nodes with every term of the phrase in text, category or tags; none where it has no term of three characters."""
    out = _columns(nodes)
    terms = terms_of(phrase)
    for t in terms:
        out = out.filter(F.col("_t").contains(t) | F.col("_c").contains(t) | F.col("_g").contains(t))
    return (out if terms else out.filter(F.lit(False))).drop("_t", "_c", "_g")


def bm25(nodes: DataFrame, phrase: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, rank) of the nodes that match the phrase; smaller is better. Lengths are counted in trigrams.

    The collection's numbers (rows, mean length, rows with each term) are one aggregated row, which is broadcast.
    """
    terms = terms_of(phrase)
    size = sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in ("_t", "_c", "_g")), F.lit(0))
    counts = {f"f{i}": sum((T.occurrences(F.col(c), t) for c in ("_t", "_c", "_g")), F.lit(0)) for i, t in enumerate(terms)}
    counted = _columns(nodes).select("id", size.alias("d"), *[c.alias(n) for n, c in counts.items()])
    whole = counted.agg(F.count(F.lit(1)).alias("rows"), F.avg("d").alias("mean"), *[F.sum((F.col(n) > 0).cast("int")).alias(f"has_{n}") for n in counts])
    rank = F.lit(0.0)
    hit = F.lit(bool(terms))
    for n in counts:
        idf = F.log((F.col("rows") - F.col(f"has_{n}") + 0.5) / (F.col(f"has_{n}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        rank = rank - idf * F.col(n) * (k1 + 1) / (F.col(n) + k1 * (1 - b + b * F.col("d") / F.col("mean")))
        hit = hit & (F.col(n) > 0)
    return counted.crossJoin(F.broadcast(whole)).filter(hit).select("id", F.round(rank, 6).alias("rank"))


def trust(prefix: str = "") -> Column:
    return F.coalesce(F.col(f"{prefix}trust_score"), F.col(f"{prefix}confidence"), F.lit(0.0))


def status_rank(c: Column) -> Column:
    s, out = F.coalesce(c, F.lit("active")), None
    for status, rank in STATUS_RANK.items():
        out = F.when(s == status, rank) if out is None else out.when(s == status, rank)
    return out.otherwise(5)


def visible(nodes: DataFrame, phrase: str, para: str = "", k: int = 20) -> DataFrame:
    """The rows shown for a phrase: full text first; where that is short of k, the phrase's simhash bucket; where both
    are, rows that hold one of its words, up to 3k in all, by id. Ranked by status, trust and id. An empty phrase lists all rows.
    """
    k = max(1, min(k, 50))
    if not phrase.strip():
        found = nodes
    else:
        first = bm25(nodes, phrase).orderBy("rank", "id").limit(min(2 * k, 40)).select("id", F.lit(1).alias("path"))
        bucket = hashing.simhash_of(phrase) & 15
        near = nodes.filter((F.col("simhash") != 0) & (F.col("simhash").bitwiseAND(15) == bucket)).select("id", F.lit(2).alias("path"))
        held = F.lower("text").contains(phrase.lower())
        for w in phrase.lower().split():
            if len(w) >= 2:
                held = held | F.lower("text").contains(w)
        words = nodes.filter(held).orderBy("id").limit(3 * k + 40).select("id", F.lit(3).alias("path"))
        each = first.unionByName(near).unionByName(words).groupBy("id").agg(F.min("path").alias("path"))
        n1 = each.filter("path = 1").agg(F.count(F.lit(1)).alias("n1"))
        n2 = each.filter("path = 2").agg(F.count(F.lit(1)).alias("n2"))
        counted = each.crossJoin(F.broadcast(n1)).crossJoin(F.broadcast(n2))  # one row each
        taken = F.col("n1") + F.when(F.col("n1") < k, F.col("n2")).otherwise(0)
        third = counted.filter((F.col("path") == 3) & (F.col("n1") < k) & (taken < k)).withColumn("room", 3 * k - taken)
        # At most 3k + 40 rows come this far, so one ordered window is small.
        third = third.withColumn("r", F.row_number().over(Window.orderBy("id"))).filter("r <= room")
        chosen = counted.filter(f"path = 1 or (path = 2 and n1 < {k})").select("id").unionByName(third.select("id"))
        found = nodes.join(chosen, "id", "left_semi")
    if para.upper() in ("P", "A", "R", "X"):
        found = found.filter(F.upper("para") == para.upper())
    return found.orderBy(status_rank(F.col("status")), F.desc(F.round(trust() + 0.02, 9)), F.desc("id")).limit(k)


def find(nodes: DataFrame, phrase: str, as_of: str, workspace: str | None = None, k: int = 10) -> DataFrame:
    """(id, similarity, velocity): the node with the phrase's own simhash alone, if there is one (the largest id); else nodes
    that share a token with it or lie within 5 bits in its bucket; else nodes that hold it. Best similarity, then velocity.
    """
    rows = nodes if workspace is None else nodes.filter(F.col("workspace") == workspace)
    h = hashing.simhash_of(phrase)
    rows = rows.withColumn("_tokens", T.token_set(F.col("text")))
    wanted = T.token_set(F.lit(phrase))
    sh = F.coalesce("simhash", F.lit(0))
    shares = F.arrays_overlap("_tokens", wanted)
    near = (sh != 0) & (sh.bitwiseAND(15) == (h & 15)) & (hashing.hamming(sh, F.lit(h)) <= 5)
    path = F.when(sh == h, 0).when(shares | near, 1).when(F.col("text").contains(phrase), 2)
    scored = rows.withColumn("path", path).filter("path is not null")
    similarity = F.round(T.jaccard(F.col("_tokens"), wanted), 4)
    scored = scored.select("id", "path", F.when(similarity > 0.3, similarity).otherwise(0.0).alias("similarity"), F.round(velocity(as_of), 6).alias("velocity"))
    best = scored.agg(F.min("path").alias("best"))
    scored = scored.crossJoin(F.broadcast(best)).filter("path = best")  # one row
    # An exact hit is single; the last writer holds the hash.
    hits = scored.filter("path = 0").agg(F.max("id").alias("id")).filter("id is not null")
    rest = scored.filter("path > 0").orderBy(F.desc("similarity"), F.desc("velocity"), "id").limit(k)
    return scored.filter("path = 0").join(hits, "id", "left_semi").select("id", "similarity", "velocity").unionByName(rest.select("id", "similarity", "velocity"))


def elapsed_days(as_of: str, *columns: str) -> Column:
    """Days from the first of the columns that is not null to as_of; null where all are."""
    return F.expr(f"timestampdiff(SECOND, coalesce({', '.join(columns)}), timestamp_ntz'{as_of}')") / 86400.0


def velocity(as_of: str) -> Column:
    """Accesses a day since the last access, at least a day; 365 days where no time is known."""
    days = F.coalesce(F.floor(elapsed_days(as_of, "last_accessed_at", "learned_at")), F.lit(365))
    return F.coalesce("access_count", F.lit(0)) / F.greatest(days, F.lit(1))


def context_score(as_of: str) -> Column:
    """Status bonus, trust, accesses and recency."""
    status = F.coalesce("status", F.lit("active"))
    bonus = F.when(status == "confirmed", 0.35).when(status == "active", 0.2).when(status == "pending", 0.05).otherwise(0.0)
    access = F.coalesce("access_count", F.lit(0))
    days = elapsed_days(as_of, "last_accessed_at", "learned_at", "created_at")
    old = F.least(F.lit(0.15), 0.003 * (days - 30)) * (1 - F.least(F.lit(1.0), access / 15.0) * 0.7)
    recency = F.when(days.isNull(), 0.0).when(days <= 7, F.greatest(F.lit(0.0), 0.1 * (1 - days / 7.0))).when(days > 30, -old).otherwise(0.0)
    return bonus + trust() + F.least(access, F.lit(10)) / 100.0 + recency


def pre_answer(nodes: DataFrame, message: str, as_of: str, k: int = 5, least: float = 0.55) -> DataFrame:
    """(id, score, pitfall): visible rows for a message with a context score of `least` or more, the best ten."""
    failing = any(w in message.lower() for w in ERROR_WORDS)
    rows = visible(nodes, message, k=3 * k).withColumn("score", F.round(context_score(as_of), 6)).filter(F.col("score") >= least)
    pitfall = F.lit(failing) & F.coalesce(F.col("category") == "踩坑库", F.lit(False))
    return rows.select("id", "score", pitfall.alias("pitfall")).orderBy(F.desc("score"), "id").limit(10)


def questions(nodes: DataFrame, batch: DataFrame, k: int = 5, least: float = 0.05, block: int = 10_000) -> DataFrame:
    """(question_id, id, score, rank): the k best nodes for each row of (question_id, question), a stated set, which is broadcast in blocks."""
    asked = batch.select("question_id", "question", F.array_distinct(T.question_tokens(F.col("question"))).alias("q"))
    n = F.length("question")
    spans = F.flatten(
        F.transform(F.sequence(F.lit(2), F.lit(6)), lambda w: F.when(n >= w, F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substring("question", i, w))).otherwise(F.array().cast("array<string>")))
    )
    asked = asked.withColumn("words", F.array_distinct(F.filter(spans, lambda w: w.rlike(T.CJK_ONLY))))
    rows = nodes.filter("status <> 'merged'").select("id", "text", "confidence", "tags").withColumn("t", F.array_distinct(T.question_tokens(F.col("text"))))
    both = against_all(rows, asked, block)
    hits = F.aggregate("words", F.lit(0.0), lambda acc, w: acc + F.when(F.col("text").contains(w), 0.15).otherwise(0.0) + F.when(F.array_contains("tags", w), 0.1).otherwise(0.0))
    score = T.jaccard(F.col("q"), F.col("t"), 0.0) * 0.6 + F.least(hits, F.lit(0.4)) + F.coalesce("confidence", F.lit(0.5)) * 0.05
    scored = both.select("question_id", "id", "confidence", F.round(score, 6).alias("score")).filter(F.col("score") >= least)
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("confidence"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("question_id", "id", "score", "rank")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.5, "高").when(score >= 0.3, "中").otherwise("低")


def quick(nodes: DataFrame, word: str, k: int = 10) -> DataFrame:
    w = word.lower()
    hit = F.lower("text").contains(w) | F.lower("category").contains(w) | F.lower(F.array_join("tags", ",")).contains(w)
    return nodes.filter(F.coalesce(hit, F.lower("text").contains(w))).filter("status <> 'merged'").orderBy(F.desc("confidence"), "id").limit(k)


def by_text(nodes: DataFrame, text: str) -> DataFrame:
    """(id): the first node with exactly this text, else the first that holds it."""
    path = F.when(F.col("text") == text, 0).when(F.col("text").contains(text), 1)
    return nodes.withColumn("path", path).filter("path is not null").orderBy("path", "id").limit(1).select("id")
