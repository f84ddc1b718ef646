"""Keyword-rule classification, category merging, PARA classes."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.fixed import CATEGORY_MERGE, CATEGORY_RULES, GENERAL, PARA_OF_CATEGORY, TO_CATEGORISE, WEAK_CATEGORIES
from tessera.functions.text import maintenance_keywords

BUILT_IN = [(c, w) for c, words in CATEGORY_RULES for w in words]
RULES = "category string, keyword string, source string"


def seeded(spark: SparkSession) -> DataFrame:
    """The table of the seeded rules (category, keyword, source)."""
    return spark.createDataFrame([(c, w, "seed") for c, w in BUILT_IN], RULES)


def listed(rules: DataFrame) -> list[tuple[str, str]]:
    """The (category, keyword) rules of a rule table, which people write and which is therefore small."""
    wanted = rules.filter("category is not null and keyword <> ''").select("category", F.lower("keyword").alias("keyword")).distinct()
    return [(r.category, r.keyword) for r in wanted.orderBy("category", "keyword").collect()]


@cache
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        found.add_word(w, i)
    found.make_automaton()
    return found


def _best(texts: Iterable[str | None], rules: tuple[tuple[str, str], ...], weighted: bool) -> list[str | None]:
    words = tuple(dict.fromkeys(w for _, w in rules if w))
    number = {w: i for i, w in enumerate(words)}
    of: list[list[str]] = [[] for _ in words]
    for category, word in rules:
        if word:
            of[number[word]].append(category)
    points = [2 if weighted and len(w) >= 3 else 1 for w in words]
    if not words:
        return [None for _ in texts]
    automaton, out = _automaton(words), []
    for text in texts:
        score: dict[str, int] = {}
        for i in {i for _, i in automaton.iter(text)} if text else ():
            for category in of[i]:
                score[category] = score.get(category, 0) + points[i]
        out.append(min(score, key=lambda c: (-score[c], c)) if score else None)
    return out


def best_category(hay: Column, rules: list[tuple[str, str]] = BUILT_IN, weighted: bool = True) -> Column:
    """The category whose words occur in the lower-case text with the most points, or null.

    weighted: a word of three characters or more counts two, else each counts one. Ties go to the alphabetically first
    category. Each text is read once, whatever the number of rules, by an automaton of all words over Arrow batches; as native
    tests, one for each of some 200 words, the same took four times as long.
    """
    given = tuple((c, w) for c, w in rules)

    @F.pandas_udf("string")
    def best(texts: pd.Series) -> pd.Series:
        return pd.Series(_best(texts, given, weighted), dtype=object)

    return best(hay)


def classify(text: Column, tags: Column, source: Column, rules: list[tuple[str, str]] = BUILT_IN) -> Column:
    hay = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(F.array_join(tags, " "), F.lit(""))))
    rss = F.lower(F.coalesce(source, F.lit(""))).contains("rss")

    fallback = F.when(rss, "实时热点").when(hay.contains("http") | hay.contains("www."), "资源").otherwise(TO_CATEGORISE)
    return F.coalesce(best_category(hay, rules), fallback)


def classify_simply(text: Column, rules: list[tuple[str, str]] = BUILT_IN) -> Column:
    return F.coalesce(best_category(F.lower(text), rules, weighted=False), F.lit(TO_CATEGORISE))


def _lookup(c: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], default)


def merged(c: Column) -> Column:
    return _lookup(c, CATEGORY_MERGE, c)


def normalised(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", GENERAL).otherwise(merged(c))


def para_of(c: Column) -> Column:
    return _lookup(c, PARA_OF_CATEGORY, F.lit("R"))


def weak(c: Column) -> Column:
    return F.coalesce(c.isin(WEAK_CATEGORIES), F.lit(True))


def reclassified(nodes: DataFrame, only_weak: bool = True, rules: list[tuple[str, str]] = BUILT_IN) -> DataFrame:
    """(id, old, category, para): the rows whose category changes, with the merged category and the PARA class they get."""
    rows = nodes.filter(weak(F.col("category"))) if only_weak else nodes
    new = rows.withColumn("new", classify(F.col("text"), F.col("tags"), F.col("source"), rules)).filter(~F.col("new").eqNullSafe(F.col("category")))
    category = merged(F.col("new"))
    return new.select("id", F.col("category").alias("old"), category.alias("category"), F.coalesce(F.when(F.col("para") != "", F.col("para")), para_of(category)).alias("para"))


def classified(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, category) of every row by the rules of a table (category, keyword, source)."""
    return nodes.select("id", classify(F.col("text"), F.col("tags"), F.col("source"), listed(rules)).alias("category"))


def learned_rules(nodes: DataFrame, k: int = 5) -> DataFrame:
    """(category, keyword, source): keywords of notes that were waiting for a category and got one."""
    got = reclassified(nodes).filter((F.col("old") == TO_CATEGORISE) & (F.col("category") != TO_CATEGORISE))
    words = got.join(nodes.select("id", "text"), "id").select("category", F.explode(maintenance_keywords(F.col("text"), k)).alias("keyword"))
    return words.distinct().withColumn("source", F.lit("learned"))


def with_rules(rules: DataFrame, category: str, words: str, source: str = "user") -> DataFrame:
    """The rule table (category, keyword, source) with a comma-separated list of words added, each once."""
    new = rules.sparkSession.createDataFrame([(category, w.strip(), source) for w in words.replace("，", ",").split(",") if w.strip()], "category string, keyword string, source string")
    fresh = new.dropDuplicates(["category", "keyword"]).join(rules, ["category", "keyword"], "left_anti")
    return rules.unionByName(fresh)
