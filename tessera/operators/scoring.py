"""Scores over time; every one refers to an explicit time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import elapsed_days


def confidence_decay(nodes: DataFrame, as_of: str, half_life: float = 30, least_change: float = 0.01) -> DataFrame:
    """(id, old, new, days): confidence after exponential decay since the last access, with a bonus for accesses, where it changes."""
    days = elapsed_days(as_of, "last_accessed_at", "learned_at")
    bonus = F.least(F.lit(1.0), F.coalesce("access_count", F.lit(0)) / 20)
    new = F.greatest(F.lit(0.1), F.col("confidence") * F.exp(-math.log(2) / half_life * F.col("days")) + bonus * 0.3)
    rows = nodes.withColumn("days", days).filter("days > 0").withColumn("new", new)
    rows = rows.filter(F.abs(F.col("new") - F.col("confidence")) > least_change)
    return rows.select("id", F.round("confidence", 4).alias("old"), F.round("new", 4).alias("new"), F.round("days", 1).alias("days"))


def trust_decay(nodes: DataFrame, as_of: str, stale_days: int = 30, rate: float = 0.9) -> DataFrame:
    """(id, old, new): trust of notes not accessed for stale_days or never, decayed less the more they were accessed before."""
    trust = F.coalesce("trust_score", "confidence", F.lit(1.0))
    stale = F.col("last_accessed_at").isNull() | (F.col("last_accessed_at") < F.expr(f"timestamp_ntz'{as_of}' - interval {stale_days} days"))
    kept = rate + (1 - rate) * F.least(F.lit(1.0), F.coalesce("access_count", F.lit(0)) / 20) * 0.5
    rows = nodes.filter(stale).withColumn("old", trust).filter("old > 0.1")
    rows = rows.withColumn("new", F.round(F.greatest(F.lit(0.1), F.col("old") * kept), 2))
    return rows.filter("abs(new - old) >= 0.01").select("id", "old", "new")
