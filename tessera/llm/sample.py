"""Bounded samples by hash, the same whenever they are drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 1 << 30


def by_hash(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """At most `rows` rows of df, chosen by the hash of `key`.

    Rows are thinned by hash to half as many again before they are ordered, so that it is not each partition that sends
    `rows` rows to the driver. total: the rows of df, where they are known.
    """
    total = df.count() if total is None else total
    if total > 1.5 * rows:
        df = df.filter(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(STEPS)) < int(1.5 * rows / total * STEPS))
    return df.orderBy(F.xxhash64(key), key).limit(rows)
