"""Three layers of conflict between notes: stated, lexical, propagated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions import text as T
from tessera.functions.fixed import OPPOSITES
from tessera.operators.graph import both_ways


def stated(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs joined by a `contradicts` edge."""
    return edges.filter("type = 'contradicts'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()


def lexical(nodes: DataFrame, opposites: list[list[str]] = OPPOSITES, most_bits: int = 12, buckets: int = 3) -> DataFrame:
    """(a, b), a < b: notes within `most_bits` bits of simhash, in the same bucket or one of the next three, one of which has
    a token whose opposite the other has.

    Only notes with such a token take part, and they meet on bucket and opposite token, not bucket alone.
    """
    pairs = [(a, b) for x, y in opposites for a, b in ((x, y), (y, x))]
    table = nodes.sparkSession.createDataFrame(sorted(set(pairs)), "token string, opposite string")
    held = nodes.filter("simhash <> 0").select("id", "simhash", F.explode(T.token_set(F.col("text"))).alias("token"))
    held = held.join(F.broadcast(table), "token").withColumn("bucket", F.col("simhash").bitwiseAND(15))  # a fixed table of 64 rows
    a = held.select(F.col("id").alias("x"), F.col("simhash").alias("hx"), F.col("opposite").alias("meets"), F.explode(F.array(*[F.lit(d) for d in range(buckets + 1)])).alias("d"), "bucket")
    a = a.select("x", "hx", "meets", ((F.col("bucket") + F.col("d")) % 16).alias("bucket"))
    b = held.select(F.col("id").alias("y"), F.col("simhash").alias("hy"), F.col("token").alias("meets"), "bucket")
    met = a.join(b, ["bucket", "meets"]).filter((F.col("x") != F.col("y")) & (hashing.hamming(F.col("hx"), F.col("hy")) <= most_bits))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def propagated(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: notes of which one causes and the other contradicts the same note."""
    links = both_ways(edges)
    causes = links.filter("type = 'cause'").select(F.col("src").alias("c"), "dst")
    contradicts = links.filter("type = 'contradicts'").select(F.col("src").alias("d"), "dst")
    met = causes.join(contradicts, "dst").filter("c <> d")
    return met.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def all_layers(nodes: DataFrame, edges: DataFrame, opposites: list[list[str]] = OPPOSITES) -> DataFrame:
    """(a, b, layer): each pair with the first layer that finds it."""
    layers = [stated(edges), lexical(nodes, opposites), propagated(edges)]
    each = None
    for i, rows in enumerate(layers, 1):
        rows = rows.withColumn("layer", F.lit(i))
        each = rows if each is None else each.unionByName(rows)
    return each.groupBy("a", "b").agg(F.min("layer").alias("layer"))
