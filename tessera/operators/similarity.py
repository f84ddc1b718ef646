"""Exact set-similarity joins by prefix filtering, and locality-sensitive candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions import text as T
from tessera.runtime import freed, join_sized, materialise, remove, shuffled, work_path


def classes(df: DataFrame, key: str, tokens: str) -> tuple[DataFrame, DataFrame]:
    """(class_id, tokens) of distinct token sets and (key, class_id): rows with equal sets share a class, the smallest key.

    A set's identity is its sorted tokens' 64-bit hash pair, so that the shuffle carries no tokens for the membership.
    """
    named = df.select(F.col(key).alias("key"), F.sort_array(F.array_distinct(tokens)).alias("tokens")).filter(F.size("tokens") > 0)
    # Written, as the tokens are read twice and cost more than the rest.
    hashed = materialise(named.withColumns({f"h{i}": F.xxhash64(F.lit(i), "tokens") for i in (1, 2)}), "token-sets")
    first = hashed.groupBy("h1", "h2").agg(F.min("key").alias("class_id"))
    members = hashed.select("key", "h1", "h2").join(first, ["h1", "h2"]).select("key", "class_id")
    reps = hashed.select("key", "tokens").join(first.select(F.col("class_id").alias("key")), "key", "left_semi").select(F.col("key").alias("class_id"), "tokens")
    return reps, members


SKETCH_WORDS = 4


def sketched(sets: DataFrame) -> DataFrame:
    """(class_id, n, hashes, s0..s3): token hashes, and the parity of the tokens in 256 slots; two sets differ in no more slots than tokens."""
    hashed = sets.select("class_id", F.size("tokens").alias("n"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    one = F.lit(1).cast("long")

    def parity(i: int) -> Column:
        mine = F.filter("hashes", lambda h: F.pmod(h, F.lit(256)).between(64 * i, 64 * i + 63))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(h, F.lit(64)).cast("int"))))

    return hashed.select("*", *[parity(i).alias(f"s{i}") for i in range(SKETCH_WORDS)])


def fitting(na: str, nb: str, a: str, b: str, threshold: float) -> Column:
    """What holds of all sets that are similar: sizes within the ratio, and few differing bits in the sketch words {a}s0.., {b}s0.. ."""
    differing = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (differing * (1 + threshold) <= (F.col(na) + F.col(nb)) * (1 - threshold) + 1e-6) & (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9)


def prefixes(sketches: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(class_id, n, s0..s3, token): the rarest tokens of each set, of which two similar sets must share one."""
    each = sketches.select("class_id", "n", *[f"s{i}" for i in range(SKETCH_WORDS)], F.explode("hashes").alias("token")).join(frequency, "token")
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "token")))
    return ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).drop("r", "df")


def join(left: DataFrame, right: DataFrame, threshold: float, same: bool = False) -> DataFrame:
    """(a, b, similarity) of (class_id, tokens) rows with Jaccard similarity of the threshold or more; exact.

    Tokens are ordered by their frequency in the right side, and each set joins on its rarest ones only. Pairs that
    their sizes or the parity of their tokens rule out are dropped in the join; the rest are verified on the tokens.
    """
    r = sketched(right)
    frequency = r.select(F.explode("hashes").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    if same:
        b = a = prefixes(r, frequency, threshold)
    else:
        lf = sketched(left)
        other = lf.select(F.explode("hashes").alias("token")).distinct()
        counted = frequency.join(other, "token", "full_outer").select("token", F.coalesce("df", F.lit(0)).alias("df"))
        a, b = prefixes(lf, counted, threshold), prefixes(r, counted, threshold)
    words = [f"s{i}" for i in range(SKETCH_WORDS)]
    a = a.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "token", *[F.col(w).alias(f"a{w}") for w in words])
    b = b.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "token", *[F.col(w).alias(f"b{w}") for w in words])
    fits = fitting("na", "nb", "a", "b", threshold)
    met = a.join(b, "token").filter(fits & (F.col("a") < F.col("b")) if same else fits)
    pairs = met.select("a", "b").distinct()
    full = pairs.join(left.toDF("a", "ta"), "a").join(right.toDF("b", "tb"), "b")
    return full.withColumn("similarity", T.jaccard(F.col("ta"), F.col("tb"))).filter(F.col("similarity") >= threshold - 1e-12).drop("ta", "tb")


def banded(sets: DataFrame) -> DataFrame:
    """(class_id, band, h) of (class_id, tokens)."""
    signed = hashing.signatures(sets, "class_id", "tokens")
    return signed.select("class_id", F.posexplode(hashing.bands(F.col("signature"))).alias("band", "h"))


def lsh_join(left: DataFrame, right: DataFrame, threshold: float, same: bool = False) -> DataFrame:
    """(a, b, similarity) of (class_id, tokens) rows that share a minhash band and are as similar as the threshold or more.

    The chance to find a pair of similarity J is 1-(1-J^4)^32: .87 at .5, .9998 at .7. Rows grow with the sets alone,
    so this is the join for low thresholds, where the exact one meets too many pairs.
    """
    a = banded(left).toDF("a", "band", "h")
    b = banded(right).toDF("b", "band", "h")
    met = a.join(b, ["band", "h"])
    pairs = (met.filter("a < b") if same else met).select("a", "b").distinct()
    # What the parity of the tokens or the sizes rule out, most of the pairs, never fetches its tokens.
    words = [f"s{i}" for i in range(SKETCH_WORDS)]
    side = lambda sets, x: sketched(sets).select(F.col("class_id").alias(x), F.col("n").alias(f"n{x}"), *[F.col(w).alias(f"{x}{w}") for w in words])
    fits = fitting("na", "nb", "a", "b", threshold)
    pairs = materialise(pairs.join(side(left, "a"), "a").join(side(right, "b"), "b").filter(fits).select("a", "b"), "fitting")
    full = pairs.join(left.toDF("a", "ta"), "a").join(right.toDF("b", "tb"), "b")
    return full.withColumn("similarity", T.jaccard(F.col("ta"), F.col("tb"))).filter(F.col("similarity") >= threshold).drop("ta", "tb")


def lsh_pairs(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """(a, b, similarity) of the token-set classes of one table that share a minhash band and are as similar as the threshold or more.

    Tokens are written once, and only those of sets in some pair are shuffled. The bands of a class, of all its tokens, are
    shuffled once for both sides, with its size and the parity of its tokens, so that what these rule out is dropped in the join.
    """
    spark = df.sparkSession
    path, classes_path, pairs_path = work_path(spark, "token-sets"), work_path(spark, "classes"), work_path(spark, "fitting")
    named = df.select(F.col(key).alias("key"), F.sort_array(F.array_distinct(T.tokens(F.col(text)))).alias("tokens")).filter("key is not null and size(tokens) > 0")
    written = materialise(named.withColumns({f"h{i}": F.xxhash64(F.lit(i), "tokens") for i in (1, 2)}), "token-sets", path)
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("key"))
    with freed(spark):
        numbered = materialise(written.select("key", "h1", "h2").distinct().withColumn("nth", nth), "classes", classes_path)
    first, rest = (numbered.filter(x).select("key", "h1", "h2") for x in ("nth = 1", "nth > 1"))
    firsts, rests = first.count(), rest.count()
    # Whichever is fewer tells the first of each class from the others.
    small, how, rows = (first, "left_semi", firsts) if firsts < rests else (rest, "left_anti", rests)
    sets = join_sized(written, small, ["key", "h1", "h2"], how, rows).select("key", "tokens")
    a, b = (x := hashing.banded_sets(sets, "key", "tokens")).alias("a"), x.alias("b")
    total, differing = F.col("a.n") + F.col("b.n"), F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch")))
    fits = (differing * (1 + threshold) <= total * (1 - threshold) + 1e-6) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9)
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.key") < F.col("b.key")) & fits)
    with freed(spark), shuffled(spark, firsts * hashing.BANDS, 40):
        pairs = materialise(met.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct(), "fitting", pairs_path)
    wanted = materialise(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "wanted")
    with freed(spark):
        found = materialise(join_sized(sets, wanted, "key", "left_semi").dropDuplicates(["key"]), "wanted-tokens")
    remove(spark, path, classes_path)
    full = pairs.join(found.toDF("a", "ta"), "a").join(found.toDF("b", "tb"), "b")
    with freed(spark):
        similar = full.withColumn("similarity", T.jaccard(F.col("ta"), F.col("tb"))).filter(F.col("similarity") >= threshold)
        out = materialise(similar.select("a", "b", "similarity"), "similar")
    remove(spark, pairs_path)
    return out
