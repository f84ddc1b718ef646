"""Sources: legacy JSON stores, Markdown vaults, edge lists in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.fixed import FOLDER_CATEGORY, PROTECTED_FOLDERS, TO_CATEGORISE

LEGACY = "id long, text string, workspace string, category string, tags array<string>, confidence double, learned_at string, source string"


def legacy_json(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of files {"nodes": [...]}, each id once, with defaults for what is missing."""
    fields = ",".join(f"{n}:{k}" for n, k in (f.split(" ") for f in LEGACY.split(", ")))
    read = spark.read.schema(f"nodes array<struct<{fields}>>").option("multiLine", True).json(path)
    return with_defaults(read.select(F.explode("nodes").alias("n")).select("n.*"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Legacy rows with an id, each id once (the first learned), with defaults for what is missing."""
    filled = rows.filter("id is not null").withColumns(
        {
            "workspace": F.coalesce("workspace", F.lit("global")),
            "category": F.coalesce("category", F.lit(TO_CATEGORISE)),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "confidence": F.coalesce("confidence", F.lit(1.0)),
            "source": F.coalesce("source", F.lit("user_direct")),
        }
    )
    first = F.row_number().over(Window.partitionBy("id").orderBy("learned_at", "text"))
    return filled.withColumn("r", first).filter("r = 1").drop("r")


def parsed_edges(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, pos, target, type, weight, ok): the entries of JSON edge lists. A list that can't be read has none; an entry that is no object or
    whose target is no number stays, as not ok, and spoils no other.
    """
    kept = df.select(key, F.posexplode(F.from_json(F.col(raw), "array<string>")).alias("pos", "e"))
    target = F.get_json_object("e", "$.target").try_cast("long")
    weight = F.get_json_object("e", "$.weight").try_cast("double")
    return kept.select(
        key, "pos", target.alias("target"), F.coalesce(F.get_json_object("e", "$.type"), F.lit("related")).alias("type"),
        F.coalesce(F.when(weight != 0, weight), F.lit(1.0)).alias("weight"), target.isNotNull().alias("ok"),
    )


def dumped_edges(edges: DataFrame) -> DataFrame:
    """(src, edges_json): each node's edges as a JSON list, each (target, type) once, in order of target and type."""
    best = edges.groupBy("src", "dst", "type").agg(F.round(F.max("weight"), 4).alias("weight"))
    each = best.select("src", F.struct(F.col("dst").alias("target"), "type", "weight").alias("e"))
    return each.groupBy("src").agg(F.to_json(F.array_sort(F.collect_list("e"))).alias("edges_json"))


def category_of_path(path: Column) -> Column:
    """The category of the last folder of a path that has one."""
    names = F.create_map(*[F.lit(x) for kv in FOLDER_CATEGORY.items() for x in kv])
    known = F.filter(F.transform(F.split(path, "/"), lambda p: names[p]), lambda c: c.isNotNull())
    return F.when(F.size(known) > 0, F.element_at(known, -1)).otherwise(TO_CATEGORISE)


def vault(spark: SparkSession, root: str) -> DataFrame:
    """(path, node_id, category, text, digest): the pages of a Markdown vault with a body of ten characters or more, outside protected folders."""
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    rows = read.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), "value")
    inside = F.split(F.regexp_replace("path", "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", ""), "/")
    rows = rows.filter(~F.arrays_overlap(inside, F.array(*[F.lit(p) for p in PROTECTED_FOLDERS])))
    fields, text = T.front_matter(F.col("value")), T.body(F.col("value"))
    out = rows.select("path", F.try_element_at(fields, F.lit("node_id")).try_cast("long").alias("node_id"), category_of_path(F.col("path")).alias("category"), text.alias("text"))
    return out.filter(F.length("text") >= 10).withColumn("digest", F.sha1(F.encode("text", "utf-8")))


def merged_vault(nodes: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text) of nodes whose page has changed, and the pages that are new: unknown id, a digest not in the store, each digest once."""
    changed = pages.join(nodes.select(F.col("id").alias("node_id"), F.col("text").alias("old")), "node_id").filter("text <> old")
    unknown = pages.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    known = nodes.select(F.sha1(F.encode(T.stripped(F.col("text")), "utf-8")).alias("digest"))
    first = F.row_number().over(Window.partitionBy("digest").orderBy("path"))
    fresh = unknown.join(known, "digest", "left_anti").withColumn("r", first).filter("r = 1").drop("r")
    return changed.select(F.col("node_id").alias("id"), "text"), fresh.select("path", "category", "text", "digest", F.lit(0.8).alias("confidence"))
