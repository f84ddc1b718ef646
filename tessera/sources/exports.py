"""Sinks: projections of the store as JSON, CSV, GraphML, Markdown, Mermaid and vault pages, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.fixed import EDGE_STYLES, UNCATEGORISED


def escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    label = escaped(F.substring(F.coalesce("text", F.lit("")), 1, 50))
    return nodes.select("id", F.format_string('  <node id="n%d"><data key="label">%s</data></node>', "id", label).alias("line"))


def pairs(edges: DataFrame) -> DataFrame:
    """(a, b, type): each unordered pair once, with the first type in the alphabet."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("type").alias("type"))


def graphml_edges(edges: DataFrame) -> DataFrame:
    return pairs(edges).select(F.format_string('  <edge source="n%d" target="n%d"/>', "a", "b").alias("line"))


def mermaid_nodes(nodes: DataFrame) -> DataFrame:
    label = F.replace(F.substring("text", 1, 30), F.lit('"'), F.lit("'"))
    return nodes.select("id", F.format_string('  N%d["[%s] %s"]', "id", F.coalesce("category", F.lit(UNCATEGORISED)), label).alias("line"))


def mermaid_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Lines for the pairs among the nodes of (id)."""
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    style = F.coalesce(F.create_map(*[F.lit(x) for kv in EDGE_STYLES.items() for x in kv])[F.col("type")], F.lit("---"))
    return pairs(inside).select(F.format_string("  N%d %s|%s| N%d", "a", style, "type", "b").alias("line"))


def csv_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "workspace", "category", "text", F.array_join("tags", ",").alias("tags"), "confidence", "learned_at")


def json_rows(nodes: DataFrame, word: str = "") -> DataFrame:
    rows = nodes.filter(F.lower("text").contains(word.lower())) if word else nodes
    return rows.select("id", "text", "category", F.array_join("tags", ",").alias("tags"), "confidence", "source")


def markdown_lines(nodes: DataFrame) -> DataFrame:
    """(category, id, line); grouped and ordered by the writer."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" `#"), F.array_join("tags", ", "), F.lit("`"))).otherwise("")
    percent = F.floor(F.col("confidence") * 100 + 0.5).cast("int")
    shown = F.concat(F.lit(" (置信度:"), (percent / 100).cast("int").cast("string"), F.lit("."), F.lpad((percent % 100).cast("string"), 2, "0"), F.lit(")"))
    confidence = F.when(F.col("confidence") < 1, shown).otherwise("")
    line = F.concat(F.lit("- **#"), F.col("id").cast("string"), F.lit("** "), F.col("text"), tags, confidence)
    return nodes.select(F.coalesce("category", F.lit(UNCATEGORISED)).alias("category"), "id", line.alias("line"))


def folder(c: Column) -> Column:
    category = F.coalesce(c, F.lit(UNCATEGORISED))
    return (
        F.when(category.isin("踩坑", "踩坑库"), "04-踩坑库").when(category.isin("未分类", "_待分类_", ""), "00-收件箱").when(category.isin("项目管理", "项目"), "01-项目")
        .when(category.isin("方法论", "Skills", "SOP"), "05-Skills").when(category.isin("输出", "报告"), "03-输出").otherwise(F.concat(F.lit("02-知识库/"), T.safe_filename(category, 20)))
    )


def vault_pages(nodes: DataFrame, word: str = "") -> DataFrame:
    """(id, folder, filename, content) of the notes that a vault gets: not archived, ten characters or more."""
    rows = nodes.filter(F.coalesce(F.col("status") != "archived", F.lit(True)) & (F.length(F.trim("text")) >= 10))
    if word:
        rows = rows.filter(F.lower("text").contains(word.lower()))
    category = F.coalesce("category", F.lit(UNCATEGORISED))
    heading = T.title(F.col("text"))
    name = F.coalesce(T.safe_filename(heading, 35), T.safe_filename(category, 20))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]\n"))).otherwise("")
    head = F.concat(
        F.lit("---\nnode_id: "), F.col("id").cast("string"), F.lit("\ncategory: "), category, F.lit("\nsource: "), F.coalesce("source", F.lit("")),
        F.lit("\ncreated: "), F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("")), F.lit("\n"), tags, F.lit("---\n\n"),
    )
    return rows.select("id", folder(F.col("category")).alias("folder"), F.concat(name, F.format_string("-%06d.md", "id")).alias("filename"), F.concat(head, F.col("text")).alias("content"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Ordered lines as text files: range-partitioned, so that the parts in the order of their names are the whole."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_pages(pages: DataFrame, root: str) -> None:
    """A vault: one Markdown file a page, written by the executors to a file system that they share.

    root is a URI of any file system that Arrow knows (hdfs, s3, gs, file). A path of the machine itself is taken only from a
    session on one machine, or where the folder is the shared one that spark.checkpoint.dir names.
    """
    spark = pages.sparkSession
    local = root.startswith(("/", "file:"))
    base = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://")
    if local and not spark.sparkContext.master.startswith("local[") and not (base and root.removeprefix("file://").startswith(base)):
        raise ValueError(f"{root} is a folder of each machine's own")

    def write(rows) -> None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
        made = set()
        for r in rows:
            if r.folder not in made:
                system.create_dir(f"{path}/{r.folder}", recursive=True)
                made.add(r.folder)
            with system.open_output_stream(f"{path}/{r.folder}/{r.filename}") as f:
                f.write(r.content.encode())

    pages.foreachPartition(write)
