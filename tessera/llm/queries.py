"""The queries of the training-data operators; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import history as _history
from tessera.llm import leakage as _leakage
from tessera.llm import ledger as _ledger
from tessera.llm import neardup as _neardup
from tessera.llm import packing as _packing
from tessera.llm import pii as _pii
from tessera.llm import residue as _residue
from tessera.llm import subjects as _subjects
from tessera.llm.oracle import ORACLE_SQL  # noqa: F401  (the entry point reads it from here)
from tessera.runtime import load, materialise


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pending note that repeats an accepted node, with the smallest id of those it repeats.

    All days go through the index at once: it holds nodes only here, and what one day brings is no case for another.
    """
    stored = _history.History.build(load(spark, sf_dir, "nodes").select("id", "text"))
    pending = load(spark, sf_dir, "pending").select(F.col("id").alias("batch_id"), F.col("content").alias("text"))
    return _history.History.open(spark, stored.path).match(pending).select(F.col("batch_id").alias("pending_id"), "node_id")


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pending note after its day's batch: the accepted note that it repeats (a node, or a note of an earlier day), or its new id."""
    nodes = load(spark, sf_dir, "nodes").select("id", "text")
    pending = load(spark, sf_dir, "pending").select(F.col("id").alias("batch_id"), F.col("content").alias("text"), F.to_date("created_at").alias("day"))
    stored = _history.History.build(nodes)
    first_id = (nodes.agg(F.max("id")).first()[0] or 0) + 1
    rows = _history.accept_backlog(_history.History.open(spark, stored.path), pending, first_id)
    return rows.select(F.col("batch_id").alias("pending_id"), "node_id", "new_id")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, "nodes")
    chains = _subjects.fit_on(nodes, load(spark, sf_dir, "subject_labels"), load(spark, sf_dir, "subjects"))
    return _subjects.assign(nodes, chains)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node and each subject that it speaks of."""
    return _assigned(spark, sf_dir).select("node_id", "subject")


def p2_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes speak of each subject, and the store's weight of it."""
    return _subjects.composition(_assigned(spark, sf_dir))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir, "nodes").select(F.lit("nodes").alias("tbl"), F.col("id").cast("string").alias("rec_id"), "text")
    return nodes.unionByName(
        load(spark, sf_dir, "pending").select(F.lit("pending").alias("tbl"), F.col("id").alias("rec_id"), F.col("content").alias("text"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of personal information in nodes and pending notes."""
    return _pii.find(_notes(spark, sf_dir)).select("tbl", "rec_id", "kind", "nth")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node and pending note with typed placeholders in place of its mentions."""
    return _pii.redacted(_notes(spark, sf_dir))


def _ledger_of_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, _ledger.Ledger]:
    """Nodes with keys, and the ledger after two batches: what was learned on time, then the late and undated rows."""
    nodes = load(spark, sf_dir, "nodes")
    late = F.coalesce(F.col("created_at") < F.col("learned_at") - F.expr("interval 1 day"), F.lit(True))
    keyed = materialise(
        _ledger.with_copy_key(nodes.select("id", F.col("text").alias("_text"), late.alias("late")), "_text").select(
            "id", "k1", "k2", "late"
        ),
        "p4-keys",
    )
    ledger = _ledger.Ledger(spark)
    for flag, name in ((False, "on time"), (True, "late")):
        ledger.update(keyed.filter(F.col("late") == flag), name)
    return keyed.select("id", "k1", "k2"), ledger


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node that is a copy of another, with the smallest id of its group."""
    keyed, ledger = _ledger_of_nodes(spark, sf_dir)
    return _ledger.copies(keyed, ledger).select("node_id", "copy_id")


def p4_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct note: its representative and how many copies there are."""
    _, ledger = _ledger_of_nodes(spark, sf_dir)
    return ledger.read().select(F.col("first_id").alias("node_id"), F.col("n").alias("copies"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of similar nodes that are not copies."""
    return _neardup.near_duplicates(load(spark, sf_dir, "nodes").select("id", "text")).select("id_a", "id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node: its class of copies, its group of similar classes, and the links of its class."""
    return _neardup.groups(load(spark, sf_dir, "nodes").select("id", "text"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document or piece, for each container size."""
    return _packing.pack(load(spark, sf_dir, "documents"), load(spark, sf_dir, "pack_specs"))


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, pieces, tokens and fill of each container size."""
    return _packing.summary(p6_pack(spark, sf_dir), load(spark, sf_dir, "pack_specs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and the evaluation items it leaks."""
    return _leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks with the words matched and the words of the item."""
    return _leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document more than half of whose text is residue."""
    return _residue.residue(load(spark, sf_dir, "documents")).select("doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of residue in every document."""
    return _residue.scored(load(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_batches": p1_batches,
    "p2_found": p2_found,
    "p2_composition": p2_composition,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_ledger": p4_ledger,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_pack": p6_pack,
    "p6_summary": p6_summary,
    "p7_found": p7_found,
    "p7_coverage": p7_coverage,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
}
