"""Problem 1: deduplicating new batches against all history, with a persisted inverted file of vector cells.

A text's vector is the indicator of its token set, one coordinate per token. The coordinates are split into subspaces
(by size band), and a cell is one subspace together with the exact sub-vector there. An accepted text is filed under
its cells once, when it is accepted; its full vector is stored beside them, and its canonical key in a cell of its own.

A new text is matched in steps. The cell of its canonical key comes first: it gives the copies. Then its cells are probed,
the most selective first (STEPS). Among vectors that share none of the cells probed so far, each differs from the text in
as many subspaces; as soon as that exceeds the largest distance that a match can have (for Jaccard 0.8, a ninth of both
sizes together), no match is left, and a short text ends there after its first step. Wanted is the smallest id that
matches, so the best one of a step bounds the next: cells are read only for smaller ids, and a generation of the index
whose ids are all larger is not probed for that text at all. Candidates are cut down by the distance of their parity
sketches, again a lower bound, and reranked exactly on the stored full vectors; no accepted text is ever read again.

Cells of trained centroids were measured and rejected; README has the figures. The triangle inequality keeps them exact,
but they leave a share of the collection open to each text that does not fall as the collection grows.

State, under one path in the shared folder: `frame` (the bands and the information of token slots, fixed when the index is
built) and generations, each with `vectors` (id, canonical key, set, full vector), `cells` (cell, set, size, sketch, id; in
buckets of the cell, so that a batch's probes are shuffled to them and the cells never are) and `copies` (canonical key,
smallest id). `append` writes a new generation beside the others and makes it live by one manifest (manifest.py); a job
lost before that leaves the index as it was. When there are more than MOST_GENERATIONS, the small ones are merged.

Defined results: blank and null texts match nothing; accepted texts without an id are no match; ties go to the smallest id; repeated rows are treated alike; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import segments
from tessera.llm.canonical import with_copy_key
from tessera.llm.manifest import Manifest
from tessera.llm.neardup import SIMILAR, close_enough, emit_keys, similar_enough, similar_sets, size_counts, token_counts
from tessera.llm.segments import Bands, Threshold
from tessera.llm.tokens import hashed_sets
from tessera.runtime import join_sized, materialise, remove, shuffled, work_path

VECTORS = "id long, k1 long, k2 long, s long, n int, sketch long, toks array<bigint>"
CELLS = "key long, s long, n int, sketch long, id long"
COPIES = "k1 long, k2 long, id long"
#: The first cells of a text are probed in a step of their own; the others follow where its bound asks for more.
STEPS = (4,)
#: Rows of cells in a bucket, and the generations that may be probed one after another.
BUCKET_ROWS = 250_000
MOST_GENERATIONS = 8
#: Probes of a bucket that are held in memory: some 100 MB.
HASHED_PROBES = 1_000_000


class History:
    """The index of all accepted texts at `path`."""

    def __init__(self, spark: SparkSession, path: str, bands: Bands):
        self.spark, self.path, self.bands = spark, path, bands
        self.manifest = Manifest(spark, path)

    @staticmethod
    def vectors_of(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        named = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
        return hashed_sets(with_copy_key(named, "_text"), "_text", ["id", "k1", "k2"])

    @classmethod
    def build(cls, texts: DataFrame, path: str | None = None, threshold: Threshold = SIMILAR) -> History:
        """File all rows of (id, text). The frame rests on the counts of all of them and stays fixed afterwards."""
        spark = texts.sparkSession
        path = path or work_path(spark, "history")
        vectors = materialise(cls.vectors_of(texts, "id", "text"), "vectors", f"{path}/generation=1/vectors")
        bands = segments.allocate(size_counts(vectors), token_counts(vectors), threshold, self_join=False)
        frame = [("m", *map(int, x)) for x in zip(range(len(bands.m)), bands.m)] + [("p", *map(int, x)) for x in zip(range(len(bands.p)), bands.p)]
        frame += [("bits", i, int(b)) for i, b in enumerate(bands.bits)]
        frame += [("threshold", 0, threshold.num), ("threshold", 1, threshold.den)]
        spark.createDataFrame(frame, "what string, i int, value int").coalesce(1).write.mode("overwrite").parquet(f"{path}/frame")
        history = cls(spark, path, bands)
        history.manifest.commit(0, {"generations": [history._file(1)], "next": 2})
        return history

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> History:
        rows = spark.read.parquet(f"{path}/frame").collect()  # 2^16 slots and some 40 bands, whatever the collection
        column = lambda what: np.array([v for _, v in sorted((r.i, r.value) for r in rows if r.what == what)])
        cut = np.array(segments.edges())
        bands = Bands(cut[:-1], cut[1:], column("m"), column("p"), column("bits").astype(float), Threshold(*map(int, column("threshold"))), False)
        return cls(spark, path, bands)

    def _at(self, generation: int, table: str, kind: str) -> DataFrame:
        return self.spark.read.schema(kind).parquet(f"{self.path}/generation={generation}/{table}")

    def _cells(self, generation: dict) -> DataFrame:
        """The cells as a bucketed table, which a join on the cell reads in place; the catalogue entry is only the session's."""
        path = f"{self.path}/generation={generation['number']}/cells"
        name = f"tessera_cells_{hashlib.md5(path.encode()).hexdigest()}"
        columns = CELLS.replace("long", "bigint")
        self.spark.sql(
            f"create table if not exists {name} ({columns}) using parquet clustered by (key) into {generation['buckets']} buckets location '{path}'"
        )
        return self.spark.table(name)

    def _file(self, number: int) -> dict:
        """Write the cells and copies of the vectors of a generation; gives its entry in the manifest."""
        vectors = self._at(number, "vectors", VECTORS)
        sizes = size_counts(vectors)
        buckets = max(1, -(-segments.rows_of(self.bands, sizes) // BUCKET_ROWS))
        path = f"{self.path}/generation={number}"
        name = f"tessera_write_{hashlib.md5(path.encode()).hexdigest()}"
        self.spark.sql(f"drop table if exists {name}")
        remove(self.spark, f"{path}/cells")  # what a lost job may have left
        cells = emit_keys(vectors.filter("n > 0 and id is not null"), self.bands, index=True, ids=True).repartition(buckets, "key")
        cells.write.format("parquet").bucketBy(buckets, "key").option("path", f"{path}/cells").saveAsTable(name)
        self.spark.sql(f"drop table {name}")  # the files stay, as the path is the index's own
        copies = vectors.filter("k1 is not null and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"))
        copies.write.mode("overwrite").parquet(f"{path}/copies")
        least, rows = vectors.agg(F.min("id"), F.count("id")).first()
        return {"number": number, "buckets": buckets, "least": least, "rows": rows}

    def append(self, texts: DataFrame) -> None:
        """File newly accepted rows of (id, text) as a generation of their own, live once all of it is written."""
        version, state = self.manifest.read()
        number = state["next"]
        materialise(self.vectors_of(texts, "id", "text"), "vectors", f"{self.path}/generation={number}/vectors")
        live, merged = [*state["generations"], self._file(number)], []
        if len(live) > MOST_GENERATIONS:
            # All but the largest become one, so that every row is rewritten a number of times that grows with the logarithm.
            merged = sorted(live, key=lambda g: -g["rows"])[1:]
            number += 1
            union = self.spark.read.schema(VECTORS).parquet(*[f"{self.path}/generation={g['number']}/vectors" for g in merged])
            materialise(union, "vectors", f"{self.path}/generation={number}/vectors")
            live = [g for g in live if g not in merged] + [self._file(number)]
        # What was merged is deleted by the next append, as someone may still read it.
        self.manifest.commit(version, {"generations": live, "next": number + 1, "dropped": [g["number"] for g in merged]})
        remove(self.spark, *[f"{self.path}/generation={g}" for g in state.get("dropped", [])])

    def match(self, batch: DataFrame) -> DataFrame:
        """(batch_id, node_id): for each row of the batch (batch_id string, text) that repeats an accepted text, alike or
        slightly changed, the smallest id of all those it repeats.
        """
        spark, t = self.spark, self.bands.threshold
        new = batch.select("batch_id", F.col("text").alias("_text")).filter(F.trim("_text") != "")
        new = materialise(hashed_sets(with_copy_key(new, "_text"), "_text", ["batch_id", "k1", "k2"]), "batch")
        sizes = size_counts(new)
        probes_all = segments.rows_of(self.bands, sizes, index=False)
        generations = sorted((g for g in self.manifest.read()[1]["generations"] if g["rows"]), key=lambda g: g["least"])
        # Copies: the cell of the canonical key.
        wanted = materialise(new.filter("k1 is not null").select("k1", "k2").distinct(), "wanted")
        copies = spark.createDataFrame([], COPIES)
        for g in generations:
            copies = copies.unionByName(self._at(g["number"], "copies", COPIES))
        alike = join_sized(copies, wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.min("id").alias("best"))
        rows = new.join(alike, ["k1", "k2"], "left").select("batch_id", "s", "sketch", "n", "toks", "best")
        # One row for each set: every row of a set has the same matches by similarity; its largest best bounds them all.
        bound = lambda df: df.groupBy("s", "sketch").agg(F.max(F.coalesce("best", F.lit((1 << 63) - 1))).alias("best"))
        best = materialise(rows.select("batch_id", "s", "sketch", "best"), "best")
        sets = materialise(new.filter("n > 0").dropDuplicates(["s", "sketch"]).select("s", "sketch", "n", "toks"), "sets")
        bounds = materialise(bound(best), "bounds")
        limits = [0, *STEPS, 1 << 30]
        for low, high in zip(limits, limits[1:]):
            if low and not self._deeper(sizes, low):
                break  # no text of the batch can have a match beyond the cells already probed
            for g in generations:
                open_sets = sets.join(bounds.filter(F.col("best") > g["least"]), ["s", "sketch"], "left_semi")
                probes = emit_keys(open_sets, self.bands, index=False, more=True).filter(F.col("step").between(low, high - 1))
                # A table of a bucket's probes spares the sort of its cells; a backlog that is large beside the index is sorted.
                probes = probes.join(bounds, ["s", "sketch"]).hint("shuffle_hash" if probes_all <= HASHED_PROBES * g["buckets"] else "merge")
                with shuffled(spark, probes_all, 40):
                    found = self._step(g, probes, sets, t)
                bounds = bounds.join(found, ["s", "sketch"], "left")
                bounds = materialise(bounds.select("s", "sketch", F.least("best", "id").alias("best")), "bounds")
        close = bounds.filter(F.col("best") < (1 << 63) - 1).withColumnRenamed("best", "near")
        out = best.join(close, ["s", "sketch"], "left").select("batch_id", F.least("best", "near").alias("node_id"))
        return out.filter("node_id is not null").groupBy("batch_id").agg(F.min("node_id").alias("node_id"))

    def _deeper(self, sizes: dict[int, int], step: int) -> bool:
        """Whether a set of one of these sizes has more than `step` cells to probe in some band."""
        _, band, u = segments.membership(self.bands, np.array([n for n in sizes if n > 0], dtype=np.int64), index=False)
        return bool(len(u)) and int((u + 1 - self.bands.p[band]).max()) > step

    def _step(self, generation: dict, probes: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
        """(s, sketch, id): of each probing set, the smallest id below its bound that is similar indeed."""
        a, b = probes.alias("a"), self._cells(generation).alias("b")
        met = b.join(a, (F.col("a.key") == F.col("b.key")) & close_enough(t, "a", "b") & (F.col("b.id") < F.col("a.best")))
        met = met.select(F.col("a.s").alias("s"), F.col("a.sketch").alias("sketch"), F.col("b.s").alias("s_b"), F.col("b.sketch").alias("sketch_b"), F.col("b.id").alias("id"))
        met = materialise(met.groupBy("s", "sketch", "s_b", "sketch_b").agg(F.min("id").alias("id")), "met")
        vectors = self._at(generation["number"], "vectors", VECTORS).select("id", "toks")
        wanted = materialise(met.select("id").distinct(), "wanted")
        full = join_sized(vectors, wanted, "id").dropDuplicates(["id"]).withColumnRenamed("toks", "toks_b")
        pairs = met.join(full, "id").join(sets.select("s", "sketch", F.col("toks").alias("toks_a")), ["s", "sketch"])
        return similar_enough(pairs, t).groupBy("s", "sketch").agg(F.min("id").alias("id"))


def _numbered(rows: DataFrame, order: list[str], first_id: int) -> DataFrame:
    """`rows` with `id`, numbered upwards from first_id by `order`, without one window over all rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    # The number of a partition is in the upper bits; one row for each of them.
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("_before", F.sum("size").over(Window.orderBy("_part")) - F.col("size")).drop("size")
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return materialise(numbered.withColumn("id", (F.col("_before") + at + first_id).cast("long")).drop("_at", "_part", "_before"), "numbered")


RESULT = "batch_id string, node_id long, new_id long"


def accept(history: History, batch: DataFrame, first_id: int) -> DataFrame:
    """Match a batch, then file the rows that repeat nothing, numbered upwards from first_id; gives (batch_id, node_id, new_id).

    Rows of the batch that repeat each other are all filed; they meet in problem 4 or 5.
    """
    found = materialise(history.match(batch), "matched")
    fresh = batch.select("batch_id", "text").filter(F.trim("text") != "").join(found, "batch_id", "left_anti")
    numbered = _numbered(fresh, ["batch_id"], first_id)
    history.append(numbered.select("id", "text"))
    none = F.lit(None).cast("long")
    return found.select("batch_id", "node_id", none.alias("new_id")).unionByName(numbered.select("batch_id", none.alias("node_id"), F.col("id").alias("new_id")))


def accept_backlog(history: History, pending: DataFrame, first_id: int) -> DataFrame:
    """A backlog of batches (batch_id string, text, day), one per day, undated rows last, as if each went through `accept`
    in the order of the days: (batch_id, node_id, new_id), numbered by day and batch_id from first_id on.

    The index is probed once for all days, as what they file does not change it for them; what the days mean to each other
    is settled among their own new rows. Rows of one set and canonical key are a unit. A unit is filed on its first day
    unless a unit that it repeats was filed on an earlier one, and never later. Units are settled in rounds, each with
    those that no open unit of an earlier day can still block; a round is a few aggregations over the links, and there are
    as many as the longest chain of links over days, at most one for each day.
    """
    spark = history.spark
    pending = pending.select("batch_id", "text", F.coalesce(F.datediff(F.col("day").cast("date"), F.lit("1970-01-01")), F.lit(1 << 30)).alias("day"))
    pending = materialise(pending.filter(F.trim("text") != ""), "pending")
    found = materialise(history.match(pending), "matched")
    fresh = pending.join(found, "batch_id", "left_anti").withColumn("_text", F.col("text"))
    fresh = materialise(hashed_sets(with_copy_key(fresh, "_text"), "_text", ["batch_id", "day", "text", "k1", "k2"]), "fresh")
    unit = ["s", "sketch", "k1", "k2"]
    units = materialise(fresh.groupBy(*unit).agg(F.min("day").alias("first"), F.max("n").alias("n")), "units")
    similar = similar_sets(fresh.select("s", "sketch", "n", "toks"), history.bands.threshold)
    links = similar.select("s_a", "sketch_a", "s_b", "sketch_b").unionByName(similar.select(F.col("s_b").alias("s_a"), F.col("sketch_b").alias("sketch_a"), F.col("s_a").alias("s_b"), F.col("sketch_a").alias("sketch_b")))
    links = materialise(links, "similar-both")

    def nearest(state: DataFrame, value: str, name: str) -> DataFrame:
        """Units with the smallest `value` among the units of `state` that they repeat."""
        by_key = state.groupBy("k1", "k2").agg(F.min(value).alias("_key"))
        by_set = materialise(state.filter("n > 0").groupBy("s", "sketch").agg(F.min(value).alias("_set")), "by-set")
        by_link = links.join(by_set.toDF("s_b", "sketch_b", "_link"), ["s_b", "sketch_b"]).groupBy(F.col("s_a").alias("s"), F.col("sketch_a").alias("sketch")).agg(F.min("_link").alias("_link"))
        near = units.select(*unit).join(by_key, ["k1", "k2"], "left").join(by_set, ["s", "sketch"], "left").join(by_link, ["s", "sketch"], "left")
        return near.select(*unit, F.least("_key", "_set", "_link").alias(name))

    state = materialise(units.withColumn("state", F.lit("open")), "state")
    while state.filter("state = 'open'").limit(1).count():
        filed = nearest(state.filter("state = 'filed'"), "first", "filed")
        waits = nearest(state.filter("state = 'open'"), "first", "waits")
        seen = state.join(filed, unit, "left").join(waits, unit, "left")
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("filed") < F.col("first"), "blocked").when(F.col("waits") < F.col("first"), "open").otherwise("filed")
        state = materialise(seen.select(*unit, "first", "n", new.alias("state")), "state")
    filed_units = state.filter("state = 'filed'")
    rows = fresh.join(filed_units.select(*unit, F.col("first").alias("day")), [*unit, "day"])
    numbered = _numbered(rows.select("batch_id", "text", "day", *unit), ["day", "batch_id"], first_id)
    history.append(numbered.select("id", "text"))
    # What was not filed repeats the smallest number of an earlier day. Numbers grow with days, so the smallest is the earliest.
    first_number = numbered.groupBy(*unit).agg(F.min("id").alias("number"))
    numbers = materialise(filed_units.join(first_number, unit), "numbers")
    rest = fresh.join(numbered.select("batch_id"), "batch_id", "left_anti").join(nearest(numbers, "number", "node_id"), unit)
    none = F.lit(None).cast("long")
    return (
        found.select("batch_id", "node_id", none.alias("new_id"))
        .unionByName(numbered.select("batch_id", none.alias("node_id"), F.col("id").alias("new_id")))
        .unionByName(rest.select("batch_id", "node_id", none.alias("new_id")))
    )
