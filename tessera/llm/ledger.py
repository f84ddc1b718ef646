"""Problem 4: duplicates hidden by formatting differences, counted in an incremental ledger.

The ledger is a table of canonical keys with the number of copies seen and the earliest (smallest) id, stored in
buckets of the key under the shared folder. A batch is first aggregated on its own keys and written beside the buckets it
touches, as their delta. Where a bucket's deltas have grown to more than MERGE of its rows, they are full-outer-joined with
it, the counts added and the earliest id kept, into a bucket anew; the others are left as they are, so that a row is
rewritten a bounded number of times as the ledger grows. Reading does the same join on the way. One manifest names what is
live (manifest.py): a job lost at any point leaves the ledger before or after the batch, and a batch that is named and
delivered again is not counted again.

Scale: buckets are as many as the rows ask for, and are split where they have grown. The aggregation combines on the map
side, so a group holding a third of all rows costs one row a task. The join back from rows to representatives sends the
keys held by more than a thousandth of all rows (there are at most a thousand of them) by broadcast, so no task gathers a
hot group; all others are shuffled.

Defined results: null texts have no key and are in no group; texts without letters or digits are copies only of
identical ones; a repeated row (same id and text) counts as a copy and is reported with its own id only where the id
differs from the representative's; empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.canonical import with_copy_key
from tessera.llm.manifest import Manifest
from tessera.runtime import materialise, remove, work_path

#: Rows of a bucket, and the share of them that its deltas may have before they are merged.
BUCKET_ROWS, MERGE = 1_000_000, 0.25
#: A key is hot when it holds more than this share of all rows; at most 1/HOT_SHARE keys can be.
HOT_SHARE = 1e-3
LEDGER = "k1 long, k2 long, n long, first_id long"


class Ledger:
    """Bucketed canonical-key counts at `path`; `update` adds a batch, `read` gives (k1, k2, n, first_id).

    Bucket b of a ledger of so many buckets holds the keys with pmod(k1, buckets) = b. The manifest names of each bucket its
    base, the generation that holds its merged rows, its deltas, later generations, and the rows of both.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path or work_path(spark, "ledger"), bucket_rows
        self.manifest = Manifest(spark, self.path)

    def _state(self) -> tuple[int, dict]:
        number, state = self.manifest.read()
        return number, state or {"buckets": 1, "generation": 0, "of": {}, "batches": []}

    def _bucket(self, buckets: int):
        return F.pmod("k1", F.lit(buckets)).cast("int")

    def _rows(self, places: list[tuple[int, str]]) -> DataFrame:
        paths = [f"{self.path}/generation={g}/bucket={b}" for g, b in places]
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)

    def _merged(self, of: dict[str, dict]) -> DataFrame:
        """The rows of these buckets: bases and deltas joined, counts added, the earliest id kept."""
        base = self._rows([(e["base"], b) for b, e in of.items() if e["base"]])
        if not any(e["deltas"] for e in of.values()):
            return base
        delta = self._rows([(g, b) for b, e in of.items() for g in e["deltas"]])
        delta = delta.groupBy("k1", "k2").agg(F.sum("n").alias("add_n"), F.min("first_id").alias("add_id"))
        both = base.join(delta, ["k1", "k2"], "full_outer")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("add_n", F.lit(0))
        return both.select("k1", "k2", n.alias("n"), F.least("first_id", "add_id").alias("first_id"))

    def read(self) -> DataFrame:
        return self._merged(self._state()[1]["of"])

    def _write(self, rows: DataFrame, buckets: int, generation: int) -> dict[str, int]:
        """Write rows into the buckets of a generation; gives the rows of each, which are as many numbers as buckets."""
        path = f"{self.path}/generation={generation}"
        placed = rows.withColumn("bucket", self._bucket(buckets)).repartition(max(1, min(buckets, 4096)), "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(f"{LEDGER}, bucket int").parquet(path)
        return {str(r.bucket): r["count"] for r in written.groupBy("bucket").count().collect()}

    def update(self, keyed: DataFrame, batch_id: str | None = None) -> None:
        """Add a batch of (id, k1, k2); rows without a key are ignored, and so is a batch whose name was added before."""
        number, state = self._state()
        if batch_id is not None and batch_id in state["batches"]:
            return
        own = keyed.filter(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
        path = work_path(self.spark, "ledger-batch")
        batch = materialise(own, "ledger-batch", path)
        generation, of, buckets = state["generation"] + 1, {b: dict(e) for b, e in state["of"].items()}, state["buckets"]
        total = batch.count() + sum(e["base_rows"] + e["delta_rows"] for e in of.values())
        old = {e["base"] for e in of.values()} | {g for e in of.values() for g in e["deltas"]}
        if total > 2 * buckets * self.bucket_rows:
            # Split: a ledger that has doubled is laid out anew, with buckets for as much again.
            while buckets * self.bucket_rows < total:
                buckets *= 2
            before = self._merged(of).unionByName(batch)
            rows = before.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
            of = {b: {"base": generation, "deltas": [], "base_rows": n, "delta_rows": 0} for b, n in self._write(rows, buckets, generation).items()}
        else:
            for b, n in self._write(batch, buckets, generation).items():
                e = of.setdefault(b, {"base": 0, "deltas": [], "base_rows": 0, "delta_rows": 0})
                e["deltas"], e["delta_rows"] = [*e["deltas"], generation], e["delta_rows"] + n
            full = {b: e for b, e in of.items() if e["delta_rows"] > MERGE * e["base_rows"]}
            if full:
                generation += 1
                for b, n in self._write(self._merged(full), buckets, generation).items():
                    of[b] = {"base": generation, "deltas": [], "base_rows": n, "delta_rows": 0}
        batches = state["batches"] + ([batch_id] if batch_id is not None else [])
        live = {e["base"] for e in of.values()} | {g for e in of.values() for g in e["deltas"]}
        written = set(range(state["generation"] + 1, generation + 1))
        dropped = sorted(old - live - {0})  # deleted by the next update, as someone may still read them
        self.manifest.commit(number, {"buckets": buckets, "generation": generation, "of": of, "batches": batches, "dropped": dropped})
        remove(self.spark, path, *[f"{self.path}/generation={g}" for g in {*state.get("dropped", []), *(written - live)}])


def copies(keyed: DataFrame, ledger: Ledger) -> DataFrame:
    """(node_id, copy_id, n) for every row of (id, k1, k2) that is not the representative of its group in the ledger."""
    groups = ledger.read()
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1000, int(total * HOT_SHARE))
    shared, keyed = groups.filter("n > 1"), keyed.filter(F.col("k1").isNotNull())
    hot = F.broadcast(shared.filter(F.col("n") > least))  # at most 1/HOT_SHARE rows, as their counts sum to the total
    split = keyed.join(hot.select("k1", "k2", F.col("n").alias("hot_n"), F.col("first_id").alias("hot_id")), ["k1", "k2"], "left")
    out = ("first_id", "id", "n")
    hot_rows = split.filter("hot_n is not null").select(F.col("hot_id").alias("first_id"), "id", F.col("hot_n").alias("n"))
    cold_rows = split.filter("hot_n is null").join(shared, ["k1", "k2"]).select(*out)
    return (
        hot_rows.unionByName(cold_rows)
        .filter("id <> first_id")
        .select(F.col("first_id").alias("node_id"), F.col("id").alias("copy_id"), "n")
    )


def keys(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, k1, k2) of a table of texts."""
    return with_copy_key(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "_text").select("id", "k1", "k2")
