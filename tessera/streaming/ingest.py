"""Streams: batches of notes through the learning cascade, and accesses folded into counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import governance

NODES = "id long, text string"


def ingest(notes: DataFrame, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run the learning cascade on each micro-batch of (pending_id, text) against the store at `store`, and append what is new.

    A batch's rows are written under its number, so that a batch that is run again after a failure replaces its own rows.
    """

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        done = [r.path for r in _parts(spark, store) if r.batch < number]
        nodes = spark.read.schema(NODES).parquet(*done) if done else spark.createDataFrame([], NODES)
        decided = governance.learn(nodes, new)
        fresh = new.join(decided.filter("action = 'insert'").select("pending_id"), "pending_id", "left_semi").dropDuplicates(["text"])
        first = nodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        governance.numbered(fresh, "pending_id", first=first, name="id").select("id", "text").write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = notes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _parts(spark: SparkSession, store: str):
    from pyspark.sql import Row

    p = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return [Row(batch=int(n.split("=")[1]), path=f"{store}/{n}") for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS"))]


def accesses(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(id, window, accesses, last_at) of a stream of (id, at), append-only: a window ends when the watermark has passed it."""
    return (
        events.withWatermark("at", late).groupBy("id", F.window("at", window).alias("window")).agg(F.count(F.lit(1)).alias("accesses"), F.max("at").alias("last_at"))
    )
