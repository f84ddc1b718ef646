"""Session, tables and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings nodes pending edges change_log"
    " subject_labels subjects eval_items pack_specs"
).split()


def session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session is the caller's."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where it comes of fewer files than there are cores; else as it is.

    A small table in one file would otherwise be read, and all that is computed on its rows done, in one or two tasks. A
    large table has more files than there are cores and is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the checkpoint folder already set on the context.

    Only a local master gets a temporary folder of its own; elsewhere a missing setting is an error, because a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    sc.setCheckpointDir(f"file://{own}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for one table under the shared folder."""
    return f"{shared_base(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder; it survives the loss of any executor."""
    spark = df.sparkSession
    path = path or work_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        p = hadoop.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes that a task should read of a shuffle.
TASK_BYTES = 8 << 20


@contextmanager
def shuffled(spark: SparkSession, rows: int, row_bytes: int) -> Iterator[None]:
    """Plans executed inside shuffle into tasks of about TASK_BYTES: the session's number of partitions, or more where `rows` ask for more.

    A number set in the session suits one size of data; here it follows the rows. AQE still joins small tasks and splits skewed ones.
    """
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(max(int(old), -(-rows * row_bytes // TASK_BYTES))))
    try:
        yield
    finally:
        spark.conf.set(key, old)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries executed inside delete their shuffle files when they end, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


#: Rows that a broadcast side may have at most: 2^20 rows of two longs are 16 MB.
BROADCAST_ROWS = 1 << 20


def against_all(rows: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """Every row with every query of a stated set, of which blocks of about `most` are broadcast at a time; no query is dropped."""
    blocks = -(-queries.count() // most)
    if blocks <= 1:
        return rows.crossJoin(F.broadcast(queries))
    cut = materialise(queries.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "queries")
    parts = [rows.crossJoin(F.broadcast(cut.filter(F.col("_block") == b).drop("_block"))) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def join_sized(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with `small`, which is broadcast only where its counted rows stay below BROADCAST_ROWS, else shuffled.

    `small` should be materialised already, as it is counted unless `rows` is given.
    """
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)
