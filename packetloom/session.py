"""Session settings and durable lineage cuts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Shuffle width is left to AQE: it starts from the cluster's own
# default (or the caller's value) and coalesces to the advisory size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build(app: str = "packetloom", master: str | None = None, **extra: str) -> SparkSession:
    """Return a session with :data:`SETTINGS`; ``master`` is given only in tests and the bench."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows of an input table for each partition that a shuffle starts with.
ROWS_PER_PARTITION = 200_000
_WIDTH = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def widen(spark: SparkSession, rows: int) -> None:
    """Let shuffles start with a partition for each ``ROWS_PER_PARTITION`` of ``rows`` at least, whatever the session's default.

    Sorts, windows and aggregates hold a partition each, so with a fixed number of partitions they spill the more, the larger
    the input is. AQE merges what is small again. Nothing is ever made narrower; without AQE the session's number stays.
    """
    now = width(spark)
    if rows > now * ROWS_PER_PARTITION:
        spark.conf.set(_WIDTH, -(-rows // ROWS_PER_PARTITION))


def width(spark: SparkSession) -> int:
    """The partitions that a shuffle starts with."""
    return max(int(spark.conf.get(_WIDTH, None) or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a folder inside the warehouse, which a cluster shares too."""
    shared_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared_dir is None:
        shared_dir = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", shared_dir)
    return shared_dir


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def shared(df: DataFrame) -> DataFrame:
    """Keep a table that several branches of one plan read; lost blocks are rebuilt from its lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def settled(df: DataFrame) -> DataFrame:
    """``shared``, made at once: plans built afterwards know how its rows are laid out and don't shuffle them again."""
    kept = shared(df)
    kept.count()
    return kept


def stored(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder, compressed, and read it back; with ``by`` in buckets of these columns.

    Plans built afterwards end at the files, so tables that are made from each other don't nest, readers load only the columns that
    they need, and what was shuffled to make the table leaves the disk. Buckets are as many as shuffles are wide; what is grouped by
    ``by``, or by more columns, then needs no shuffle.
    """
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    path, schema = f"{checkpoint_root(spark).rstrip('/')}/tables/{name}", df.schema
    _release(spark)
    if by:
        n = width(spark)
        df.repartition(n, *by).write.bucketBy(n, *by).option("compression", "zstd").option("path", path).saveAsTable(name)
        kept = spark.read.table(name)
    else:
        df.write.option("compression", "zstd").parquet(path)
        kept = spark.read.schema(schema).parquet(path)
    del df
    _release(spark)
    return kept


def _release(spark: SparkSession) -> None:
    """Have the driver collect plans that nothing refers to any more: Spark deletes their shuffle files then, else whenever the heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
