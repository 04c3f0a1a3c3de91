"""Shared helpers: tables, written intermediate tables, size-checked joins."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from packetloom.session import checkpoint_root

#: A lookup table of at most so many rows is broadcast; a larger one is joined by a salted shuffle.
BROADCAST_ROWS = 50_000
#: Rows of one Arrow batch handed to Python at once are cut into pieces of about this many bytes of text.
BATCH_BYTES = 8 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name``, with its DuckDB twin if there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(df: DataFrame, **more) -> DataFrame:
    """``df`` with its columns inside one struct ``_d``, clear of any name that an operator adds; ``unboxed`` undoes it."""
    return df.select(F.struct("*").alias("_d"), *[value.alias(name) for name, value in more.items()])


#: A table of so many files has its list of file names broadcast (some 150 bytes each); a longer one is joined.
BROADCAST_FILES = 200_000
#: Plan nodes over a file scan that keep its rows as they are, or leave some out.
PLAIN_NODES = {"Project", "Filter", "SubqueryAlias"}


def _scanned(docs: DataFrame) -> bool:
    """Whether ``docs`` is rows of files, each at most once."""
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in PLAIN_NODES:
        node = node.children().apply(0)
    return node.getClass().getSimpleName() == "LogicalRelation"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` boxed, with a row number ``_row`` that is the same on every read, whatever its splits and executors.

    Rows of Parquet files are numbered by file and place in the file, which need no copy. Anything else is written once with numbers;
    a number that each read made anew would depend on how files are split, and so on the executors of the moment.
    """
    try:
        placed = docs.select(F.struct("*").alias("_d"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index")) if _scanned(docs) else None
    except AnalysisException:  # not Parquet
        placed = None
    if placed is None:
        path, rows = scratch(docs.sparkSession, name), boxed(docs, _row=F.monotonically_increasing_id())
        rows.write.option("compression", "zstd").parquet(path)
        return docs.sparkSession.read.schema(rows.schema).parquet(path)
    # one row per file
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_file")).cast("long")
    files = staged(placed.select("_file").distinct().withColumn("_nth", nth), "files")
    return join_lookup(placed, files, ["_file"], BROADCAST_FILES).select("_d", (F.shiftleft("_nth", 36) + F.col("_index")).alias("_row"))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("_d.*")


def join_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with a (written) table of unique, possibly null ``keys``.

    Up to ``limit`` rows the table is broadcast. Beyond it the join shuffles, and both sides get a salt, so that a
    key with a third of all rows is spread over 32 tasks.
    """
    names = {k: f"_k_{k}" for k in keys}
    right = lookup.withColumnsRenamed(names)
    on = [df[k].eqNullSafe(right[n]) for k, n in names.items()]
    if lookup.limit(limit + 1).count() <= limit:
        return df.join(F.broadcast(right), on, "left").drop(*names.values())
    # a hash of the row, not a random number: a task that runs again must deal its rows alike
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*[df[c] for c, kind in df.dtypes if "map<" not in kind]), F.lit(32)).cast("int"))
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(31))))
    on = [left[k].eqNullSafe(right[n]) for k, n in names.items()] + [left["_salt"] == right["_salt2"]]
    return left.join(right, on, "left").drop(*names.values(), "_salt", "_salt2")


def running_sum(df: DataFrame, order: Sequence[str], values: Sequence[str], name: str = "sum") -> tuple[DataFrame, DataFrame]:
    """Exclusive running sums ``before_<value>`` over a total order, without a one-task window.

    Rows are range-partitioned and written once; sums inside a range are added to those of the ranges before it (one
    row per range). Returns the rows and the written ranges. The order columns must not be ``_range``.
    """
    placed = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_range").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    # one row per range partition: the count of tasks, not of data
    shift = sums.select("_range", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values])
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"_i_{v}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in values})
    out = out.join(F.broadcast(shift), "_range")
    out = out.withColumns({f"before_{v}": F.col(f"_i_{v}") + F.col(f"_b_{v}") for v in values})
    return out.drop("_range", *[f"_{p}_{v}" for v in values for p in ("i", "b")]), placed


def slices(batch: pa.RecordBatch, column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``size`` bytes of ``column``, one row at least."""
    lengths = [x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def give_back() -> None:
    """Hand memory that is free again to the system: a worker lives on between tasks, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)
