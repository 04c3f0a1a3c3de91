"""Order of rows inside files: what a line has above it, and a row's place in its file.

A reader's split holds one stretch of one file, and one task reads it from its beginning. So the file, the offset where the split
begins and a number that grows along the task's rows put all rows of a file in order, however the file was split. The numbers
are compared inside a split only, and never between two reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

c = F.col
PLACE = ["_file", "_block", "_id"]


def placed(rows: DataFrame) -> DataFrame:
    """``rows``, just read from files, with ``_file, _block, _id``: their order inside each file."""
    return rows.select("*", c("_metadata.file_path").alias("_file"), c("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def last_above(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the latest non-null ``value`` at or above each row of its file (``rows`` from :func:`placed`).

    Splits are handled by themselves; one row per split carries its last value on to the splits behind it.
    """
    x = rows.withColumn("_v", value)
    inner = Window.partitionBy("_file", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = x.filter("_v IS NOT NULL").groupBy("_file", "_block").agg(F.max_by("_v", "_id").alias("_end"))
    blocks = x.select("_file", "_block").distinct().join(ends, ["_file", "_block"], "left")
    across = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("_file", "_block", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    out = x.withColumn("_in", F.last("_v", ignorenulls=True).over(inner)).join(carry, ["_file", "_block"], "left")
    return out.withColumn(name, F.coalesce("_in", "_carry")).drop("_v", "_in", "_carry")


def with_ordinal(rows: DataFrame, name: str) -> DataFrame:
    """Add each row's 0-based place in its file (``rows`` from :func:`placed`), without its place columns."""
    inner = Window.partitionBy("_file", "_block").orderBy("_id")
    sizes = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    across = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_file", "_block", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_shift"))
    out = rows.withColumn("_rn", F.row_number().over(inner)).join(shift, ["_file", "_block"])
    return out.withColumn(name, c("_rn") - 1 + c("_shift")).drop("_rn", "_shift", *PLACE)
