"""Order-dependent operators that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so one hot key stalls the
job. The helpers here cut each key's timeline into segments: the window runs per (key, segment), one
row per segment is aggregated, a second window over those few rows carries values across segment
borders, and the carry is joined back on (key, segment), the partitioning the first window already
has. Segment columns must be monotone in the order columns; keys must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from packetloom.session import durable


def segmented_lag(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str],
                  columns: dict[str, str]) -> DataFrame:
    """Add ``{new: source}`` columns holding the previous row's values within each key."""
    keys = list(keys)
    inner = Window.partitionBy(*keys, segment).orderBy(*order)
    packed = F.struct(*columns.values())
    rows = df.withColumn("_before", F.lag(packed).over(inner))
    ends = df.groupBy(*keys, segment).agg(F.max_by(packed, F.struct(*order)).alias("_end"))
    across = Window.partitionBy(*keys).orderBy(segment)
    carry = ends.select(*keys, segment, F.lag("_end").over(across).alias("_carry"))
    rows = rows.join(carry, [*keys, segment], "left")
    pick = F.coalesce("_before", "_carry")
    out = rows.withColumns({new: pick[src] for new, src in columns.items()})
    return out.drop("_before", "_carry")


_MERGE = {"sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(),
                                     F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
          "max": F.greatest, "min": F.least}


def segmented_running(df: DataFrame, keys: Sequence[str], segment: str, order: Sequence[str],
                      aggregates: dict[str, tuple[str, str]], inclusive: bool = False) -> DataFrame:
    """Add running ``{new: (sum|max|min, source)}`` over the rows before each row (or up to it)."""
    keys = list(keys)
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    inner = (Window.partitionBy(*keys, segment).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    rows = df.withColumns({f"_in_{n}": fns[f](s).over(inner) for n, (f, s) in aggregates.items()})
    totals = df.groupBy(*keys, segment).agg(
        *[fns[f](s).alias(f"_t_{n}") for n, (f, s) in aggregates.items()])
    across = (Window.partitionBy(*keys).orderBy(segment)
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*keys, segment, *[
        fns[f](f"_t_{n}").over(across).alias(f"_c_{n}") for n, (f, _) in aggregates.items()])
    out = rows.join(carry, [*keys, segment], "left")
    out = out.withColumns({n: _MERGE[f](F.col(f"_in_{n}"), F.col(f"_c_{n}"))
                           for n, (f, _) in aggregates.items()})
    return out.drop(*[f"_{p}_{n}" for n in aggregates for p in ("in", "c")])


def global_row_number(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """1-based position in a total order over the whole table, without a one-task window.

    Rows are range-partitioned, frozen with a reliable checkpoint (so the ranges survive a lost
    executor), numbered inside each range and shifted by the ranges before it.
    """
    placed = durable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per shuffle partition
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy("_range").orderBy(*order)
    return (placed.withColumn("_rn", F.row_number().over(inner))
            .join(F.broadcast(shift), "_range")
            .withColumn(name, (F.col("_rn") + F.col("_shift")).cast("bigint"))
            .drop("_range", "_rn", "_shift"))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
          columns: Sequence[str], segment_seconds: int) -> DataFrame:
    """For each left row the latest right row of the same key at or before it (as-of join).

    Both sides are stacked and the last right payload is carried forward, segment by segment, so
    neither a range join nor a per-key collect is needed. Of right rows with one key and time, the largest payload counts.
    """
    keys = list(keys)
    payload = F.struct(F.col(right_ts).alias("_at"), *columns)
    lcols = [F.col(x) for x in left.columns]
    l_rows = left.select(*keys, F.col(left_ts).cast("double").alias("_t"), F.lit(1).alias("_side"),
                         F.struct(*lcols).alias("_l"))
    r_rows = right.select(*keys, F.col(right_ts).cast("double").alias("_t"), F.lit(0).alias("_side"),
                          payload.alias("_r"))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True).withColumn(
        "_seg", F.floor(F.col("_t") / segment_seconds))
    inner = (Window.partitionBy(*keys, "_seg").orderBy("_t", "_side", "_r")
             .rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("_in", F.last("_r", ignorenulls=True).over(inner))
    ends = both.groupBy(*keys, "_seg").agg(
        F.max(F.when(F.col("_r").isNotNull(), F.struct("_t", "_r")))["_r"].alias("_end"))
    across = (Window.partitionBy(*keys).orderBy("_seg")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(*keys, "_seg", F.last("_end", ignorenulls=True).over(across).alias("_carry"))
    out = rows.filter("_side = 1").join(carry, [*keys, "_seg"], "left")
    hit = F.coalesce("_in", "_carry")
    return out.select("_l.*", hit["_at"].alias(f"matched_{right_ts}"),
                      *[hit[x].alias(x) for x in columns])
