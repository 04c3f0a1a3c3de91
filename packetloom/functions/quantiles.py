"""Exact group quantiles whose work is spread over value ranges, not over one task per group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Spot = float | Callable[[Column], Column]


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    quantiles: dict[str, Spot]) -> DataFrame:
    """Linear-interpolated quantiles ``{name: q}`` of ``value`` per key (NULL values are skipped).

    ``q`` is a share in [0, 1] or a function from the row count to a 0-based (fractional) rank.

    1. count distinct values per key (combined map-side);
    2. count them again per logarithmic value bin: at most a few thousand rows per key;
    3. find by running sums which bin holds each wanted rank;
    4. rank only the values of those bins, partitioned by (key, bin).

    ``percentile`` would hold every distinct value of a hot key in one aggregation buffer.
    """
    keys = list(keys)
    v = F.col("_v")
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count("*").alias("_n"))
              .withColumn("_bin", (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * 64)).cast("int")))
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn"))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    bins = bins.select(*keys, "_bin", "_bn",
                       F.coalesce(F.sum("_bn").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)),
                                  F.lit(0)).alias("_before"),
                       F.sum("_bn").over(Window.partitionBy(*keys)).alias("_total"))
    spots = []
    for name, q in quantiles.items():
        pos = q(F.col("_total")).cast("double") if callable(q) else (F.col("_total") - 1) * F.lit(float(q))
        spots += [F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), fn(pos).cast("bigint").alias("rank"),
                           (pos - F.floor(pos)).alias("frac"))
                  for side, fn in (("lo", F.floor), ("hi", F.ceil))]
    wanted = bins.withColumn("_spot", F.explode(F.array(*spots))).filter(
        (F.col("_spot.rank") >= F.col("_before")) & (F.col("_spot.rank") < F.col("_before") + F.col("_bn")))
    targets = wanted.select(*keys, "_bin", "_before", "_spot.*")
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit_bins = targets.select(*keys, "_bin").distinct()
    ranked = (counts.join(hit_bins, [*keys, "_bin"], "left_semi")
              .withColumn("_upto", F.sum("_n").over(in_bin)))
    hits = targets.join(ranked, [*keys, "_bin"]).filter(
        (F.col("rank") - F.col("_before") < F.col("_upto"))
        & (F.col("rank") - F.col("_before") >= F.col("_upto") - F.col("_n")))
    aggs = []
    for name in quantiles:
        lo = F.max(F.when((F.col("q") == name) & (F.col("side") == "lo"), v))
        hi = F.max(F.when((F.col("q") == name) & (F.col("side") == "hi"), v))
        frac = F.max(F.when(F.col("q") == name, F.col("frac")))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return hits.groupBy(*keys).agg(*aggs)


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with ``_n`` and ``_upto`` (rows at or below), ranked per value bin."""
    keys = list(keys)
    v = F.col("_v")
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count("*").alias("_n"))
              .withColumn("_bin", (F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * 64)).cast("int")))
    by_bin = Window.partitionBy(*keys).orderBy("_bin")
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn")).select(
        *keys, "_bin", F.coalesce(F.sum("_bn").over(by_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (counts.withColumn("_in", F.sum("_n").over(inner)).join(bins, [*keys, "_bin"])
            .withColumn("_upto", F.col("_in") + F.col("_before")).drop("_in", "_before", "_bin"))


def group_gini(df: DataFrame, keys: Sequence[str], value: str, name: str = "gini") -> DataFrame:
    """Gini coefficient of the absolute values per key; 0 when all are zero. Equal values share ranks."""
    keys = list(keys)
    c = value_counts(df.withColumn("_abs", F.abs(F.col(value).cast("double"))), keys, "_abs")
    n, upto, v = F.col("_n"), F.col("_upto"), F.col("_v")
    rank_sum = n * (upto - n) + n * (n + 1) / 2
    agg = c.groupBy(*keys).agg(F.sum(rank_sum * v).alias("_iv"), F.sum(n * v).alias("_s"), F.sum("_n").alias("_c"))
    return agg.select(*keys, F.when(F.col("_s") == 0, 0.0).otherwise(
        (2 * F.col("_iv") - (F.col("_c") + 1) * F.col("_s")) / (F.col("_c") * F.col("_s") + 1e-9)).alias(name))


def group_entropy(df: DataFrame, keys: Sequence[str], value: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy in bits of the value frequencies per key."""
    keys = list(keys)
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return c.groupBy(*keys).agg((F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias(name))
