"""Labelled flow corpora in CSV: a headerless 49-column layout, a header layout without times, a header layout with ``ts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.operators.clean import normalize_column_names
from packetloom.sources.ordered import placed, with_ordinal

c = F.col
WIDTH = 49


def wide_csv(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headerless 49-column rows from lines: (flows, rejected lines). Ordinals are fixed by the corpus."""
    p = F.split("value", ",", -1)
    num = lambda i: F.coalesce(F.trim(p[i]).try_cast("double"), F.lit(0.0))
    ok = (F.size(p) == WIDTH) & (num(28) > 0)
    f = lines.filter(ok).select(
        num(28).alias("start_ts"), (num(28) + num(6)).alias("end_ts"), F.trim(p[1]).alias("src_port"), F.trim(p[3]).alias("dst_port"),
        F.upper(F.trim(p[4])).alias("protocol"), num(7).alias("fwd_bytes"), num(8).alias("rev_bytes"), num(9).alias("sttl"), num(10).alias("dttl"),
        num(16).alias("fwd_packets"), num(17).alias("rev_packets"), num(18).alias("swin"), num(19).alias("dwin"), (num(30) + num(31)).alias("iat"), num(32).alias("rtt"),
        F.when(F.trim(p[47]) != "", F.trim(p[47])).alias("attack_cat"), (num(48) != 0).cast("int").alias("label"))
    return f, lines.filter(~ok)


def read_wide_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return wide_csv(spark.read.text(path))


def labelled_csv(rows: DataFrame, ordinal: str, base_ts: float = 1499414400.0) -> DataFrame:
    """Header rows without times: ``BENIGN`` is 0, everything else 1; time is base + 0.1 s x row ordinal.

    ``ordinal`` is the row's position in its file, carried by the reader (never a generated id).
    """
    x = normalize_column_names(rows)
    raw = F.trim("label")
    benign = F.upper(raw) == "BENIGN"
    feats = [n for n in x.columns if n not in ("label", ordinal)]
    finite = lambda n: F.when(F.abs(c(n).try_cast("double")) < float("inf"), c(n).try_cast("double"))
    return x.select((F.lit(base_ts) + c(ordinal) * 0.1).alias("ts"), F.when(benign, 0).otherwise(1).alias("label"),
                    F.when(benign, "BENIGN").otherwise(F.regexp_replace(raw, r"\s+", " ")).alias("attack_family"), *[finite(n).alias(n) for n in feats])


def read_labelled_csv(spark: SparkSession, path: str, base_ts: float = 1499414400.0) -> DataFrame:
    """:func:`labelled_csv` over the CSV files of a folder; a row's time counts the rows above it in its own file.

    All files have the header of the first. Rows with too few or too many cells count, but are dropped.
    """
    names = spark.read.csv(path, header=True).columns
    raw = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{n} string" for n in [*raw, "_bad"])
    rows = placed(spark.read.csv(path, header=True, schema=schema, columnNameOfCorruptRecord="_bad", mode="PERMISSIVE").select(*raw, "_bad", "_metadata")).drop("_metadata")
    rows = with_ordinal(rows, "_row").filter("_bad IS NULL").drop("_bad")
    return labelled_csv(rows.toDF(*names, "row_ordinal_of_file"), "row_ordinal_of_file", base_ts)


def dash_zero(col: Column | str) -> Column:
    """``-`` and unreadable numbers count as 0 in this corpus."""
    col = c(col) if isinstance(col, str) else col
    v = F.nullif(col, F.lit("-")).try_cast("double")
    return F.coalesce(F.when(F.abs(v) < float("inf"), v), F.lit(0.0))


def timed_csv(rows: DataFrame) -> DataFrame:
    """Header rows with ``ts``; label 1 / 0, anything else unknown; rows without a time are dropped."""
    lab = F.trim("label")
    return rows.filter(c("ts").try_cast("double").isNotNull()).select(
        c("ts").try_cast("double").alias("ts"), F.when(lab == "1", 1).when(lab == "0", 0).alias("label"),
        F.when(lab == "1", F.trim(F.coalesce("type", F.lit("normal")))).when(lab == "0", "BENIGN").alias("attack_family"), F.upper("proto").alias("protocol"),
        "src_port", "dst_port", *[dash_zero(n).alias(n) for n in ("duration", "src_bytes", "dst_bytes", "src_pkts", "dst_pkts", "missed_bytes")])


def read_timed_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; no schema inference pass over the data."""
    return timed_csv(normalize_column_names(spark.read.csv(path, header=True)))
