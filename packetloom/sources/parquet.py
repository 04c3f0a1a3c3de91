"""Packet tables and packet-window Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.functions.columns import choose

INT_FIELDS = ("src_port", "dst_port", "ip_version", "packet_length", "payload_length", "ttl", "tcp_flags", "tcp_window",
              "fragment_offset", "vlan_id")
LONG_FIELDS = ("packet_index", "tcp_seq", "tcp_ack")


def normalize_packets(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cast raw packet rows to the packet schema; returns (usable rows, rows with ``reject_reason``).

    Needs ``timestamp, src_ip, dst_ip, protocol``; other fields are cast where present and stay NULL
    when they cannot be read.
    """
    missing = [n for n in ("timestamp", "src_ip", "dst_ip", "protocol") if n not in raw.columns]
    if missing:
        raise ValueError(f"packet table lacks {', '.join(missing)}")
    cols = {"ts": F.col("timestamp").try_cast("double"), "protocol": F.upper("protocol")}
    cols |= {n: F.col(n).try_cast("int") for n in INT_FIELDS if n in raw.columns}
    cols |= {n: F.col(n).try_cast("bigint") for n in LONG_FIELDS if n in raw.columns}
    df = raw.withColumns(cols).drop("timestamp")
    t = F.col("ts")
    bad_ts = t.isNull() | F.isnan(t) | (F.abs(t) == float("inf"))
    df = df.withColumn("reject_reason", choose(
        (bad_ts, "bad_timestamp"), (F.col("src_ip").isNull(), "no_source"), (F.col("dst_ip").isNull(), "no_destination"),
        (F.col("protocol").isNull(), "no_protocol")))
    return df.filter("reject_reason IS NULL").drop("reject_reason"), df.filter("reject_reason IS NOT NULL")


def read_windows(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_windows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """zstd Parquet, partitioned for pruning (normally by capture and day)."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
