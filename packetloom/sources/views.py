"""Telemetry views over the star-schema test tables (packets, flows, labels, alerts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from packetloom.functions.columns import bucket, choose
from packetloom.session import widen


_SCHEMAS: dict[str, T.StructType] = {}
_ROWS: dict[str, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table; its schema and number of rows, which shuffles are as wide as, are looked up in the footers once per path."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    if path not in _ROWS:
        _ROWS[path] = df.count()
    widen(spark, _ROWS[path])
    return df


def epoch(ts: Column) -> Column:
    """Epoch seconds of a zone-less timestamp, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                  f"CAST({ts} AS TIMESTAMP_NTZ))") / F.lit(1e6)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    eid, uid = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    size = F.floor("value").cast("bigint")
    return e.select(
        F.lit("c0").alias("capture_id"), eid.alias("packet_index"), epoch("ts").alias("ts"),
        F.concat(F.lit("u"), uid).alias("src_ip"), (1024 + uid % 7).cast("int").alias("src_port"),
        F.concat(F.lit("h"), k % 20).alias("dst_ip"), k.alias("dst_port"),
        F.when(kind == "error", "ICMP").when(kind == "view", "UDP").otherwise("TCP").alias("protocol"),
        choose((kind == "signup", 2), (kind == "click", 16), (kind == "purchase", 17), (kind == "error", 4),
               default=24).alias("tcp_flags"),
        size.alias("packet_length"), F.greatest(F.lit(0), size - 40).alias("payload_length"),
        (32 + uid % 32).cast("int").alias("ttl"), (k * 100).alias("tcp_window"),
        (eid % 50).alias("tcp_seq"),
        F.when(uid % 10 == 0, 6).otherwise(4).alias("ip_version"),
        F.when(uid % 5 == 0, 100).alias("vlan_id"),
        (eid % 97 == 0).alias("more_fragments"),
        F.when(eid % 211 == 0, "malformed").otherwise("parsed").alias("parsing_status"),
        F.when(eid % 307 == 0, "TRUE").when(eid % 311 == 0, "UNKNOWN").otherwise("FALSE")
        .alias("truncation_status"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # the narrow tables first: the wide one is shuffled once
    placed = orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "o_orderstatus", "c_nationkey")
    j = li.join(placed, li.l_orderkey == placed.o_orderkey)
    start = epoch("l_shipdate") + F.col("l_partkey") % 86400
    end = start + F.col("l_quantity") * 3600
    status = F.concat("l_linestatus", "o_orderstatus")
    return j.select(
        F.concat(F.lit("s"), "l_suppkey").alias("src_ip"), F.concat(F.lit("n"), "c_nationkey").alias("dst_ip"),
        F.col("l_linenumber").alias("dst_port"),
        F.when(F.col("l_returnflag") == "R", "TCP").when(F.col("l_returnflag") == "A", "UDP")
        .otherwise("ICMP").alias("protocol"),
        start.alias("start_ts"), end.alias("end_ts"),
        F.floor("l_extendedprice").cast("bigint").alias("fwd_bytes"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("bigint").alias("rev_bytes"),
        F.floor("l_quantity").cast("bigint").alias("fwd_packets"),
        F.floor(F.col("l_quantity") * F.col("l_tax") * 10).cast("bigint").alias("rev_packets"),
        choose((status == "OO", "ESTABLISHED"), (status == "OF", "REJECTED"), (status == "OP", "ATTEMPTED"),
               (status == "FO", "RESET"), (status == "FF", "CLOSED"), default="INCOMPLETE").alias("state"))


def labels(spark: SparkSession, sf_dir: str, seconds: int) -> DataFrame:
    """One row per window: 1 where the error share exceeds mean + 0.5 population sigma of all windows."""
    e = table(spark, sf_dir, "events").select(bucket(epoch("ts"), seconds).alias("bucket"), "event_type")
    share = e.groupBy("bucket").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("share"))
    limit = share.agg((F.avg("share") + 0.5 * F.stddev_pop("share")).alias("m")).scalar()
    return share.select("bucket", "share", (F.col("share") > limit).cast("int").alias("attack_state"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("alert_id"), epoch("ts").alias("ts"),
        F.concat(F.lit("u"), "user_id").alias("src_ip"), F.concat(F.lit("h"), k % 20).alias("dst_ip"),
        k.alias("dst_port"),
        F.when(v >= 400, 1).when(v >= 250, 2).when(v >= 100, 3).otherwise(4).alias("severity"),
        F.when(k % 3 == 0, "T1046").when(k % 3 == 1, "T1071").otherwise("T1498").alias("technique"))
