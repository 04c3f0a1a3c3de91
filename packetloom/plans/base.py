"""Spark-side derived tables that several areas start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.operators import clean, flows as fl, windows as win
from packetloom.plans.a_views import DAY, EP, W
from packetloom.sources import views

__all__ = ["DAY", "EP", "W", "views"]


def packets(spark: SparkSession, d: str) -> DataFrame:
    return views.packets(spark, d)


def packets_marked(spark: SparkSession, d: str) -> DataFrame:
    return clean.flag_retransmissions(views.packets(spark, d))


def packets_with_copies(spark: SparkSession, d: str) -> DataFrame:
    p = views.packets(spark, d)
    return p.unionByName(p.filter("protocol = 'ICMP'").withColumn("packet_index", F.col("packet_index") + 1000000000))


def flows(spark: SparkSession, d: str) -> DataFrame:
    return views.flows(spark, d)


def packet_flows(spark: SparkSession, d: str) -> DataFrame:
    return fl.build_flows(packets_marked(spark, d))


def stats(spark: SparkSession, d: str, seconds: int = W) -> DataFrame:
    return win.packet_window_stats(packets_marked(spark, d), seconds)


def scan_stats(spark: SparkSession, d: str, seconds: int = W) -> DataFrame:
    return win.scan_windows(packets_marked(spark, d), seconds)


def risk(spark: SparkSession, d: str) -> DataFrame:
    return win.window_risk(scan_stats(spark, d))


def findings(spark: SparkSession, d: str) -> DataFrame:
    return win.findings(risk(spark, d), win.top_talkers(packets(spark, d), W))
