"""Shuffles are as wide as the input needs, whatever the session's default number of partitions."""

import re

import pytest

from packetloom import session
from packetloom.operators import entities as en
from packetloom.sources import views

D = "/root/testdata/sf0.001"


@pytest.fixture
def width(spark, monkeypatch):
    """The partitions a shuffle starts with, when a partition is meant for 100 rows."""
    before = spark.conf.get(session._WIDTH, None)
    spark.conf.unset(session._WIDTH)
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 100)
    yield lambda: int(spark.conf.get(session._WIDTH, None) or 0)
    spark.conf.set(session._WIDTH, before) if before else spark.conf.unset(session._WIDTH)


def test_shuffles_start_as_wide_as_the_largest_table_needs(spark, width):
    rows = views.table(spark, D, "lineitem").count()
    assert width() == -(-rows // 100)
    views.table(spark, D, "nation")  # a small table makes nothing narrower
    assert width() == -(-rows // 100)


def test_a_wider_setting_of_the_caller_stays(spark, width):
    spark.conf.set(session._WIDTH, "777")
    views.table(spark, D, "lineitem")
    assert width() == 777


def test_flows_are_laid_out_in_partitions_of_bounded_size(spark, width):
    laid = en.by_source_window(views.flows(spark, D), 86400 * 30)
    assert laid.count() == views.flows(spark, D).count()
    plan = laid._jdf.queryExecution().sparkPlan().toString()
    assert re.search(rf"hashpartitioning\(src_ip#\d+, bucket#\d+L, {width()}\)", plan), plan
