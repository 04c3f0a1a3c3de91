"""Every pair of incidents that share an actor or a target is a link, however many share it."""

import itertools

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from packetloom.operators import patterns as pt
from test_incident_graph import FP, fingerprint

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1, 3, 512])
def test_links_are_all_pairs_of_a_shared_item(spark, monkeypatch, block):
    monkeypatch.setattr(pt, "PAIR_BLOCK", block)
    names = [f"i{k:02d}" for k in range(23)]
    rows = [(n, "ACTOR", "gate") for n in names] + [(n, "TARGET", "t") for n in names[5:9]] + [(names[0], "TARGET", "alone"), (names[1], "PORT", "80"), (names[2], "PORT", "80")]
    members = spark.createDataFrame(rows, "incident string, kind string, item string")
    fp = spark.createDataFrame([fingerprint(n) for n in names], FP)
    got = [(r.incident_a, r.incident_b, r.shared_actors, r.shared_targets) for r in pt.incident_links(fp, members, "incident", every=True).collect()]
    assert sorted(got) == [(a, b, 1, int({a, b} <= set(names[5:9]))) for a, b in itertools.combinations(names, 2)]


def test_the_pairs_of_a_gateway_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(pt, "PAIR_BLOCK", 64)
    k = spark.range(1000).select(F.lit("ACTOR").alias("kind"), F.lit("gate").alias("item"), F.format_string("i%04d", "id").alias("incident"))
    blocks = pt._block_rows(k, "incident")[0].groupBy("_i", "_j").agg(F.count("*").alias("n")).collect()
    assert len(blocks) == 16 * 17 // 2 and max(r.n for r in blocks) < 128
    assert pt._pairs(k, "incident").count() == 1000 * 999 // 2


def test_the_query_lists_links_between_members_that_lead_nothing(spark):
    q = entry.queries()
    key = lambda r: (r.incident_a, r.incident_b)
    links = {key(r): tuple(r) for r in q["pat8_incident_links"](spark, D).collect()}
    assert links and links == {key(r): tuple(r) for r in q["pat8_incident_correlate"](spark, D).collect()}
