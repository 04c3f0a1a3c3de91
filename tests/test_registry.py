"""Registry rules, and a few queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_mod
from packetloom.plans import load_all
from packetloom.plans.registry import QUERIES, oracles

SF = "/root/testdata/sf0.001"
# results that SQL cannot state (fitted models)
NO_SQL = {"fc12_logistic", "ev14_static_detection", "ev15_candidate_search"}
SAMPLE = ["win4_port_scan_score", "cln4_capture_quality", "flw6_history_string", "beh3_beaconing", "gra2_graph_metrics", "ent13_investigation_value",
          "fc17_attack_horizon", "ev3_auc", "jn1_as_of_join", "src7_eve_json_alerts", "str3_live_sessions"]


def test_every_query_has_sql_or_is_listed():
    load_all()
    assert set(QUERIES) - set(oracles()) == NO_SQL
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    import duckdb

    from tools.check import rows_of
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = entry_mod.queries()[name](spark, SF)
    cur = con.execute(entry_mod.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
