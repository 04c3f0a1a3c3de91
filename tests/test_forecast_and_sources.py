"""Splits, horizons, graph diffs, hunts, incident pairs, log parsing and streams on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from packetloom.operators import evaluate as ev, forecast as fc, graph as gr, hunt, patterns as pt
from packetloom.sources import corpora, logs, parquet as pq
from packetloom.streaming import live


def labels(spark, seq):
    return spark.createDataFrame([(b, y) for b, y in seq], "bucket bigint, attack_state int")


def test_episodes_cases_and_split(spark):
    e = fc.contiguous_episodes(labels(spark, [(i, i % 2) for i in range(20)] + [(i, 0) for i in range(30, 35)]))
    assert e.select("episode_id").distinct().count() == 2
    c = fc.forecast_cases(e).collect()
    assert len(c) == 20 - 13 + 1 and all(r["source_bucket"] - r["history_start"] == 7 for r in c)
    s = fc.chronological_split(e, [F.asc("bucket")])
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 17, "val": 4, "test": 4}
    a = fc.split_audit(fc.embargo(s, "bucket", 1), "bucket", 1).first()
    assert a["train_before_val"] and a["val_before_test"] and a["embargo_respected"]


@pytest.mark.parametrize("ps,state,onset,run", [
    ([0.1] * 5, "NO_ATTACK_FORECAST", None, 0), ([0.1, 0.6, 0.7, 0.2, 0.1], "SUSTAINED_ATTACK_FORECAST", 2, 2), ([0.1, 0.1, 0.9, 0.1, 0.1], "EARLY_SIGNAL", 3, 1),
    ([0.9, 0.1, 0.9, 0.1, 0.9], "UNCERTAIN_FORECAST", None, 0), ([0.49, 0.51, 0.5, 0.49, 0.2], "UNCERTAIN_FORECAST", None, 0), ([0.2, None, 0.9, 0.9, 0.9], "ABSTAINED", None, 0)])
def test_attack_horizon(spark, ps, state, onset, run):
    df = spark.createDataFrame([("c", i + 1, p) for i, p in enumerate(ps)], "case_id string, horizon int, p double")
    got = fc.attack_horizon(df).first()
    assert (got["state"], got["onset_horizon"], got["horizon_windows"]) == (state, onset, run)


def test_undefined_metrics_are_null_with_reason(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "target int, p double")
    m = ev.confusion(df).first()
    assert m["precision"] is None and m["f1"] is None and m["undefined_reason"] == "no positive predictions"
    assert ev.auc(df).first()["roc_auc"] is None


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "target int, p double")
    assert abs(ev.auc(df).first()["roc_auc"] - 0.875) < 1e-12


def test_single_class_training_is_refused(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(20)], "x double, y int")
    assert ev.fit_logistic(df, ["x"], "y") is None


def test_full_mahalanobis_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]])
    df = spark.createDataFrame([tuple(map(float, r)) + (i,) for i, r in enumerate(x)], "a double, b double, c double, i int")
    got = {r["i"]: r["distance"] for r in ev.full_mahalanobis(df, ["a", "b", "c"], F.lit(True)).collect()}
    inv = np.linalg.inv(np.cov(x.T) + 1e-3 * np.eye(3))
    dev = x - x.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", dev, inv, dev))
    assert max(abs(got[i] - want[i]) for i in range(200)) < 1e-9


def test_world_diff(spark):
    cols = "bucket bigint, entity string, attack_state string, fanout bigint, packets bigint, bytes_sent bigint, bytes_recv bigint"
    e = spark.createDataFrame([(0, "a", "BENIGN", 1, 5, 10, 0), (0, "gone", "BENIGN", 1, 1, 1, 0), (1, "a", "RECONNAISSANCE", 5, 5, 10, 0), (1, "new", "BENIGN", 1, 1, 1, 1)], cols)
    r = spark.createDataFrame([(0, "a->b"), (1, "a->b"), (1, "a->c")], "bucket bigint, relationship_id string")
    got = {(x["change"], x["item"]) for x in gr.world_diff(e, r, F.lit(0), F.lit(1)).collect()}
    assert got == {("ENTITY_PERSISTED", "a"), ("ATTACK_STATE_TRANSITION", "a"), ("FANOUT_SURGE", "a"), ("ENTITY_NOT_OBSERVED", "gone"), ("ENTITY_ADDED", "new"), ("RELATIONSHIP_ADDED", "a->c")}


def test_incident_relations(spark):
    s = spark.createDataFrame([("i1", "x", "t", 22, "TCP", "R", 0), ("i2", "x", "t", 22, "TCP", "R", 1), ("i3", "y", "t", 22, "TCP", "R", 2), ("i4", "q", "z", 9, "UDP", "E", 3)],
                              "incident string, src_ip string, dst_ip string, dst_port int, protocol string, state string, bucket int")
    atk = F.col("state") == "R"
    fp, m = pt.incident_fingerprint(s, "incident", atk, atk), pt.incident_members(s, "incident", atk)
    got = {(r["incident_a"], r["incident_b"]): (r["relationship"], r["evolution"]) for r in pt.incident_correlate(fp, m, "incident").collect()}
    assert got[("i1", "i2")] == ("RELATED_CAMPAIGN", "REPEATED_RECONNAISSANCE")
    assert got[("i1", "i3")] == ("RELATED_CAMPAIGN", "CHANGING_INFRASTRUCTURE")
    assert all("i4" not in k for k in got)
    c = pt.campaign_clusters(pt.incident_correlate(fp, m, "incident"), fp, "incident").first()
    assert (c["component"], c["members"]) == ("i1", 3)


def test_hunt_rejects_bad_requests_and_missing_fails(spark):
    with pytest.raises(ValueError):
        hunt.where(hunt.Request("ENTITY", [hunt.Predicate("entity.shoe_size", "=", 1)]))
    with pytest.raises(ValueError):
        hunt.where(hunt.Request("ENTITY", [hunt.Predicate("entity.beaconing", ">", 1)]))
    with pytest.raises(ValueError):
        hunt.predicate(F.col("x"), "IN", "abc")
    df = spark.createDataFrame([("A", None), ("b", "12"), ("c", "junk")], "k string, x string")
    pick = lambda col: [r["k"] for r in df.filter(col).collect()]
    assert pick(hunt.predicate(F.col("x"), ">", 10)) == ["b"]
    assert pick(hunt.predicate(F.col("x"), "!=", "12")) == ["c"]
    assert pick(hunt.predicate(F.col("x"), "NOT_EXISTS")) == ["A"]
    assert pick(hunt.predicate(F.col("k"), "=", "a")) == ["A"]


def test_logs_from_files(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tduration\torig_bytes\tresp_bytes\tconn_state\thistory\n"
                                       "1.5\tC1\ta\t1\tb\t80\ttcp\t2.0\t10\t-\tSF\tShAF\nbroken\n")
    f = logs.zeek_conn_to_flows(logs.zeek_tsv(logs.read_lines(spark, str(tmp_path / "conn.log")))).collect()
    assert len(f) == 1 and f[0]["completeness"] == "ESTABLISHED" and f[0]["total_bytes"] == 10 and f[0]["packet_rate"] == 1.0 and f[0]["rst_count"] == 0
    (tmp_path / "eve.json").write_text('{"timestamp":"2024-01-01T00:00:10Z","event_type":"alert","src_ip":"a","alert":{"signature":"s","severity":1,"metadata":{"mitre_technique_id":["T1046"]}}}\nnot json\n')
    a = logs.eve_alerts(logs.parse_eve(logs.read_lines(spark, str(tmp_path / "eve.json")))).collect()
    assert [(x["severity"], x["technique"], x["ts"]) for x in a] == [("CRITICAL", "T1046", 1704067210.0)]
    row = ["0"] * 49
    row[28], row[7], row[48], row[47], row[4] = "100", "5", "1", " Dos ", "tcp"
    (tmp_path / "wide.csv").write_text(",".join(row) + "\nshort,row\n")
    good, bad = corpora.read_wide_csv(spark, str(tmp_path / "wide.csv"))
    assert good.first()["attack_cat"] == "Dos" and good.count() == 1 and bad.count() == 1


def test_packet_rows_with_bad_times_are_set_aside(spark):
    raw = spark.createDataFrame([("1.5", "a", "b", "tcp"), ("nan", "a", "b", "tcp"), ("x", "a", "b", "tcp"), ("2", None, "b", "tcp")], "timestamp string, src_ip string, dst_ip string, protocol string")
    good, bad = pq.normalize_packets(raw)
    assert [r["protocol"] for r in good.collect()] == ["TCP"]
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["bad_timestamp", "bad_timestamp", "no_source"]


def test_stream_drops_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "event_time timestamp, src_ip string, packet_length int, tcp_flags int"
    rows = lambda ts: spark.createDataFrame([(t, "a", 10, 2) for t in ts], "t long, src_ip string, packet_length int, tcp_flags int").select(
        F.timestamp_seconds("t").alias("event_time"), "src_ip", "packet_length", "tcp_flags").coalesce(1)
    rows([0, 10, 1000]).write.parquet(src)
    import time
    for late in ([1500], [5, 2000]):  # file order decides the batches; lateness is judged by the batch before
        time.sleep(1.1)
        rows(late).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out, progress = live.run_available(live.window_stats(s, "60 seconds", "100 seconds"))
    got = {r["window_start"]: r["packet_count"] for r in out.collect()}
    assert got[0] == 2 and live.dropped_late(progress) == 1


def test_cumulative_risk_with_a_certain_step(spark):
    df = spark.createDataFrame([("c", 1, 0.5), ("c", 2, 1.0), ("c", 3, 0.1)], "case_id string, horizon int, p double")
    got = [r["cumulative_risk"] for r in fc.cumulative_risk(df).orderBy("horizon").collect()]
    assert math.isclose(got[0], 0.5) and got[1:] == [1.0, 1.0]


def test_rotated_zeek_logs(spark, tmp_path):
    """Files with other headers, JSON files and broken lines in one folder."""
    (tmp_path / "a.log").write_text("#separator \\x09\n#fields\tts\tuid\tproto\n1\tC1\ttcp\nshort\n")
    (tmp_path / "b.log").write_text("#fields\tuid\tts\nC2\t-\nC3\t3\textra\n")
    (tmp_path / "c.log").write_text('{"uid": "C4", "ts": 4}\n{broken\n\n')
    (tmp_path / "d.log").write_text("no\theader\n")
    got = logs.zeek_logs(spark, str(tmp_path), ["uid", "ts", "proto"]).collect()
    assert sorted(map(tuple, got), key=repr) == [("C1", "1", "tcp"), ("C2", None, None), ("C3", "3", None), ("C4", "4", None)]


def test_store_replaces_deletes_and_survives_a_failed_change(spark, tmp_path):
    from packetloom.sinks import store as st
    s = st.AnalysisStore(spark, str(tmp_path / "store"))
    kind = "analysis_id string, evidence array<struct<rule_id:string,value:double,threshold:double>>, n int"
    rows = lambda *x: spark.createDataFrame([(i, [("r", 1.0, 2.0)], n) for i, n in x], kind)
    s.upsert(rows(("a", 0), ("b", 0)).select("analysis_id"), rows(("a", 1), ("a", 2), ("b", 3)))
    s.upsert(rows(("a", 0)).select("analysis_id"), rows(("a", 9)))
    assert sorted((r.analysis_id, r.n, r.rule_id) for r in s.read("findings").collect()) == [("a", 9, "r"), ("b", 3, "r")]
    rows(("b", 7)).write.parquet(str(tmp_path / "store" / "findings" / "version=9"))  # a change that died before its marker
    s.delete(rows(("a", 0)))
    assert [(r.analysis_id, r.n) for r in s.read("findings").collect()] == [("b", 3)]
    assert [r.analysis_id for r in s.read("analyses").collect()] == ["b"] and s.get("a")[1].count() == 0


def test_experiment_output(spark, tmp_path):
    from packetloom.sinks import store as st
    metrics = spark.createDataFrame([("m", 1, 0.1, 0.5, 0.2), ("m", 2, 0.3, 0.7, 0.4)], "model string, horizon int, brier double, f1 double, ece double")
    st.write_experiment(spark.createDataFrame([(1, 0.5)], "id int, p double"), metrics, str(tmp_path / "x"))
    got = spark.read.json(str(tmp_path / "x" / "summary")).first()
    assert (got.horizons, round(got.mean_brier, 6), round(got.mean_f1, 6)) == (2, 0.2, 0.6)
    assert spark.read.json(str(tmp_path / "x" / "predictions")).count() == 1 and spark.read.json(str(tmp_path / "x" / "metrics")).count() == 2
