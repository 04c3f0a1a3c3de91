"""Forecast and evaluation queries: FC*, EV*, SNK3, SNK4, ENT24."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.columns import r
from packetloom.operators import entities as en, evaluate as ev, forecast as fc, graph as gr, solvers, windows as win
from packetloom.plans import base
from packetloom.plans.a_views import EP, W
from packetloom.plans.registry import cte, query
from packetloom.session import shared
from packetloom.sinks import store

col = F.col
cte("epq_v", """
SELECT *, sum(nw) OVER (ORDER BY bucket) AS episode_id FROM (SELECT bucket, share, attack_state, CASE WHEN bucket - lag(bucket) OVER (ORDER BY bucket) <> 1 THEN 1 ELSE 0 END AS nw FROM labels_q)""")
cte("case_v", """
SELECT CAST(episode_id AS BIGINT) AS episode_id, bucket AS source_bucket, attack_state, share, """ + ", ".join(
    f"lead(attack_state, {k}) OVER w AS y{k}" for k in fc.HORIZONS) + """, count(*) OVER (PARTITION BY episode_id ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hl,
 min(bucket) OVER (PARTITION BY episode_id ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS history_start
FROM epq_v WINDOW w AS (PARTITION BY episode_id ORDER BY bucket)""")
cte("cases_v", "SELECT * FROM case_v WHERE hl = 8 AND " + " AND ".join(f"y{k} IS NOT NULL" for k in fc.HORIZONS))
cte("pts_v", " UNION ALL ".join(f"SELECT episode_id, source_bucket, attack_state AS current, share, {k} AS horizon, y{k} AS target FROM cases_v" for k in fc.HORIZONS))
cte("mk_v", """
SELECT (1 + count(*) FILTER (WHERE p = 0 AND a = 1)) / (2 + count(*) FILTER (WHERE p = 0)) AS up, (1 + count(*) FILTER (WHERE p = 1 AND a = 1)) / (2 + count(*) FILTER (WHERE p = 1)) AS stay FROM (
 SELECT attack_state AS a, lag(attack_state) OVER (PARTITION BY episode_id ORDER BY bucket) AS p FROM epq_v)""")
cte("share_pts", "SELECT episode_id, source_bucket AS case_id, source_bucket, current, horizon, target, least(1.0::DOUBLE, share * (0.7::DOUBLE + 0.1::DOUBLE * horizon)) AS p FROM pts_v")
cte("pred_v", """
SELECT 'persistence' AS model, horizon, target, CAST(current AS DOUBLE) AS p FROM pts_v UNION ALL SELECT 'majority', horizon, target, (SELECT avg(attack_state) FROM epq_v) FROM pts_v UNION ALL
SELECT 'markov', horizon, target, up / (1 - stay + up) + (current - up / (1 - stay + up)) * pow(stay - up, horizon) FROM pts_v, mk_v UNION ALL SELECT 'share', horizon, target, p FROM share_pts""")


def eps(spark, d):
    return shared(fc.contiguous_episodes(base.views.labels(spark, d, EP)))


def cases(spark, d):
    return fc.forecast_cases(eps(spark, d))


def share_points(spark, d):
    """One scored point per (case, horizon) from the window's error share."""
    c = cases(spark, d)
    p = fc.horizons_of(c).join(c.select("source_bucket", "share"), "source_bucket")
    return shared(p.withColumns({"case_id": col("source_bucket"), "p": F.least(F.lit(1.0), col("share") * (0.7 + 0.1 * col("horizon")))}))


def preds(spark, d):
    pts, e = fc.horizons_of(cases(spark, d)), eps(spark, d)
    cols = ("model", "horizon", "target", "p", "current", "source_bucket", "episode_id")
    out = fc.persistence(pts).select(*cols)
    for x in (fc.majority(pts, e), fc.markov(pts, e), share_points(spark, d).withColumn("model", F.lit("share"))):
        out = out.unionByName(x.select(*cols))
    return shared(out)


@query("fc1_contiguous_episodes", "SELECT bucket, attack_state, CAST(episode_id AS BIGINT) AS episode_id FROM epq_v")
def fc1(spark, d):
    return eps(spark, d).select("bucket", "attack_state", "episode_id")


EPS_SQL = f"""
SELECT CAST(episode_id AS BIGINT) AS episode_id, min(bucket) AS start_bucket, max(bucket) AS end_bucket, count(*) AS windows, count(*) FILTER (WHERE attack_state = 1) AS attack_windows, count(*) FILTER (WHERE attack_state = 0) AS benign_windows,
 count(*) FILTER (WHERE attack_state IS NULL) AS unknown_windows, count(*) FILTER (WHERE attack_state = 1) > 0 AND count(*) FILTER (WHERE attack_state = 0) > 0 AS has_both_classes, greatest(0, count(*) - 12) AS eligible_cases,
 coalesce((min(bucket) - lag(max(bucket)) OVER (ORDER BY episode_id)) * {EP}, 0) AS prior_gap_seconds FROM epq_v GROUP BY episode_id"""


@query("fc2_episode_stats", EPS_SQL)
def fc2(spark, d):
    return fc.episode_stats(eps(spark, d), seconds=EP)


@query("fc3_forecast_cases", "SELECT episode_id, source_bucket, history_start, y1, y2, y3, y4, y5 FROM cases_v")
def fc3(spark, d):
    return cases(spark, d).select("episode_id", "source_bucket", "history_start", *[f"y{k}" for k in fc.HORIZONS])


@query("fc4_onset_events", """
WITH x AS (SELECT *, lag(attack_state) OVER (PARTITION BY episode_id ORDER BY bucket) AS p, row_number() OVER (PARTITION BY episode_id ORDER BY bucket) AS i FROM epq_v),
y AS (SELECT *, sum(CASE WHEN attack_state <> p THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY bucket) AS run FROM x),
g AS (SELECT episode_id, run, min(bucket) AS bucket, count(*) AS run_length, min(i) AS i, min(attack_state) AS a FROM y GROUP BY 1, 2)
SELECT CAST(episode_id AS BIGINT) AS episode_id, bucket, CASE WHEN a = 1 THEN 'ONSET' ELSE 'TEARDOWN' END AS event, run_length, pre_run, CAST(i - 1 AS INT) AS rows_before FROM (SELECT *, lag(run_length) OVER (PARTITION BY episode_id ORDER BY run) AS pre_run FROM g) WHERE run > 0""")
def fc4(spark, d):
    return fc.onset_events(eps(spark, d))


cte("split_v", """
SELECT *, CASE WHEN position < floor(n * 0.7::DOUBLE) THEN 'train' WHEN position < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM (
 SELECT bucket, attack_state, row_number() OVER (ORDER BY bucket) - 1 AS position, (SELECT count(*) FROM labels_q) AS n FROM labels_q)""")


def split(spark, d):
    return fc.chronological_split(base.views.labels(spark, d, EP), [F.asc("bucket")])


@query("fc5_chronological_split", "SELECT bucket, position, split FROM split_v")
def fc5(spark, d):
    return split(spark, d).select("bucket", "position", "split")


@query("fc6_embargo", """
WITH k AS (SELECT * FROM split_v WHERE split <> 'val' OR bucket > (SELECT max(bucket) FROM split_v WHERE split = 'train') + 12)
SELECT bucket, split FROM k WHERE split <> 'test' OR bucket > (SELECT max(bucket) FROM k WHERE split = 'val') + 12""")
def fc6(spark, d):
    return fc.embargo(split(spark, d), "bucket", 12).select("bucket", "split")


@query("fc6_embargo_steps", """
SELECT split, count(*) AS rows, min(bucket) AS first_bucket FROM (SELECT *, position - min(position) OVER (PARTITION BY split) AS k FROM split_v) WHERE split = 'train' OR k >= 5 GROUP BY 1""")
def fc6_steps(spark, d):
    return fc.embargo_steps(split(spark, d), 5).groupBy("split").agg(F.count("*").alias("rows"), F.min("bucket").alias("first_bucket"))


@query("fc7_split_audit", """
SELECT *, train_max < val_min AS train_before_val, val_max < test_min AS val_before_test, val_min - train_max >= 1 AND test_min - val_max >= 1 AS embargo_respected FROM (
 SELECT max(bucket) FILTER (WHERE split = 'train') AS train_max, min(bucket) FILTER (WHERE split = 'val') AS val_min, max(bucket) FILTER (WHERE split = 'val') AS val_max, min(bucket) FILTER (WHERE split = 'test') AS test_min FROM split_v)""")
def fc7(spark, d):
    return fc.split_audit(split(spark, d), "bucket", 1)


@query("fc7_window_leakage", "SELECT count(*) AS cases, count(*) FILTER (WHERE source_bucket - history_start <> 7) AS broken_history, 0::BIGINT AS future_in_history FROM cases_v")
def fc7_windows(spark, d):
    return fc.window_leakage(cases(spark, d))


@query("fc8_episode_split", "SELECT CASE WHEN episode_id = 0 THEN 'train' WHEN episode_id = 1 THEN 'val' ELSE 'test' END AS split, count(*) AS windows, count(DISTINCT episode_id) AS episodes FROM epq_v GROUP BY 1")
def fc8(spark, d):
    return fc.episode_split(eps(spark, d)).groupBy("split").agg(F.count("*").alias("windows"), F.count_distinct("episode_id").alias("episodes"))


@query("fc8_mixed_run_split", """
WITH f AS (SELECT min(episode_id) AS e FROM (SELECT episode_id FROM epq_v GROUP BY 1 HAVING count(DISTINCT attack_state) > 1))
SELECT bucket, CASE WHEN row_number() OVER (ORDER BY bucket) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM epq_v WHERE episode_id = (SELECT e FROM f)""")
def fc8_mixed(spark, d):
    return fc.mixed_run_split(eps(spark, d)).select("bucket", "split")


for name, key in (("fc9_persistence", "persistence"), ("fc10_majority", "majority"), ("fc11_markov_transition", "markov")):
    expr = {"persistence": "CAST(current AS DOUBLE)", "majority": "(SELECT avg(attack_state) FROM epq_v)",
            "markov": "up / (1 - stay + up) + (current - up / (1 - stay + up)) * pow(stay - up, horizon)"}[key]

    def _run(spark, d, key=key):
        return preds(spark, d).filter(col("model") == key).select("source_bucket", "horizon", "target", r(col("p")).alias("p"))
    query(name, f"SELECT source_bucket, horizon, target, round({expr}, 6) AS p FROM pts_v, mk_v")(_run)


def lag_features(spark, d):
    """Cases with the eight history labels and the share as columns."""
    c = cases(spark, d)
    return c.select("episode_id", "source_bucket", "attack_state", "share", *[f"y{k}" for k in fc.HORIZONS],
                    *[col("history")[i].cast("double").alias(f"h{i}") for i in range(8)])


FLAT = [f"h{i}" for i in range(8)] + ["share"]


def train_test(spark, d):
    x = shared(lag_features(spark, d))
    cut = x.agg((F.min("source_bucket") + 0.7 * (F.max("source_bucket") - F.min("source_bucket"))).alias("c")).scalar()
    return x.filter(col("source_bucket") < cut), x.filter(col("source_bucket") >= cut)


@query("fc12_logistic")
def fc12(spark, d):
    tr, te = train_test(spark, d)
    return ev.logistic_forecast(tr, te, FLAT).select("source_bucket", "horizon", "target", r(col("p"), 4).alias("p"))


@query("fc13_heuristic_baselines", """
WITH s AS (SELECT w.bucket, syn_count, packet_count, unique_dst_ports, f.n AS flow_count FROM win_stats w JOIN (SELECT bucket, count(DISTINCT (src_ip, src_port, dst_ip, dst_port, protocol)) AS n FROM iat_v GROUP BY 1) f USING (bucket)),
p AS (SELECT bucket, round(least(0.95, greatest(0.05, syn_count / greatest(1.0, packet_count) * 0.5::DOUBLE + unique_dst_ports / greatest(1.0, flow_count) * 0.4::DOUBLE)), 4) AS p FROM s)
SELECT bucket, CAST(h AS INT) AS horizon, p, round(1 - pow(1 - p, h), 4) AS cumulative_risk FROM p, (SELECT unnest([1, 2, 3, 5, 10]) AS h)""")
def fc13(spark, d):
    p = base.packets_marked(spark, d)
    s = win.scan_windows(p, W)
    f = win.with_bucket(p, W).groupBy("bucket").agg(F.count_distinct("src_ip", "src_port", "dst_ip", "dst_port", "protocol").alias("flow_count"))
    x = s.join(f, "bucket").withColumn("total_packets", col("packet_count"))
    return fc.heuristic_baseline(x).select("bucket", "horizon", "p", "cumulative_risk")


@query("fc14_cumulative_risk", """
SELECT case_id, horizon, round(CASE WHEN max(CASE WHEN p >= 1 THEN 1 ELSE 0 END) OVER w = 1 THEN 1 ELSE 1 - exp(sum(ln(CASE WHEN p < 1 THEN 1 - p ELSE 1 END)) OVER w) END, 6) AS cumulative_risk FROM share_pts
WINDOW w AS (PARTITION BY case_id ORDER BY horizon)""")
def fc14(spark, d):
    return fc.cumulative_risk(share_points(spark, d)).select("case_id", "horizon", r(col("cumulative_risk")).alias("cumulative_risk"))


cte("wide_v", "SELECT case_id, " + ", ".join(f"max(p) FILTER (WHERE horizon = {k}) AS p{k}" for k in fc.HORIZONS) + " FROM share_pts GROUP BY 1")
cte("ews_v", """
SELECT case_id, CAST(round(least(100.0, greatest(0.0, 35.0::DOUBLE * p1 + 35.0::DOUBLE * (1 - (1 - p1) * (1 - p2) * (1 - p3) * (1 - p4) * (1 - p5)) + 15.0::DOUBLE * greatest(0, p3 - p1)
 + 15.0::DOUBLE * least(1, greatest(0, (10 + 3 * p3 * 20 - (10 + p1 * 20)) / greatest(10 + p1 * 20, 1))))), 0) AS INT) AS early_warning_score FROM wide_v""")


def traj(spark, d):
    k = col("horizon")
    return share_points(spark, d).withColumns({"ports": F.lit(10.0) + col("p") * 20.0 * F.when(k == 3, 3.0).otherwise(1.0), "packets": 300.0 + 2000.0 * col("p") * (k == 5).cast("int")})


@query("fc15_early_warning_score", """
SELECT *, CASE WHEN early_warning_score >= 75 THEN 'CRITICAL' WHEN early_warning_score >= 50 THEN 'HIGH' WHEN early_warning_score >= 25 THEN 'ELEVATED' ELSE 'NORMAL' END AS level FROM ews_v""")
def fc15(spark, d):
    return fc.early_warning(traj(spark, d))


@query("fc16_risk_level", """
SELECT bucket, CASE WHEN share >= 0.75 THEN 'CRITICAL' WHEN share >= 0.5 THEN 'HIGH' WHEN share >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 CASE WHEN share < 0.4 THEN 'STABLE_BENIGN' WHEN syn_count > 50 OR (packet_count > 1000 AND tcp_count > 0.8 * packet_count) OR (packet_count > 2000 AND udp_count > 0.8 * packet_count) THEN 'DENIAL_OF_SERVICE'
  WHEN unique_dst_ports > 15 OR (unique_dst_ports > 8 AND packet_count < 500) THEN 'RECONNAISSANCE' WHEN share >= 0.7 THEN 'EXPLOITATION' ELSE 'ATTACK_IMMINENT' END AS stage FROM labels_h JOIN win_stats USING (bucket)""")
def fc16(spark, d):
    rows = win.with_bucket(base.packets_marked(spark, d), W)
    s = win.base_stats(rows, with_iat=False).join(win.distinct_endpoints(rows), ["capture_id", "bucket"]).join(base.views.labels(spark, d, W), "bucket")
    return s.select("bucket", fc.risk_level(col("share")).alias("risk_level"), fc.stage_rule(
        col("share"), col("unique_dst_ports"), col("tcp_count"), col("udp_count"), col("packet_count"), col("syn_count"), F.lit(0), F.lit(0)).alias("stage"))


cte("hor_v", """
WITH a AS (SELECT case_id, list(p ORDER BY horizon) AS p, list(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END ORDER BY horizon) AS a FROM share_pts GROUP BY 1),
b AS (SELECT *, list_sum(a) AS pos, list_position(a, 1) AS onset, len(list_filter(p, lambda x: abs(x - 0.5) <= 0.03)) AS near,
 CAST(a[1] <> a[2] AS INT) + CAST(a[2] <> a[3] AS INT) + CAST(a[3] <> a[4] AS INT) + CAST(a[4] <> a[5] AS INT) AS flips,
 (a[1] + a[2] = 2) OR (a[2] + a[3] = 2) OR (a[3] + a[4] = 2) OR (a[4] + a[5] = 2) AS adj FROM a),
c AS (SELECT *, CASE WHEN onset IS NULL THEN 0 ELSE coalesce(list_position(a[onset:5], 0) - 1, 6 - onset) END AS run FROM b)
SELECT *, CASE WHEN (pos >= 2 AND flips >= 3 AND NOT adj) OR (near >= 3 AND flips >= 1) THEN 'UNCERTAIN_FORECAST' WHEN pos = 0 THEN 'NO_ATTACK_FORECAST' WHEN run >= 2 THEN 'SUSTAINED_ATTACK_FORECAST' ELSE 'EARLY_SIGNAL' END AS state,
 coalesce(run > 1 AND onset < 5 AND len(list_filter(range(onset, 5), lambda i: p[i] >= p[i + 1] - 1e-6)) = 5 - onset, false) AS decay FROM c""")


@query("fc17_attack_horizon", """
SELECT case_id, state, CASE WHEN state IN ('SUSTAINED_ATTACK_FORECAST', 'EARLY_SIGNAL') THEN CAST(onset AS INT) END AS onset_horizon, CASE WHEN state IN ('SUSTAINED_ATTACK_FORECAST', 'EARLY_SIGNAL') THEN CAST(onset * 60 AS INT) END AS lead_time_seconds,
 CASE WHEN state IN ('SUSTAINED_ATTACK_FORECAST', 'EARLY_SIGNAL') THEN CAST(run AS INT) ELSE 0 END AS horizon_windows, CASE WHEN state IN ('SUSTAINED_ATTACK_FORECAST', 'EARLY_SIGNAL') THEN CAST(onset + run - 1 AS INT) END AS end_horizon,
 round(CASE state WHEN 'UNCERTAIN_FORECAST' THEN greatest(0, 1 - flips / 4) WHEN 'NO_ATTACK_FORECAST' THEN 1 ELSE run / pos END, 4) AS temporal_consistency,
 state IN ('SUSTAINED_ATTACK_FORECAST', 'EARLY_SIGNAL') AND decay AS decay_observed FROM hor_v""")
def fc17(spark, d):
    return fc.attack_horizon(share_points(spark, d)).withColumn("temporal_consistency", r(col("temporal_consistency"), 4))


ST = ("BENIGN_OBSERVATION", "RECONNAISSANCE", "COMMAND_AND_CONTROL", "DENIAL_OF_SERVICE")
MATRIX = " UNION ALL ".join(f"SELECT '{s}' AS s, {k} AS k, '{t}' AS t, {p}::DOUBLE AS p" for s, to in fc.STAGE_STEPS.items() for t, ps in to.items() for k, p in enumerate(ps, start=1))


@query("fc18_stage_markov", f"""
WITH m AS ({MATRIX}), c AS (SELECT source_bucket, CASE source_bucket % 4 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ST))} END AS state FROM cases_v)
SELECT source_bucket, state, k AS horizon, arg_max(t, p) AS predicted_stage, max(p) AS stage_probability FROM c JOIN m ON c.state = m.s GROUP BY 1, 2, 3""")
def fc18(spark, d):
    st = F.array(*[F.lit(s) for s in ST])
    c = cases(spark, d).select("source_bucket", st[(col("source_bucket") % 4).cast("int")].alias("state"))
    return fc.stage_markov(c, "state", fc.stage_matrices(spark))


@query("fc19_forecast_validation", """
SELECT s.case_id, s.horizon, l.attack_state AS actual, CASE WHEN l.bucket IS NULL THEN 'NOT_AVAILABLE' WHEN (s.p >= 0.5) = (l.attack_state = 1) THEN 'CONSISTENT' ELSE 'DIVERGENT' END AS validation_status
FROM share_pts s LEFT JOIN labels_q l ON l.bucket = s.source_bucket + s.horizon""")
def fc19(spark, d):
    return fc.forecast_validation(share_points(spark, d), base.views.labels(spark, d, EP)).select("case_id", "horizon", "actual", "validation_status")


GATE_SQL = """SELECT bucket, CASE WHEN packet_count < 5 THEN 1 ELSE 0 END AS gaps, bucket - (SELECT min(bucket) FROM win_stats) AS windows, CASE WHEN iat_max IS NULL THEN 1 ELSE 0 END AS missing,
 CASE WHEN fragment_count > 1 THEN 'INSUFFICIENT' ELSE 'GOOD' END AS quality, icmp_packet_ratio > 0.5 AS unknown, udp_packet_ratio * 2 AS ood, icmp_packet_ratio * 2 AS uncertainty, fragment_count > 0 AS degraded FROM win_stats"""


@query("fc20_abstention_gate", f"""
SELECT bucket, CASE WHEN gaps > 0 THEN 'GAPPED_HISTORY' WHEN windows < 8 THEN 'INSUFFICIENT_HISTORY' WHEN missing > 0 THEN 'MISSING_REQUIRED_FEATURES' WHEN quality = 'INSUFFICIENT' THEN 'POOR_CAPTURE_QUALITY' WHEN unknown THEN 'UNKNOWN_BEHAVIOR' END AS abstention_reason,
 CASE WHEN gaps > 0 OR windows < 8 OR quality = 'INSUFFICIENT' THEN 'ABSTAIN' WHEN ood > 0.85 OR uncertainty > 0.8 THEN 'ANOMALY_ONLY' WHEN degraded THEN 'DEGRADED_FORECAST' ELSE 'FULL_FORECAST' END AS tier FROM ({GATE_SQL})""")
def fc20(spark, d):
    rows = win.interarrival(base.packets_marked(spark, d), W)
    s = win.base_stats(rows)
    lo = s.agg(F.min("bucket").alias("m")).scalar()
    x = s.select("bucket", (col("packet_count") < 5).cast("int").alias("gaps"), (col("bucket") - lo).alias("windows"), col("iat_max").isNull().cast("int").alias("missing"),
                 F.when(col("fragment_count") > 1, "INSUFFICIENT").otherwise("GOOD").alias("quality"), (col("icmp_packet_ratio") > 0.5).alias("unknown"),
                 (col("udp_packet_ratio") * 2).alias("ood"), (col("icmp_packet_ratio") * 2).alias("uncertainty"), (col("fragment_count") > 0).alias("degraded"))
    return fc.abstention_gate(x).select("bucket", "abstention_reason", "tier")


@query("fc21_unknown_behaviour", """
WITH x AS (SELECT bucket, tcp_count AS tcp, udp_count AS udp, icmp_count AS o, packet_count AS n, icmp_packet_ratio > 0.3 AS ap, fragment_count + 1 AS s, udp_count AS c, icmp_packet_ratio AS st FROM win_stats)
SELECT bucket, CASE WHEN tcp + udp + o > 10 AND o / (tcp + udp + o) > 0.6 THEN 'UNKNOWN_PROTOCOL_MIX' WHEN ap AND st < 0.15 AND c >= 2 THEN 'MODEL_EVIDENCE_DISAGREEMENT' WHEN c >= 3 AND c > s THEN 'CONTRADICTORY_EVIDENCE'
 WHEN ap AND st >= 0.6 AND s >= 2 THEN 'KNOWN_ATTACK' WHEN ap THEN 'WEAK_ATTACK_EVIDENCE' WHEN c = 0 THEN 'KNOWN_BENIGN' ELSE 'MIXED_BENIGN' END AS behaviour FROM x""")
def fc21(spark, d):
    return behaviour(spark, d).select("bucket", "behaviour")


def behaviour(spark, d):
    s = win.base_stats(win.with_bucket(base.packets_marked(spark, d), W), with_iat=False)
    x = s.select("bucket", col("tcp_count").alias("tcp"), col("udp_count").alias("udp"), col("icmp_count").alias("other"), col("packet_count").alias("flows"),
                 F.lit(1).alias("ports"), F.lit(0).alias("bytes"), col("packet_count").alias("packets"), (col("icmp_packet_ratio") > 0.3).alias("attack_predicted"),
                 (col("fragment_count") + 1).alias("supporting"), col("udp_count").alias("contradicting"), col("icmp_packet_ratio").alias("strength"))
    return fc.unknown_behaviour(x)


CONF_SQL = """SELECT case_id, horizon, p, p * 0.8 AS strength, horizon % 3 AS contradicting, 2 - horizon % 2 AS supporting, target = 1 AND horizon = 5 AS degraded, p BETWEEN 0.48 AND 0.49 AS uh, current = 1 AS cal FROM share_pts"""


def conf(spark, d):
    k = col("horizon")
    x = share_points(spark, d).withColumns({"strength": col("p") * 0.8, "contradicting": k % 3, "supporting": 2 - k % 2, "degraded": (col("target") == 1) & (k == 5),
                                            "uncertain_horizon": col("p").between(0.48, 0.49), "calibrated": col("current") == 1})
    return fc.confidence_state(x)


@query("fc22_confidence_state", f"""
WITH x AS (SELECT *, abs(p - 0.5) <= 0.05 AS hov, contradicting >= 2 AND contradicting >= supporting AS con FROM ({CONF_SQL})),
y AS (SELECT *, CASE WHEN uh OR (hov AND con) OR degraded THEN 'HIGH' WHEN hov OR con OR strength < 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS uncertainty_level FROM x)
SELECT case_id, horizon, uncertainty_level, CASE WHEN uncertainty_level = 'HIGH' THEN 'HIGH_UNCERTAINTY' WHEN strength < 0.25 AND (cal OR p >= 0.5) THEN 'LOW_SUPPORT' WHEN NOT cal THEN 'UNCALIBRATED' ELSE 'CALIBRATED' END AS confidence_state,
 round(CASE WHEN cal THEN abs(p - 0.5) * 2 END, 6) AS confidence FROM y""")
def fc22(spark, d):
    return conf(spark, d).select("case_id", "horizon", "uncertainty_level", "confidence_state", r(col("confidence")).alias("confidence"))


@query("fc23_graph_fusion", """
WITH c AS (SELECT * FROM gc_v WHERE bucket = (SELECT max(bucket) FROM gc_v)), m AS (SELECT *, greatest(0.8, least(2.5, edge_count / lag(edge_count) OVER (ORDER BY bucket))) AS rate FROM gm_v),
x AS (SELECT m.*, k, (SELECT count(*) FROM c WHERE fan_out >= 5) AS tn, node_count + (SELECT count(*) FROM c WHERE structural_change > 0.3) * least(k, 2) AS pn, CAST(floor(edge_count * (1 + (rate - 1) * pow(0.6, k))) AS BIGINT) AS pe FROM m, (SELECT unnest(range(1, 6)) AS k) WHERE bucket = (SELECT max(bucket) FROM gm_v)),
g AS (SELECT k, tn, least(1.0, pe / (pn * (pn - 1))) AS pd, density, max_fan_out * CASE WHEN tn > 0 THEN 1 + 0.15 * k ELSE 1 END AS fo FROM x)
SELECT case_id, horizon, CASE WHEN pd > density * 1.05 THEN 'EXPANDING' WHEN pd < density * 0.95 THEN 'CONTRACTING' ELSE 'STABLE' END AS density_trend,
 concat_ws(',', CASE WHEN p >= 0.5 AND fo >= 10 THEN 'T1046' END, CASE WHEN p >= 0.5 AND tn > 0 THEN 'T1021' END) AS attributions FROM share_pts JOIN g ON horizon = k""")
def fc23(spark, d):
    from packetloom.plans.f_graph import changed
    e, n = changed(spark, d)
    m = gr.graph_metrics(e, n)
    last = m.filter(col("bucket") == gr.latest_bucket(m)).agg(F.max("density").alias("x")).scalar()
    proj = gr.graph_projection(m, n).withColumn("current_density", last)
    return fc.graph_fusion(share_points(spark, d), proj).select("case_id", "horizon", "density_trend", "attributions")


cte("evi_v", f"SELECT CAST(floor(ts / {EP}) AS BIGINT) AS case_id, protocol, CASE WHEN packet_length < 12 THEN 0 ELSE packet_length END AS bytes FROM packets_v")


def evidence(spark, d):
    return base.packets(spark, d).select(F.floor(col("ts") / EP).cast("bigint").alias("case_id"), "protocol", F.when(col("packet_length") < 12, 0).otherwise(col("packet_length")).alias("bytes"))


@query("fc24_belief_update", """
WITH e AS (SELECT case_id, count(*) FILTER (WHERE bytes = 0) AS c, count(*) FILTER (WHERE bytes > 0) AS s FROM evi_v GROUP BY 1)
SELECT case_id, horizon, coalesce(c, 0) AS contradicting, coalesce(s, 0) AS supporting, round(greatest(0.01, least(0.99, p * CASE WHEN c > s THEN 0.75 WHEN s > 0 THEN 1.15 ELSE 1 END)), 6) AS p_updated FROM share_pts LEFT JOIN e USING (case_id)""")
def fc24(spark, d):
    return fc.belief_update(share_points(spark, d), evidence(spark, d)).select("case_id", "horizon", "contradicting", "supporting", r(col("p_updated")).alias("p_updated"))


@query("fc25_what_if", """
WITH i AS (SELECT DISTINCT case_id, least(0.85, 0.45::DOUBLE * 0.8 + CASE WHEN case_id % 2 = 0 THEN 0.35::DOUBLE ELSE 0 END) AS dmp FROM share_pts),
q AS (SELECT case_id, horizon, round(greatest(0.04, p * (1 - dmp * least(1.0, 0.5 + horizon * 0.15::DOUBLE))), 4) AS p FROM share_pts JOIN i USING (case_id))
SELECT case_id, horizon, p, round(1 - exp(sum(ln(1 - p)) OVER (PARTITION BY case_id ORDER BY horizon)), 4) AS cumulative_risk FROM q""")
def fc25(spark, d):
    pts = share_points(spark, d)
    c = pts.select("case_id").distinct()
    i = c.select("case_id", F.lit("isolate_host").alias("type"), F.lit(0.8).alias("intensity")).unionByName(
        c.filter("case_id % 2 = 0").select("case_id", F.lit("block_port").alias("type"), F.lit(1.0).alias("intensity")))
    return fc.what_if(pts, i).select("case_id", "horizon", "p", r(col("cumulative_risk"), 4).alias("cumulative_risk"))


@query("fc26_probability_trend", """
WITH x AS (SELECT *, lag(p) OVER (PARTITION BY case_id ORDER BY horizon) AS q FROM share_pts)
SELECT case_id, horizon, CASE WHEN q IS NULL THEN CASE WHEN p < 0.35 THEN 'STABLE_LOW' WHEN p >= 0.65 THEN 'STABLE_HIGH' ELSE 'UNCERTAIN' END WHEN p - q >= 0.25 THEN 'RAPIDLY_RISING' WHEN p - q >= 0.1 THEN 'RISING' WHEN p - q <= -0.1 THEN 'FALLING'
 WHEN abs(p - 0.5) < 0.1 THEN 'UNCERTAIN' WHEN p < 0.35 THEN 'STABLE_LOW' WHEN p >= 0.65 THEN 'STABLE_HIGH' ELSE 'UNCERTAIN' END AS trend FROM x""")
def fc26(spark, d):
    return fc.probability_trend(share_points(spark, d)).select("case_id", "horizon", "trend")


@query("fc27_trajectory_findings", """
WITH w AS (SELECT *, 10 + p1 * 20 AS a1, 10 + p3 * 60 AS a3, 300.0 AS k1, 300 + 2000 * p5 AS k5, CAST(p1 >= 0.65 AS INT) + CAST(p2 >= 0.65 AS INT) + CAST(p3 >= 0.65 AS INT) + CAST(p4 >= 0.65 AS INT) + CAST(p5 >= 0.65 AS INT) AS hot FROM wide_v)
SELECT case_id, 'RECONNAISSANCE' AS stage FROM w WHERE a3 > a1 * 1.5 AND a3 >= 10 UNION ALL SELECT case_id, 'DENIAL_OF_SERVICE' FROM w WHERE k5 > k1 * 2 AND k5 > 500 UNION ALL
SELECT case_id, 'SUSTAINED_ATTACK_PROGRESSION' FROM w WHERE hot >= 2 UNION ALL SELECT case_id, 'STABLE_BENIGN' FROM w WHERE NOT (a3 > a1 * 1.5 AND a3 >= 10) AND NOT (k5 > k1 * 2 AND k5 > 500) AND hot < 2""")
def fc27(spark, d):
    return fc.trajectory_findings(traj(spark, d))


@query("fc28_progression_timeline", """
SELECT case_id, horizon, provenance, round(p, 6) AS p, CASE WHEN horizon = 0 THEN 'T0' ELSE 'T+' || horizon END AS label FROM (
 SELECT source_bucket AS case_id, 0 AS horizon, 'OBSERVED' AS provenance, CAST(attack_state AS DOUBLE) AS p FROM cases_v UNION ALL SELECT case_id, horizon, 'FORECAST', p FROM share_pts)""")
def fc28(spark, d):
    c = cases(spark, d).select(col("source_bucket").alias("case_id"), col("attack_state").alias("current"))
    return fc.progression_timeline(c, share_points(spark, d)).withColumn("p", r(col("p")))


@query("fc29_forecast_intelligence_join", """
SELECT h.case_id, h.state, e.early_warning_score FROM hor_v h JOIN ews_v e USING (case_id)""")
def fc29(spark, d):
    pts = traj(spark, d)
    c = conf(spark, d).filter("horizon = 1")
    b = behaviour(spark, d).withColumn("case_id", col("bucket"))
    return fc.forecast_intelligence(fc.attack_horizon(pts), fc.early_warning(pts), c, b).select("case_id", "state", "early_warning_score")


# --- evaluation ---------------------------------------------------------------------------------------------
CONF_AGG = """count(*) AS n, count(*) FILTER (WHERE target = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE target = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE target = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE target = 1 AND p < 0.5) AS fn, avg(pow(p - target, 2)) AS b"""
cte("met_c", f"SELECT model, horizon, {CONF_AGG} FROM pred_v GROUP BY 1, 2")
cte("met_r", """
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS prec, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS rec FROM met_c""")
cte("met_v", """
SELECT *, CASE WHEN prec + rec > 0 THEN round(2 * prec * rec / (prec + rec), 4) WHEN prec + rec = 0 THEN 0.0 END AS f1, round(b, 4) AS brier FROM met_r""")


def metrics(spark, d):
    return ev.confusion(preds(spark, d), ["model", "horizon"])


@query("ev1_confusion_metrics", """
SELECT model, horizon, n, tp, fp, tn, fn, prec AS precision, rec AS recall, f1, round((tp + tn) / n, 4) AS accuracy, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 4) END AS fpr, CASE WHEN fn + tp > 0 THEN round(fn / (fn + tp), 4) END AS fnr, brier FROM met_v""")
def ev1(spark, d):
    return metrics(spark, d).drop("total", "coverage", "undefined_reason")


cte("ece_v", """
SELECT m.model, g.bin, coalesce(x.n, 0) AS n, x.acc, x.conf, abs(x.acc - x.conf) AS err FROM (SELECT DISTINCT model FROM pred_v) m CROSS JOIN (SELECT CAST(unnest(range(10)) AS INT) AS bin) g LEFT JOIN (
 SELECT model, CAST(least(floor(p * 10 + 1e-12), 9) AS INT) AS bin, count(*) AS n, avg(target) AS acc, avg(p) AS conf FROM pred_v GROUP BY 1, 2) x ON x.model = m.model AND x.bin = g.bin""")


@query("ev2_ece_bins", "SELECT model, bin, n, round(acc, 5) AS accuracy, round(conf, 5) AS confidence, round(err, 5) AS error FROM ece_v")
def ev2(spark, d):
    return ev.ece_bins(preds(spark, d), ["model"]).withColumns({n: r(col(n), 5) for n in ("accuracy", "confidence", "error")})


@query("ev2_calibration_error", "SELECT model, round(sum(n * coalesce(err, 0)) / sum(n), 5) AS ece, round(max(err), 5) AS mce, CAST(sum(n) AS BIGINT) AS n FROM ece_v GROUP BY 1")
def ev2_ece(spark, d):
    return ev.calibration_error(ev.ece_bins(preds(spark, d), ["model"]), ["model"]).withColumns({"ece": r(col("ece"), 5), "mce": r(col("mce"), 5)})


@query("ev3_auc", """
WITH rk AS (SELECT horizon, target, p, rank() OVER (PARTITION BY horizon ORDER BY p) + (count(*) OVER (PARTITION BY horizon, p) - 1) / 2.0 AS rk FROM share_pts),
a AS (SELECT horizon, CAST(sum(target) AS BIGINT) AS positives, count(*) - CAST(sum(target) AS BIGINT) AS negatives, (sum(rk) FILTER (WHERE target = 1) - sum(target) * (sum(target) + 1) / 2.0) / (sum(target) * (count(*) - sum(target))) AS auc FROM rk GROUP BY 1),
d AS (SELECT horizon, p, sum(target) AS pos, count(*) AS n FROM share_pts GROUP BY 1, 2),
e AS (SELECT horizon, sum(sum_tp / k * pos) / sum(pos) AS ap FROM (SELECT horizon, pos, sum(pos) OVER w AS sum_tp, sum(n) OVER w AS k FROM d WINDOW w AS (PARTITION BY horizon ORDER BY p DESC)) GROUP BY 1)
SELECT horizon, positives, negatives, round(auc, 5) AS roc_auc, round(ap, 5) AS average_precision FROM a JOIN e USING (horizon)""")
def ev3(spark, d):
    return ev.auc(share_points(spark, d), ["horizon"]).withColumns({"roc_auc": r(col("roc_auc"), 5), "average_precision": r(col("average_precision"), 5)})


@query("ev4_multi_horizon", """
SELECT a.model, a.horizon, a.f1, a.brier, round(a.f1 - b.f1, 4) AS delta_f1, round(a.brier - b.brier, 4) AS delta_brier FROM met_v a LEFT JOIN met_v b ON b.model = 'persistence' AND b.horizon = a.horizon""")
def ev4(spark, d):
    return ev.against_baseline(metrics(spark, d)).select("model", "horizon", "f1", "brier", r(col("delta_f1"), 4).alias("delta_f1"), r(col("delta_brier"), 4).alias("delta_brier"))


@query("ev5_family_holdout", """
WITH p AS (SELECT *, CASE source_bucket % 5 WHEN 0 THEN 'dos' WHEN 1 THEN 'scan' ELSE 'known' END AS g FROM share_pts), m AS (SELECT g, count(*) FILTER (WHERE target = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE target = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE target = 1 AND p < 0.5) AS fn FROM p GROUP BY 1),
q AS (SELECT g, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS a, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS b FROM m), f AS (SELECT g, CASE WHEN a + b > 0 THEN round(2 * a * b / (a + b), 4) WHEN a + b = 0 THEN 0 END AS f1 FROM q)
SELECT g AS held_out_family, f1 AS unseen_f1, (SELECT f1 FROM f WHERE g = 'known') AS known_f1, round(f1 / greatest(1e-4, (SELECT f1 FROM f WHERE g = 'known')), 4) AS f1_retention,
 CASE WHEN f1 IS NULL THEN 'INSUFFICIENT_EVALUATION_DATA' WHEN f1 >= 0.7 THEN 'ROBUST_GENERALIZATION' ELSE 'FAMILY_SPECIFIC_OVERFIT' END AS verdict FROM f WHERE g <> 'known'""")
def ev5(spark, d):
    m = col("source_bucket") % 5
    x = share_points(spark, d).withColumn("family", F.when(m == 0, "dos").when(m == 1, "scan").when(m == 2, "c2").otherwise("other"))
    return ev.family_holdout(x, "family", ["dos", "scan"])


cte("sweep_v", """
SELECT t AS threshold, count(*) FILTER (WHERE target = 1 AND p >= t) AS tp, count(*) FILTER (WHERE target = 0 AND p >= t) AS fp, count(*) FILTER (WHERE target = 1 AND p < t) AS fn, count(*) FILTER (WHERE target = 0 AND p < t) AS tn
FROM share_pts, (SELECT CAST(unnest([0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]) AS DOUBLE) AS t) GROUP BY 1""")


@query("ev6_threshold_sweep", "SELECT *, round(2 * tp / (2 * tp + fp + fn), 5) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 5) AS balanced_accuracy FROM sweep_v")
def ev6(spark, d):
    return ev.threshold_sweep(share_points(spark, d)).withColumns({"f1": r(col("f1"), 5), "balanced_accuracy": r(col("balanced_accuracy"), 5)})


@query("ev6_best_threshold", "SELECT threshold, round(2 * tp / (2 * tp + fp + fn), 5) AS f1 FROM sweep_v ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, tp / (tp + fn) + tn / (tn + fp) DESC, threshold LIMIT 1")
def ev6_best(spark, d):
    return ev.best_threshold(ev.threshold_sweep(share_points(spark, d))).withColumn("f1", r(col("f1"), 5))


@query("ev7_selective_classification", """
WITH x AS (SELECT *, abs(p - 0.5) >= 0.05 AS k FROM share_pts), g AS (SELECT horizon, count(*) AS total, count(*) FILTER (WHERE NOT k) AS abstained,
 2 * count(*) FILTER (WHERE target = 1 AND p >= 0.5) / nullif(2 * count(*) FILTER (WHERE target = 1 AND p >= 0.5) + count(*) FILTER (WHERE target = 0 AND p >= 0.5) + count(*) FILTER (WHERE target = 1 AND p < 0.5), 0) AS a,
 2 * count(*) FILTER (WHERE k AND target = 1 AND p >= 0.5) / nullif(2 * count(*) FILTER (WHERE k AND target = 1 AND p >= 0.5) + count(*) FILTER (WHERE k AND target = 0 AND p >= 0.5) + count(*) FILTER (WHERE k AND target = 1 AND p < 0.5), 0) AS b FROM x GROUP BY 1)
SELECT horizon, total, abstained, round(coalesce(a, 0), 5) AS raw_f1, round(coalesce(b, 0), 5) AS selective_f1, round(1 - abstained / total, 5) AS coverage, round(coalesce(b, 0) - coalesce(a, 0), 5) AS f1_improvement FROM g""")
def ev7(spark, d):
    return ev.selective(share_points(spark, d), ["horizon"]).withColumns({n: r(col(n), 5) for n in ("raw_f1", "selective_f1", "coverage", "f1_improvement")})


@query("ev8_lead_time", """
WITH o AS (SELECT CAST(episode_id AS BIGINT) AS episode_id, bucket AS onset FROM (SELECT *, lag(attack_state) OVER (PARTITION BY episode_id ORDER BY bucket) AS p FROM epq_v) WHERE p = 0 AND attack_state = 1),
a AS (SELECT CAST(episode_id AS BIGINT) AS episode_id, bucket FROM epq_v WHERE share >= 0.25)
SELECT o.episode_id, onset, min(a.bucket) AS first_alert, coalesce(bool_or(a.bucket = onset), false) AS onset_recalled, coalesce(onset - min(a.bucket), 0) AS lead_steps FROM o LEFT JOIN a ON a.episode_id = o.episode_id AND a.bucket BETWEEN onset - 2 AND onset GROUP BY 1, 2""")
def ev8(spark, d):
    e = eps(spark, d)
    return ev.lead_time(e.filter("share >= 0.25"), fc.onset_events(e).filter("event = 'ONSET'"))


# Newton steps for the two parameters; single-class training is refused
@query("ev9_platt", """
WITH RECURSIVE one AS (SELECT source_bucket, target, p, ln(greatest(p, 1e-6) / greatest(1.0::DOUBLE - p, 1e-6)) AS l, (SELECT (min(source_bucket) + max(source_bucket)) / 2 FROM share_pts WHERE horizon = 1) AS cut
 FROM share_pts WHERE horizon = 1),
cls AS (SELECT count(*) AS n, sum(target) AS pos FROM one WHERE source_bucket < cut AND p IS NOT NULL),
fit AS (SELECT l, target AS y, CASE WHEN target = 1 THEN 0.5::DOUBLE / pos ELSE 0.5::DOUBLE / (n - pos) END AS w FROM one, cls WHERE source_bucket < cut AND p IS NOT NULL AND pos > 0 AND pos < n),
st AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
 SELECT i + 1, a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
  SELECT i, a, b, sum(w * (q - y)) AS g0, sum(w * (q - y) * l) AS g1, sum(w * q * (1 - q)) AS h0, sum(w * q * (1 - q) * l) AS h1, sum(w * q * (1 - q) * l * l) AS h2
  FROM (SELECT st.i, st.a, st.b, l, y, w, 1 / (1 + exp(-(st.a + st.b * l))) AS q FROM st, fit WHERE st.i < 30) GROUP BY i, a, b))
SELECT source_bucket, target, CASE WHEN pos > 0 AND pos < n AND p IS NOT NULL THEN round(1 / (1 + exp(-(a + b * l))), 4) END AS p_calibrated,
 CASE WHEN NOT (pos > 0 AND pos < n) THEN 'CALIBRATION_UNSUPPORTED' WHEN p IS NULL THEN 'NO_PROBABILITY' ELSE 'CALIBRATED' END AS calibration_status
FROM one, cls, (SELECT a, b FROM st ORDER BY i DESC LIMIT 1) WHERE source_bucket >= cut""")
def ev9(spark, d):
    x = share_points(spark, d).filter("horizon = 1")
    cut = x.agg(((F.min("source_bucket") + F.max("source_bucket")) / 2).alias("c")).scalar()
    return ev.platt(x.filter(col("source_bucket") < cut), x.filter(col("source_bucket") >= cut)).select(
        "source_bucket", "target", r(col("p_calibrated"), 4).alias("p_calibrated"), "calibration_status")


# complete vectors in long form, and the moments of the training labels
cte("emb_v", """
SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) AS INT) AS i FROM embeddings
WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding) AND len(embedding) = (SELECT max(len(embedding)) FROM embeddings WHERE label < 5)""")
cte("emb_mean", "SELECT i, avg(v) AS m, var_samp(v) AS s2 FROM emb_v WHERE label < 5 GROUP BY i")


@query("ev10_diag_mahalanobis", """
WITH z AS (SELECT vec_id, sqrt(avg(pow(v - m, 2) / greatest(s2, 1e-4))) AS d FROM emb_v JOIN emb_mean USING (i) GROUP BY vec_id)
SELECT vec_id, round(d, 5) AS ood_score, d > 3.5 AS is_ood FROM embeddings LEFT JOIN z USING (vec_id)""")
def ev10(spark, d):
    x = base.views.table(spark, d, "embeddings")
    return solvers.vector_diag_mahalanobis(x, "embedding", col("label") < 5).select("vec_id", r(col("ood_score"), 5).alias("ood_score"), "is_ood")


# the inverse of the covariance by Gauss-Jordan steps, one row of the matrix as pivot in each
@query("ev11_full_mahalanobis", """
WITH RECURSIVE dev AS (SELECT vec_id, label, i, v - m AS x FROM emb_v JOIN emb_mean USING (i)),
cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) + CASE WHEN a.i = b.i THEN 1e-3 ELSE 0 END AS c FROM dev a JOIN dev b USING (vec_id) WHERE a.label < 5 GROUP BY 1, 2),
wide AS (SELECT i, list_concat(list(c ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j)) AS l FROM cov GROUP BY i),
gauss AS (SELECT 0 AS k, list(l ORDER BY i) AS a, len(any_value(l)) // 2 AS n FROM wide UNION ALL
 SELECT k + 1, list_transform(a, lambda l, i: CASE WHEN i = k + 1 THEN list_transform(l, lambda e: e / l[k + 1])
  ELSE list_transform(l, lambda e, j: e - l[k + 1] / a[k + 1][k + 1] * a[k + 1][j]) END), n FROM gauss WHERE k < n),
inv AS (SELECT i, j, a[i][n + j] AS c FROM gauss, range(1, n + 1) AS p(i), range(1, n + 1) AS q(j) WHERE k = n),
dist AS (SELECT a.vec_id, any_value(a.label) AS label, sqrt(sum(a.x * c * b.x)) AS d FROM dev a JOIN inv ON inv.i = a.i JOIN dev b ON b.vec_id = a.vec_id AND b.i = inv.j GROUP BY 1),
lim AS (SELECT quantile_cont(d, 0.95) AS p95, quantile_cont(d, 0.99) AS p99 FROM dist WHERE label < 5)
SELECT vec_id, round(d, 4) AS distance, round(least(1.0::DOUBLE, d / p99), 4) AS epistemic, CASE WHEN d > p99 THEN 'OUT' WHEN d > p95 THEN 'BORDER' WHEN d IS NOT NULL THEN 'IN' END AS ood_level
FROM embeddings LEFT JOIN dist USING (vec_id), lim""")
def ev11(spark, d):
    x = base.views.table(spark, d, "embeddings")
    return solvers.vector_full_mahalanobis(x, "embedding", col("label") < 5).select("vec_id", r(col("distance"), 4).alias("distance"), r(col("epistemic"), 4).alias("epistemic"), "ood_level")


@query("ev12_model_rank", """
SELECT model, round(avg(f1), 5) AS mean_f1, round(min(f1), 5) AS min_f1, 1.0::DOUBLE AS coverage, count(f1) = count(*) AS complete, CAST(row_number() OVER (ORDER BY count(f1) = count(*) DESC, avg(f1) DESC NULLS LAST, min(f1) DESC NULLS LAST, model) AS INT) AS rank FROM met_v GROUP BY 1""")
def ev12(spark, d):
    return ev.model_rank(metrics(spark, d)).withColumns({"mean_f1": r(col("mean_f1"), 5), "min_f1": r(col("min_f1"), 5)})


@query("ev13_mixed_episode_report", """
SELECT CAST(episode_id AS BIGINT) AS episode_id, count(*) AS windows, count(*) FILTER (WHERE p = 0 AND a = 0) AS n00, count(*) FILTER (WHERE p = 0 AND a = 1) AS n01, count(*) FILTER (WHERE p = 1 AND a = 0) AS n10, count(*) FILTER (WHERE p = 1 AND a = 1) AS n11, count(DISTINCT a) > 1 AS mixed FROM (
 SELECT episode_id, attack_state AS a, lag(attack_state) OVER (PARTITION BY episode_id ORDER BY bucket) AS p FROM epq_v) GROUP BY 1""")
def ev13(spark, d):
    return ev.episode_report(eps(spark, d))


@query("ev14_static_detection")
def ev14(spark, d):
    f = base.flows(spark, d).withColumns({"day": F.floor(col("start_ts") / 86400), "dur": col("end_ts") - col("start_ts"), "target": (col("state") == "REJECTED").cast("int")})
    cols = ["dur", "fwd_bytes", "rev_bytes", "fwd_packets", "rev_packets", "dst_port"]
    f = shared(f.select("day", "target", *cols))  # read again by each step of the fit
    cut = f.agg(((F.min("day") + F.max("day")) / 2).alias("c")).scalar()
    m = ev.fit_logistic(f.filter(col("day") < cut), cols, "target")
    return ev.confusion(ev.score(m, f.filter(col("day") >= cut)))


@query("ev15_candidate_search")
def ev15(spark, d):
    tr, te = train_test(spark, d)
    return ev.candidate_search(tr, te, {"flattened": FLAT, "last_step": ["h7", "share"], "temporal_only": FLAT[:8]})


@query("ev16_state_error", """
WITH s AS (SELECT greatest(stddev_pop(share), 1e-9) AS sd FROM epq_v), x AS (""" + " UNION ALL ".join(
    f"SELECT {k} AS horizon, (lead(share, {k}) OVER (PARTITION BY episode_id ORDER BY bucket) - share) / sd AS e FROM epq_v, s" for k in fc.HORIZONS) + """)
SELECT 'share' AS feature, horizon, count(*) AS n, round(avg(e * e), 5) AS mse, round(avg(abs(e)), 5) AS mae FROM x WHERE e IS NOT NULL GROUP BY 2""")
def ev16(spark, d):
    return ev.state_error(eps(spark, d), ["share"]).withColumns({"mse": r(col("mse"), 5), "mae": r(col("mae"), 5)})


@query("ev17_hybrid_blend", """
WITH x AS (SELECT CAST(al AS DOUBLE) AS alpha, target, al * current + (1 - al) * p AS p FROM share_pts, (SELECT CAST(unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS al)), m AS (SELECT alpha, """ + CONF_AGG + """ FROM x GROUP BY 1),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS pr, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) END AS re FROM m)
SELECT alpha, n, CASE WHEN pr + re > 0 THEN round(2 * pr * re / (pr + re), 4) WHEN pr + re = 0 THEN 0.0 END AS f1, round(b, 4) AS brier FROM q""")
def ev17(spark, d):
    return ev.hybrid_blend(share_points(spark, d))


@query("ev18_rolling_origin", """
WITH s AS (SELECT min(bucket) AS a, (max(bucket) - min(bucket) + 1) / 6.0::DOUBLE AS w FROM labels_q), f AS (SELECT CAST(unnest(range(1, 6)) AS INT) AS fold)
SELECT fold, count(*) FILTER (WHERE bucket < a + fold * w) AS train_rows, count(*) FILTER (WHERE bucket < a + fold * w AND attack_state = 1) AS train_attacks,
 count(*) FILTER (WHERE bucket >= a + fold * w AND bucket < a + (fold + 1) * w) AS test_rows, count(*) FILTER (WHERE bucket >= a + fold * w AND bucket < a + (fold + 1) * w AND attack_state = 1) AS test_attacks FROM labels_q, s, f GROUP BY 1""")
def ev18(spark, d):
    return ev.rolling_origin(base.views.labels(spark, d, EP))


# --- artifacts -----------------------------------------------------------------------------------------------
@query("snk3_experiment_summary", """
WITH e AS (SELECT model, sum(n * coalesce(err, 0)) / sum(n) AS ece FROM ece_v GROUP BY 1)
SELECT model, count(*) AS horizons, round(avg(brier), 5) AS mean_brier, round(avg(f1), 5) AS mean_f1, round(max(ece), 4) AS mean_ece FROM met_v JOIN e USING (model) GROUP BY 1""")
def snk3(spark, d):
    e = ev.calibration_error(ev.ece_bins(preds(spark, d), ["model"]), ["model"]).select("model", "ece")
    return store.experiment_summary(metrics(spark, d).join(e, "model")).withColumns({"mean_brier": r(col("mean_brier"), 5), "mean_f1": r(col("mean_f1"), 5), "mean_ece": r(col("mean_ece"), 4)})


@query("snk4_split_manifest", """
WITH x AS (SELECT s.split, CAST(e.episode_id AS BIGINT) AS ep, e.attack_state, coalesce(lag(e.attack_state) OVER (PARTITION BY episode_id ORDER BY e.bucket) = 0 AND e.attack_state = 1, false) AS onset FROM epq_v e JOIN split_v s USING (bucket))
SELECT split, (SELECT string_agg(CAST(ep AS VARCHAR), ',' ORDER BY ep) FROM (SELECT DISTINCT ep FROM x y WHERE y.split = x.split)) AS episode_ids, count(*) AS windows, count(*) FILTER (WHERE attack_state = 1) AS attack_windows,
 count(*) FILTER (WHERE attack_state = 0) AS benign_windows, count(*) FILTER (WHERE onset) AS events FROM x GROUP BY split""")
def snk4(spark, d):
    from pyspark.sql import Window
    e = eps(spark, d)
    w = Window.partitionBy("episode_id").orderBy("bucket")
    x = e.withColumn("is_onset", F.coalesce((F.lag("attack_state").over(w) == 0) & (col("attack_state") == 1), F.lit(False)))
    return store.split_manifest(x.join(split(spark, d).select("bucket", "split"), "bucket"))


@query("ent24_state_estimate", """
SELECT bucket, round(0.6 + share / 4, 6) AS scanning, round(share / 4, 6) AS c2_beacon, 3 AS features FROM labels_h JOIN win_stats USING (bucket)""")
def ent24(spark, d):
    s = win.base_stats(win.with_bucket(base.packets_marked(spark, d), W), with_iat=False).withColumn("absent", F.lit(None).cast("double"))
    dist = base.views.labels(spark, d, W).select("bucket", F.create_map(F.lit("RECONNAISSANCE"), 0.6 + col("share") / 4, F.lit("COMMAND_AND_CONTROL"), col("share") / 4).alias("stage_distribution"))
    e = en.state_estimate(s, ["packet_count", "syn_count", "ttl_mean", "absent"], dist)
    return e.select("bucket", r(col("scanning")).alias("scanning"), r(col("c2_beacon")).alias("c2_beacon"), F.size("network_features").alias("features"))


