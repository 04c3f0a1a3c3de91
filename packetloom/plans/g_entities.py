"""Entity, pattern and campaign queries: ENT*, PAT1-PAT6, PAT12."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from packetloom.functions.columns import r
from packetloom.operators import behavior as bh, entities as en, patterns as pt
from packetloom.plans import base
from packetloom.plans.e_behavior import MONTH
from packetloom.plans.registry import cte, query
from packetloom.session import stored

GAP = 2  # windows without a finding that end an episode


class Tables:
    """The entity tables of one query, built once per plan."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    @cached_property
    def flows(self):
        """Flows with their window, joined and laid out once: every table below starts here."""
        return stored(en.with_window(base.flows(self.spark, self.d), MONTH), ["src_ip", "bucket"])

    @cached_property
    def sessions(self):
        return self.flows

    @cached_property
    def ends(self):
        return en.endpoint_rows(self.flows, MONTH)

    @cached_property
    def sent(self):
        """Totals of sources by window."""
        return stored(en.window_totals(self.ends, True))

    @cached_property
    def totals(self):
        return self.sent.unionByName(stored(en.window_totals(self.ends, False)))

    @cached_property
    def ew(self):
        return stored(bh.entity_windows(self.flows, MONTH, self.sent))

    @cached_property
    def findings(self):
        """Findings per (source, window) by fixed rules on its window totals."""
        kinds = (("port_scan", "high", F.col("failed_sessions") >= 5), ("dos_flood", "critical", F.col("packets") >= 500),
                 ("exploit_attempt", "medium", F.col("peers") >= 11))
        arr = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(n).alias("attack_category"), F.lit(s).alias("severity")))
                                        for n, s, cond in kinds]))
        f = self.ew.select("entity", "bucket", F.explode(arr).alias("_x")).select("entity", "bucket", "_x.*")
        return stored(f.withColumn("finding_id", F.concat_ws("-", F.lit("f"), "entity", "bucket", "attack_category")))

    @cached_property
    def beacons(self):
        b = bh.beaconing(self.flows)
        return stored(b.withColumn("is_beaconing", F.col("is_beaconing") & (F.col("score") >= 0.75)))

    @cached_property
    def changes(self):
        return stored(bh.change_detection(self.ew))

    @cached_property
    def deviations(self):
        return stored(bh.entity_deviations(bh.entity_baseline(self.ew)))

    @cached_property
    def history(self):
        return en.entity_history(self.ends, self.findings, self.totals)

    @cached_property
    def profile(self):
        return stored(en.entity_profile(self.ends, self.findings, self.beacons, self.totals))

    @cached_property
    def states(self):
        return stored(en.kinematic_states(self.ends, self.findings, self.changes, self.beacons, self.totals))

    @cached_property
    def transitions(self):
        return en.kinematic_transitions(self.states)

    @cached_property
    def trajectory(self):
        return en.kinematic_trajectory(self.states, self.transitions)

    @cached_property
    def episodes(self):
        return stored(en.episodes(self.findings, self.ends, GAP, MONTH, self.totals))

    @cached_property
    def campaigns(self):
        return stored(pt.campaigns(self.episodes, en.episode_targets(self.episodes, self.ends, self.totals), 3, MONTH))

    @cached_property
    def members(self):
        return pt.campaign_members(self.campaigns, self.ends, self.totals)

    @cached_property
    def patterns(self):
        return pt.entity_patterns(self.sessions, self.findings, ["bucket"])

    @cached_property
    def facts(self):
        return stored(en.entity_facts(self.profile, self.trajectory, self.changes, self.deviations, self.campaigns, self.ew))

    @cached_property
    def scored(self):
        return en.risk_score(self.facts)


def register(name, sql=None):
    def add(fn):
        query(name, sql)(lambda spark, d: fn(Tables(spark, d)))
        return fn
    return add


# --- SQL side ---------------------------------------------------------------------------------------
cte("fe_v", """
SELECT entity, bucket, 'port_scan' AS attack_category, 'high' AS severity FROM ew_v WHERE failed_sessions >= 5 UNION ALL
SELECT entity, bucket, 'dos_flood', 'critical' FROM ew_v WHERE packets >= 500 UNION ALL
SELECT entity, bucket, 'exploit_attempt', 'medium' FROM ew_v WHERE peers >= 11""")
cte("be_v", "SELECT src_ip, dst_ip, dst_port, protocol, cv, score FROM beacon_v WHERE is_beaconing AND score >= 0.75")
cte("ends_v", """
SELECT src_ip AS entity, dst_ip AS peer, true AS o, bucket, dst_port, protocol, state, fwd_packets + rev_packets AS p, fwd_bytes + rev_bytes AS b, start_ts, end_ts FROM mf_v UNION ALL
SELECT dst_ip, src_ip, false, bucket, dst_port, protocol, state, fwd_packets + rev_packets, fwd_bytes + rev_bytes, start_ts, end_ts FROM mf_v""")
cte("hist_v", """
SELECT coalesce(h.entity, f.entity) AS entity, least(a, fa) AS first_seen_window, greatest(z, fz) AS last_seen_window, coalesce(active_windows, 0) AS active_windows,
 coalesce(activity_count, 0) AS activity_count, coalesce(unique_peers, 0) AS unique_peers, coalesce(unique_ports, 0) AS unique_ports, coalesce(total_packets, 0) AS total_packets,
 coalesce(total_bytes, 0) AS total_bytes, coalesce(findings_count, 0) AS findings_count, coalesce(observed_states, '') AS observed_states FROM (
 SELECT entity, min(bucket) AS a, max(bucket) AS z, count(DISTINCT bucket) AS active_windows, count(*) AS activity_count, count(DISTINCT peer) AS unique_peers, count(DISTINCT dst_port) AS unique_ports,
  CAST(sum(p) AS BIGINT) AS total_packets, CAST(sum(b) AS BIGINT) AS total_bytes, string_agg(DISTINCT state, ',' ORDER BY state) AS observed_states FROM ends_v GROUP BY 1) h
FULL JOIN (SELECT entity, count(*) AS findings_count, min(bucket) AS fa, max(bucket) AS fz FROM fe_v GROUP BY 1) f ON h.entity = f.entity""")
cte("prof_b", """
SELECT g.*, b.score AS beacon_score, b.mincv, b.maxcv, b.score IS NOT NULL AS beaconing_detected, coalesce(f.n, 0) AS findings_count, coalesce(f.sc, false) AS fsc, coalesce(f.ds, false) AS volume_anomalies_detected,
 (failed_sessions + reset_sessions) / greatest(1, connection_attempts) AS failure_ratio FROM (
 SELECT entity, count(*) FILTER (WHERE o) AS connection_attempts, count(*) FILTER (WHERE NOT o) AS inbound_sessions, count(DISTINCT peer) AS peer_count, count(DISTINCT dst_port) FILTER (WHERE o) AS targeted_ports_count,
  CAST(sum(p) AS BIGINT) AS packet_volume, CAST(sum(b) AS BIGINT) AS byte_volume, count(*) FILTER (WHERE o AND state IN ('ESTABLISHED', 'CLOSED')) AS successful_sessions,
  count(*) FILTER (WHERE o AND state IN ('REJECTED', 'ATTEMPTED')) AS failed_sessions, count(*) FILTER (WHERE o AND state = 'RESET') AS reset_sessions, min(bucket) AS first_seen_window, max(bucket) AS last_seen_window,
  count(DISTINCT bucket) AS active_windows_count, min(start_ts) AS first_ts, max(end_ts) AS last_ts FROM ends_v GROUP BY 1) g
LEFT JOIN (SELECT src_ip AS entity, max(score) AS score, min(cv) AS mincv, max(cv) AS maxcv FROM be_v GROUP BY 1) b USING (entity)
LEFT JOIN (SELECT entity, count(*) AS n, bool_or(attack_category LIKE '%scan%') AS sc, bool_or(attack_category LIKE '%dos%') AS ds FROM fe_v GROUP BY 1) f USING (entity)""")
cte("prof_e", """
SELECT *, fsc OR contains(roles, 'SCANNER') AS scan_detected, concat_ws(',', CASE WHEN fsc OR contains(roles, 'SCANNER') THEN 'T1046' END, CASE WHEN beaconing_detected THEN 'T1071' END, CASE WHEN volume_anomalies_detected THEN 'T1498' END) AS mitre_techniques FROM (
 SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN targeted_ports_count >= 10 OR (connection_attempts >= 10 AND targeted_ports_count / greatest(1, connection_attempts) > 0.6) THEN 'SCANNER' END,
  CASE WHEN peer_count >= 5 AND connection_attempts >= 10 THEN 'FANOUT_SOURCE' END, CASE WHEN inbound_sessions > 3 * greatest(1, connection_attempts) THEN 'SERVER' END,
  CASE WHEN inbound_sessions > 3 * greatest(1, connection_attempts) AND peer_count >= 5 THEN 'FANIN_TARGET' END,
  CASE WHEN NOT inbound_sessions > 3 * greatest(1, connection_attempts) AND connection_attempts > 2 * greatest(1, inbound_sessions) THEN 'CLIENT' END,
  CASE WHEN beaconing_detected THEN 'BEACON' END, CASE WHEN beaconing_detected THEN 'PERIODIC_COMMUNICATOR' END,
  CASE WHEN reset_sessions >= 5 OR (connection_attempts >= 5 AND failure_ratio >= 0.7) THEN 'RESET_HEAVY' END,
  CASE WHEN (packet_volume > 5000 OR byte_volume > 1000000) AND connection_attempts >= inbound_sessions THEN 'HIGH_VOLUME_SOURCE' END,
  CASE WHEN (packet_volume > 5000 OR byte_volume > 1000000) AND connection_attempts < inbound_sessions THEN 'HIGH_VOLUME_TARGET' END,
  CASE WHEN active_windows_count <= 1 AND connection_attempts <= 2 THEN 'QUIET_ENTITY' END,
  CASE WHEN active_windows_count = 1 AND connection_attempts >= 10 THEN 'EMERGING_ENTITY' END, CASE WHEN active_windows_count = 1 AND connection_attempts >= 10 THEN 'BURSTY_SOURCE' END), ''), 'CLIENT') AS roles FROM prof_b)""")
cte("kin_v", """
SELECT coalesce(s.entity, f.entity, c.entity) AS entity, coalesce(s.bucket, f.bucket, c.bucket) AS bucket,
 CASE WHEN coalesce(dos, false) THEN 'IMPACT' WHEN bs IS NOT NULL THEN 'COMMAND_AND_CONTROL' WHEN coalesce(ex, false) THEN 'EXPLOITATION_INDICATOR' WHEN coalesce(sc, false) OR coalesce(surge, false) THEN 'RECONNAISSANCE'
  WHEN coalesce(n, 0) >= 5 AND coalesce(failed, 0) >= 3 THEN 'DISCOVERY' ELSE 'BENIGN' END AS state,
 CASE WHEN coalesce(dos, false) THEN 0.9 WHEN bs IS NOT NULL THEN greatest(0.7, bs) WHEN coalesce(ex, false) THEN 0.85 WHEN coalesce(sc, false) AND coalesce(surge, false) THEN 0.85
  WHEN coalesce(sc, false) OR coalesce(surge, false) THEN 0.7 WHEN coalesce(n, 0) >= 5 AND coalesce(failed, 0) >= 3 THEN 0.6 WHEN coalesce(n, 0) > 0 THEN 0.9 ELSE 0.5 END AS strength
FROM (SELECT entity, bucket, count(*) AS n, count(*) FILTER (WHERE state IN ('REJECTED', 'RESET')) AS failed FROM ends_v GROUP BY 1, 2) s
FULL JOIN (SELECT entity, bucket, bool_or(attack_category = 'dos_flood') AS dos, bool_or(attack_category = 'exploit_attempt') AS ex, bool_or(attack_category = 'port_scan') AS sc FROM fe_v GROUP BY 1, 2) f ON s.entity = f.entity AND s.bucket = f.bucket
FULL JOIN (SELECT entity, bucket, true AS surge FROM chg_v WHERE change_type = 'PORT_FANOUT_SURGE' GROUP BY 1, 2) c ON c.entity = s.entity AND c.bucket = s.bucket
LEFT JOIN (SELECT src_ip, max(score) AS bs FROM be_v GROUP BY 1) b ON b.src_ip = coalesce(s.entity, f.entity, c.entity)""")
STEP_SQL = " OR ".join(f"(from_state = '{a}' AND to_state IN ({', '.join(repr(x) for x in bs)}))" for a, bs in en.ALLOWED_STEPS.items())
cte("kt_v", f"""
SELECT *, CASE WHEN from_state = to_state OR {STEP_SQL} THEN 'SUPPORTED_TRANSITION' ELSE 'UNSUPPORTED_TRANSITION' END AS transition_type FROM (
 SELECT entity, lag(state) OVER w AS from_state, state AS to_state, lag(bucket) OVER w AS window_before, bucket AS window_after, strength FROM kin_v WINDOW w AS (PARTITION BY entity ORDER BY bucket)) WHERE from_state IS NOT NULL""")
RANK_SQL = "CASE state " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in en.STATE_RANK.items()) + " END"
cte("traj_v", f"""
SELECT s.*, coalesce(total_transitions, 0) AS total_transitions, coalesce(unsupported, 0) AS unsupported_transition_count FROM (
 SELECT entity, arg_max(state, bucket) AS current_state, arg_max(state, {RANK_SQL} * 100000 - bucket) AS peak_state, count(*) AS trajectory_length, min(bucket) AS first_window, max(bucket) AS last_window FROM kin_v GROUP BY 1) s
LEFT JOIN (SELECT entity, count(*) AS total_transitions, count(*) FILTER (WHERE transition_type LIKE 'UNS%') AS unsupported FROM kt_v GROUP BY 1) t USING (entity)""")
cte("ep_days", f"""
SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY bucket) AS ep FROM (
 SELECT entity, bucket, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY entity ORDER BY bucket) > {GAP} THEN 1 ELSE 0 END AS nw FROM (SELECT DISTINCT entity, bucket FROM fe_v))""")
cte("epi_v", f"""
SELECT 'ep_' || (sha256(entity || ':' || start_window || ':' || end_window || ':' || finding_count)) AS episode_id, * FROM (
 SELECT entity, ep, min(bucket) AS start_window, max(bucket) AS end_window, count(*) AS finding_count, string_agg(DISTINCT attack_category, ',' ORDER BY attack_category) AS categories,
  CASE WHEN bool_or(severity IN ('high', 'critical')) THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN bool_or(attack_category = 'dos_flood') THEN 'DENIAL_OF_SERVICE' WHEN bool_or(attack_category = 'port_scan') THEN 'RECONNAISSANCE' ELSE 'BENIGN_OBSERVATION' END AS attack_state,
  concat_ws(',', CASE WHEN bool_or(attack_category = 'port_scan') THEN 'T1046' END, CASE WHEN bool_or(attack_category = 'dos_flood') THEN 'T1498' END) AS mitre_techniques
 FROM fe_v JOIN ep_days USING (entity, bucket) GROUP BY 1, 2)""")
cte("epi_x", """
SELECT v.*, session_count, ports, coalesce(len(targets), 0) AS n_targets, coalesce(targets, []) AS targets, coalesce(ports, []) AS port_list FROM epi_v v LEFT JOIN (
 SELECT v.entity, v.ep, list(DISTINCT e.dst_port) FILTER (e.dst_port IS NOT NULL) AS ports, list(DISTINCT e.peer) FILTER (e.o) AS targets, count(*) AS session_count
 FROM epi_v v JOIN ends_v e ON e.entity = v.entity AND e.bucket BETWEEN v.start_window AND v.end_window GROUP BY 1, 2) x USING (entity, ep)""")
cte("camp_v", f"""
SELECT 'cmp_' || (sha256(entity || ':' || start_window || ':' || end_window || ':' || episode_count)) AS campaign_id, *, (end_window - start_window + 1) * {float(MONTH)}::DOUBLE AS duration_seconds FROM (
 SELECT entity, island, min(start_window) AS start_window, max(end_window) AS end_window, count(*) AS episode_count, string_agg(DISTINCT attack_state, ',' ORDER BY attack_state) AS attack_states,
  coalesce(string_agg(DISTINCT nullif(mitre_techniques, ''), ',' ORDER BY nullif(mitre_techniques, '')), '') AS mitre_techniques, CASE WHEN bool_or(severity = 'HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM (
  SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY start_window) AS island FROM (
   SELECT *, CASE WHEN start_window - pe <= 3 AND (list_has_any(targets, pt) OR (n_targets = 0 AND len(pt) = 0) OR list_has_any(port_list, pp) OR (len(port_list) = 0 AND len(pp) = 0)) THEN 0 ELSE 1 END AS nw FROM (
    SELECT *, lag(end_window) OVER w AS pe, lag(targets) OVER w AS pt, lag(port_list) OVER w AS pp FROM epi_x WINDOW w AS (PARTITION BY entity ORDER BY start_window)))) GROUP BY 1, 2)""")
cte("devi_v", """
SELECT entity, evaluation_window AS bucket, m AS metric_name, z AS z_score FROM (
 SELECT entity, evaluation_window, window_count, 'ports' AS m, ports_z AS z, 2.5 AS lim FROM bl_z UNION ALL SELECT entity, evaluation_window, window_count, 'peers', peers_z, 2.5 FROM bl_z UNION ALL
 SELECT entity, evaluation_window, window_count, 'packets', packets_z, 3.0 FROM bl_z) WHERE z >= lim AND window_count >= 3""")
cte("facts_b", """
SELECT p.*, coalesce(current_state, 'BENIGN') AS current_state, coalesce(peak_state, 'BENIGN') AS peak_state, coalesce(trajectory_length, 0) AS trajectory_length, coalesce(total_transitions, 0) AS total_transitions,
 coalesce(unsupported_transition_count, 0) AS unsupported_transition_count, coalesce(ps, 0) AS port_surges, coalesce(cs, 0) AS connection_surges, coalesce(cc, 0) AS change_count,
 coalesce(dc, 0) AS deviation_count, campaign_id, coalesce(kc, 0) AS campaign_count, (SELECT count(DISTINCT bucket) FROM ew_v) AS window_count
FROM prof_e p LEFT JOIN traj_v USING (entity)
LEFT JOIN (SELECT entity, count(*) FILTER (WHERE change_type LIKE 'PORT%') AS ps, count(*) FILTER (WHERE change_type LIKE 'CONN%') AS cs, count(*) AS cc FROM chg_v GROUP BY 1) USING (entity)
LEFT JOIN (SELECT entity, count(*) AS dc FROM devi_v GROUP BY 1) USING (entity)
LEFT JOIN (SELECT entity, arg_min(campaign_id, start_window) AS campaign_id, count(*) AS kc FROM camp_v GROUP BY 1) USING (entity)""")
CONTRA_SQL = {
    "CLEAN_SESSIONS": "successful_sessions >= 15 AND failure_ratio <= 0.05", "NARROW_SCANNER": "contains(roles, 'SCANNER') AND targeted_ports_count < 5 AND peer_count < 3",
    "IRREGULAR_BEACON": "coalesce(contains(roles, 'BEACON') AND maxcv > 0.4, false)", "INSUFFICIENT_HISTORY_FORECAST": "window_count < 8",
    "UNSUPPORTED_TRANSITIONS": "unsupported_transition_count > 0"}
cte("facts_v", "SELECT *, " + " + ".join(f"CAST({v} AS INT)" for v in CONTRA_SQL.values()) + " AS contradiction_count FROM facts_b")
cte("score_v", """
SELECT *, CASE WHEN score >= 100 THEN 'P1_CRITICAL' WHEN score >= 70 THEN 'P2_HIGH' WHEN score >= 40 THEN 'P3_MEDIUM' WHEN score >= 20 THEN 'P4_LOW' ELSE 'P5_INFORMATIONAL' END AS priority_level FROM (
 SELECT *, CAST(CASE WHEN current_state = 'IMPACT' THEN 100 WHEN current_state = 'COMMAND_AND_CONTROL' THEN 90 WHEN current_state = 'EXPLOITATION_INDICATOR' THEN 80 WHEN current_state = 'RECONNAISSANCE' THEN 60 WHEN current_state = 'DISCOVERY' THEN 40
  WHEN contains(roles, 'SCANNER') THEN 45 WHEN contains(roles, 'BEACON') THEN 50 WHEN contains(roles, 'RESET_HEAVY') THEN 30 ELSE 0 END + 25 * port_surges + 20 * connection_surges
  + CASE WHEN peer_count >= 10 THEN 20 ELSE 0 END + CASE WHEN targeted_ports_count >= 20 THEN 20 ELSE 0 END + CASE WHEN campaign_count > 0 THEN 15 ELSE 0 END
  - CASE WHEN successful_sessions > 15 AND failure_ratio < 0.1 AND current_state NOT IN ('IMPACT', 'COMMAND_AND_CONTROL') THEN 30 ELSE 0 END AS BIGINT) AS score FROM facts_v)""")
cte("pat_v", """
SELECT src_ip AS entity, 'HORIZONTAL_SCAN' AS pattern_type, bucket AS start_window, bucket AS end_window, 'HIGH' AS severity FROM (
 SELECT bucket, src_ip, count(*) AS n, avg(p) AS a FROM (SELECT bucket, src_ip, dst_ip, count(DISTINCT dst_port) AS p FROM mf_v GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE n >= 5 AND a <= 4 UNION ALL
SELECT dst_ip, 'DISTRIBUTED_SCAN', bucket, bucket, 'HIGH' FROM (SELECT bucket, dst_ip, count(DISTINCT src_ip) AS n FROM mf_v GROUP BY 1, 2) WHERE n >= 5 UNION ALL
SELECT entity, 'VOLUME_AMPLIFICATION', bucket, bucket, 'CRITICAL' FROM fe_v WHERE attack_category = 'dos_flood'""")

# --- queries -----------------------------------------------------------------------------------------
register("ent1_entity_history", "SELECT *, unique_peers >= 5 AS is_expanding_peers, unique_ports >= 5 AS is_expanding_ports FROM hist_v")(lambda t: t.history)
register("ent1_entity_peers", "SELECT entity, peer, count(*) AS sessions, min(start_ts) AS first_ts, max(end_ts) AS last_ts FROM ends_v GROUP BY 1, 2")(lambda t: en.entity_peers(t.ends))

P2 = ("entity", "connection_attempts", "inbound_sessions", "peer_count", "targeted_ports_count", "packet_volume", "byte_volume", "successful_sessions", "failed_sessions",
      "reset_sessions", "first_seen_window", "last_seen_window", "active_windows_count", "findings_count", "beaconing_detected", "roles", "scan_detected",
      "volume_anomalies_detected", "mitre_techniques")
register("ent2_entity_profile", f"SELECT {', '.join(P2)}, round(failure_ratio, 6) AS failure_ratio FROM prof_e")(
    lambda t: t.profile.select(*P2, r(F.col("failure_ratio")).alias("failure_ratio")))
register("ent4_kinematic_state", "SELECT entity, bucket, state, round(strength, 4) AS strength FROM kin_v")(
    lambda t: t.states.withColumn("strength", r(F.col("strength"), 4)))
register("ent5_kinematic_transitions", "SELECT entity, from_state, to_state, window_before, window_after, round(strength, 4) AS strength, transition_type FROM kt_v")(
    lambda t: t.transitions.withColumn("strength", r(F.col("strength"), 4)))
register("ent5_kinematic_trajectory", "SELECT * FROM traj_v")(lambda t: t.trajectory)
register("ent6_attack_state", """
SELECT f.entity, CASE WHEN sc OR s.entity IS NOT NULL THEN 'RECONNAISSANCE' WHEN ds THEN 'DENIAL_OF_SERVICE' ELSE 'UNKNOWN_STATE' END AS attack_state, a AS start_window, z AS end_window,
 CASE WHEN sc OR s.entity IS NOT NULL THEN 'T1046' WHEN ds THEN 'T1498' ELSE '' END AS mitre_techniques FROM (
 SELECT entity, min(bucket) AS a, max(bucket) AS z, bool_or(attack_category = 'port_scan') AS sc, bool_or(attack_category = 'dos_flood') AS ds FROM fe_v GROUP BY 1) f
LEFT JOIN (SELECT DISTINCT entity FROM chg_v WHERE change_type LIKE 'PORT%') s USING (entity)""")(lambda t: en.attack_states(t.findings, t.changes))
register("ent7_episodes", f"""
SELECT episode_id, entity, start_window, end_window, greatest({float(MONTH)}::DOUBLE, (end_window - start_window + 1) * {float(MONTH)}::DOUBLE) AS duration_seconds, finding_count, coalesce(session_count, 0) AS session_count, categories, array_to_string(list_sort(ports), ',') AS destination_ports, severity, attack_state, mitre_techniques
FROM epi_x""")(
    lambda t: t.episodes.withColumn("destination_ports", F.array_join("destination_ports", ",")))
register("ent8_risk_decompose", """
SELECT entity, score, priority_level, 25 * port_surges + 20 * connection_surges AS change_contribution, CAST(CASE WHEN campaign_count > 0 THEN 15 ELSE 0 END AS BIGINT) AS campaign_contribution FROM score_v""")(
    lambda t: t.scored.select("entity", "score", "priority_level", "change_contribution", "campaign_contribution"))
register("ent8_prioritise", "SELECT entity, score, priority_level, current_state, campaign_id, row_number() OVER (ORDER BY score DESC, entity) AS priority_rank FROM score_v")(
    lambda t: en.prioritize(t.scored))
register("ent9_threat_view", """
WITH st AS (SELECT f.entity, CASE WHEN sc OR s.entity IS NOT NULL THEN 'RECONNAISSANCE' WHEN ds THEN 'DENIAL_OF_SERVICE' ELSE 'UNKNOWN_STATE' END AS attack_state,
 CASE WHEN sc OR s.entity IS NOT NULL THEN 'T1046' WHEN ds THEN 'T1498' ELSE '' END AS mitre_techniques FROM (SELECT entity, bool_or(attack_category = 'port_scan') AS sc, bool_or(attack_category = 'dos_flood') AS ds FROM fe_v GROUP BY 1) f
 LEFT JOIN (SELECT DISTINCT entity FROM chg_v WHERE change_type LIKE 'PORT%') s USING (entity)),
pe AS (SELECT entity, count(DISTINCT peer) AS peers FROM ends_v GROUP BY 1),
po AS (SELECT entity, count(DISTINCT dst_port) AS ports FROM ends_v GROUP BY 1)
SELECT st.*, first_seen_window, last_seen_window, peers, ports, activity_count AS total_sessions, findings_count, CASE WHEN attack_state IN ('RECONNAISSANCE', 'DENIAL_OF_SERVICE') THEN 'HIGH' ELSE 'LOW' END AS threat_level,
 concat_ws(',', 'ML_DETECTION', CASE WHEN activity_count > 0 THEN 'TCP_SESSION' END, CASE WHEN unique_ports > 0 THEN 'FLOW_STATISTICS' END) AS modalities, false AS only_web_ports FROM st JOIN hist_v USING (entity) JOIN pe USING (entity) JOIN po USING (entity)""")(
    lambda t: en.threat_view(en.attack_states(t.findings, t.changes), t.history, t.ends))
register("ent9_threat_contacts", """
WITH own AS (SELECT * FROM ends_v WHERE entity IN (SELECT entity FROM fe_v))
SELECT DISTINCT entity, 'PEER' AS kind, peer AS value FROM own UNION ALL SELECT DISTINCT entity, 'PORT', CAST(dst_port AS VARCHAR) FROM own""")(
    lambda t: en.threat_contacts(en.attack_states(t.findings, t.changes).filter("entity <> 'network'"), t.ends))
register("ent10_contradictions", " UNION ALL ".join(
    f"SELECT entity, '{n}' AS rule, '{en.CONTRADICTION_SEVERITY[n]}' AS severity, 'contra_' || (sha256(entity || ':{n}')) AS contradiction_id FROM facts_v WHERE {v}"
    for n, v in CONTRA_SQL.items()))(lambda t: en.contradictions(t.facts))
HYPO = """
SELECT entity, 'ADMINISTRATIVE_SCAN' AS hypothesis_type, CASE WHEN (successful_sessions > 0 OR targeted_ports_count > 10) AND NOT failure_ratio > 0.8 THEN 'PARTIALLY_SUPPORTED' WHEN failure_ratio > 0.8 THEN 'SUPPORTED_THREAT' ELSE 'UNRESOLVED' END AS resolution_state
FROM facts_v WHERE contains(roles, 'SCANNER') OR current_state = 'RECONNAISSANCE' UNION ALL
SELECT entity, 'LEGITIMATE_INFRASTRUCTURE', CASE WHEN current_state IN ('IMPACT', 'COMMAND_AND_CONTROL') THEN 'PARTIALLY_SUPPORTED' ELSE 'SUPPORTED_BENIGN' END FROM facts_v WHERE successful_sessions >= 20 AND failure_ratio <= 0.05 UNION ALL
SELECT entity, 'SCHEDULED_POLLING', CASE WHEN coalesce(mincv < 0.15, false) THEN 'SUPPORTED_THREAT' ELSE 'UNRESOLVED' END FROM facts_v WHERE contains(roles, 'BEACON')"""
register("ent11_benign_hypotheses", HYPO)(lambda t: en.benign_hypotheses(t.facts))
cte("tier_v", """
SELECT *, 1 + CAST(findings_count > 0 AS INT) + CAST(p.e IS NOT NULL AS INT) + CAST(campaign_count > 0 AS INT) + CAST(total_transitions > 0 AS INT) AS mods FROM facts_v f LEFT JOIN (SELECT DISTINCT entity AS e FROM pat_v) p ON p.e = f.entity""")
TIER = """
SELECT entity, CASE WHEN campaign_count > 0 AND current_state NOT IN ('BENIGN', 'DISCOVERY') THEN 'CAMPAIGN_ACTIVITY' WHEN current_state IN ('IMPACT', 'COMMAND_AND_CONTROL', 'EXPLOITATION_INDICATOR') THEN 'ACTIVE_ATTACK_INDICATOR'
 WHEN (current_state = 'RECONNAISSANCE' OR contains(roles, 'SCANNER')) AND (targeted_ports_count >= 5 OR peer_count >= 3) THEN 'SUPPORTED_RECONNAISSANCE' WHEN current_state = 'RECONNAISSANCE' OR contains(roles, 'SCANNER') THEN 'SUSPICIOUS_BEHAVIOR'
 WHEN findings_count > 0 OR contains(roles, 'RESET_HEAVY') THEN 'SUSPICIOUS_BEHAVIOR' WHEN window_count < 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'NOISE' END AS semantic_tier,
 CASE WHEN (campaign_count > 0 AND current_state NOT IN ('BENIGN', 'DISCOVERY')) OR current_state IN ('IMPACT', 'COMMAND_AND_CONTROL', 'EXPLOITATION_INDICATOR') THEN CASE WHEN mods >= 2 THEN 'STRONGLY_SUPPORTED' ELSE 'SUPPORTED' END
 WHEN (current_state = 'RECONNAISSANCE' OR contains(roles, 'SCANNER')) AND (targeted_ports_count >= 5 OR peer_count >= 3) THEN 'DIRECTLY_OBSERVED' WHEN current_state = 'RECONNAISSANCE' OR contains(roles, 'SCANNER') THEN 'WEAKLY_SUPPORTED'
 WHEN findings_count > 0 OR contains(roles, 'RESET_HEAVY') THEN 'SUPPORTED' WHEN window_count < 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'DIRECTLY_OBSERVED' END AS grounding_state, mods AS modality_count FROM tier_v"""
register("ent12_threat_tier", TIER)(lambda t: en.threat_tier(t.facts, t.patterns))
VALUE = """
SELECT entity, s AS investigation_value_score, CASE WHEN s >= 80 THEN 'VERY_HIGH' WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MODERATE' ELSE 'LOW' END AS value_tier FROM (
 SELECT entity, CAST(25 * contradiction_count + CASE WHEN current_state IN ('IMPACT', 'COMMAND_AND_CONTROL') THEN 50 WHEN current_state IN ('EXPLOITATION_INDICATOR', 'RECONNAISSANCE') THEN 35 ELSE 0 END + CASE WHEN campaign_count > 0 THEN 30 ELSE 0 END
  + CASE WHEN peer_count >= 5 OR targeted_ports_count >= 10 THEN 20 ELSE 0 END + least(20, 5 * findings_count) + CASE WHEN window_count < 8 THEN 15 ELSE 0 END AS BIGINT) AS s FROM facts_v)"""
register("ent13_investigation_value", VALUE)(lambda t: en.investigation_value(t.facts))
register("ent14_mitigation_rules", """
SELECT entity, 'PRIORITIZE_CONTAINMENT' AS action_type, 'CRITICAL' AS urgency FROM facts_v WHERE current_state IN ('IMPACT', 'COMMAND_AND_CONTROL', 'EXPLOITATION_INDICATOR') UNION ALL
SELECT entity, 'REVIEW_EXPOSED_SERVICES', CASE WHEN targeted_ports_count > 20 OR peer_count > 5 THEN 'HIGH' ELSE 'MEDIUM' END FROM facts_v WHERE contains(roles, 'SCANNER') OR current_state IN ('RECONNAISSANCE', 'DISCOVERY') UNION ALL
SELECT entity, 'INSPECT_PERIODIC_RELATIONSHIP', 'HIGH' FROM facts_v WHERE contains(roles, 'BEACON') UNION ALL SELECT entity, 'INSPECT_RESET_PATTERNS', 'MEDIUM' FROM facts_v WHERE contains(roles, 'RESET_HEAVY') UNION ALL
SELECT entity, 'INVESTIGATE_CAMPAIGN', 'HIGH' FROM facts_v WHERE campaign_count > 0 UNION ALL SELECT entity, 'COLLECT_MORE_TELEMETRY', 'LOW' FROM facts_v WHERE window_count < 8""")(lambda t: en.mitigations(t.facts))
register("ent15_decision_list", """
SELECT *, 'dec_' || (sha256(subject || ':' || priority)) AS decision_id FROM (
 (SELECT 'INVESTIGATE_ENTITY' AS decision_type, entity AS subject, CASE WHEN contains(priority_level, 'CRITICAL') OR current_state IN ('IMPACT', 'COMMAND_AND_CONTROL') THEN 'P0_CRITICAL'
  WHEN contains(priority_level, 'HIGH') OR current_state IN ('EXPLOITATION_INDICATOR', 'RECONNAISSANCE') THEN 'P1_HIGH' WHEN contains(priority_level, 'MEDIUM') THEN 'P2_MEDIUM' ELSE 'P3_LOW' END AS priority, row_number() OVER (ORDER BY score DESC, entity) AS decision_rank FROM score_v) UNION ALL
 (SELECT 'INVESTIGATE_CAMPAIGN', campaign_id, CASE WHEN severity = 'CRITICAL' THEN 'P1_HIGH' ELSE 'P2_MEDIUM' END, row_number() OVER (ORDER BY start_window, campaign_id) FROM camp_v))""")(lambda t: en.decisions(t.scored, t.campaigns))
cte("ctg_v", "SELECT campaign_id, count(DISTINCT peer) AS target_count FROM camp_v c JOIN ends_v e ON e.entity = c.entity AND e.o AND e.bucket BETWEEN c.start_window AND c.end_window GROUP BY 1")
register("ent16_what_changed", """
SELECT entity, 'ATTACK_STATE' AS change_dimension, window_after, round(strength, 4) AS magnitude, CASE WHEN to_state IN ('IMPACT', 'COMMAND_AND_CONTROL') THEN 'CRITICAL' ELSE 'HIGH' END AS significance, from_state || '>' || to_state AS detail FROM kt_v UNION ALL
SELECT entity, 'BEHAVIORAL_METRIC', bucket, round(magnitude, 4), CASE WHEN contains(change_type, 'FANOUT') OR magnitude > 5 THEN 'HIGH' ELSE 'MEDIUM' END, change_type FROM chg_v UNION ALL
SELECT entity, 'STATISTICAL_BASELINE', bucket, round(z_score, 4), CASE WHEN z_score > 3 THEN 'HIGH' ELSE 'MEDIUM' END, metric_name FROM devi_v UNION ALL
SELECT entity, 'CAMPAIGN_MEMBERSHIP', start_window, round(target_count, 4), 'HIGH', campaign_id FROM camp_v JOIN ctg_v USING (campaign_id)""")(
    lambda t: en.what_changed(t.transitions, t.changes, t.deviations, t.campaigns.join(
        t.members.filter("role = 'TARGET'").groupBy("campaign_id").agg(F.count("*").alias("target_count")), "campaign_id")).withColumn("magnitude", r(F.col("magnitude"), 4)))


def forecasts(t):
    """Five forecast rows per entity, one per horizon, placed after its last activity."""
    return t.profile.select("entity", F.col("last_ts"), F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("horizon")).withColumn(
        "at_ts", F.col("last_ts") + F.col("horizon") * 60)


register("ent17_entity_timeline", f"""
SELECT *, 'evt_' || (sha256(entity || ':' || event_type || ':' || CAST(floor(timestamp) AS BIGINT) || ':' || detail)) AS event_id FROM (
SELECT entity, 'FIRST_SEEN' AS event_type, first_ts AS timestamp, 'INFO' AS severity, 'OBSERVED' AS scope, '' AS detail FROM prof_e UNION ALL
SELECT entity, 'BEHAVIOR_CHANGE', bucket * {float(MONTH)}::DOUBLE, CASE WHEN contains(change_type, 'FANOUT') THEN 'HIGH' ELSE 'MEDIUM' END, 'OBSERVED', change_type FROM chg_v UNION ALL
SELECT entity, 'BASELINE_DEVIATION', bucket * {float(MONTH)}::DOUBLE, CASE WHEN z_score > 3 THEN 'HIGH' ELSE 'MEDIUM' END, 'OBSERVED', metric_name FROM devi_v UNION ALL
SELECT entity, 'ANOMALY', bucket * {float(MONTH)}::DOUBLE, upper(severity), 'OBSERVED', attack_category FROM fe_v UNION ALL
SELECT entity, 'KINEMATIC_TRANSITION', window_after * {float(MONTH)}::DOUBLE, CASE WHEN to_state IN ('IMPACT', 'COMMAND_AND_CONTROL') THEN 'CRITICAL' ELSE 'HIGH' END, 'OBSERVED', to_state FROM kt_v WHERE from_state <> to_state UNION ALL
SELECT entity, 'PATTERN_START', start_window * {float(MONTH)}::DOUBLE, severity, 'OBSERVED', pattern_type FROM pat_v UNION ALL
SELECT entity, 'CAMPAIGN_JOIN', start_window * {float(MONTH)}::DOUBLE, severity, 'OBSERVED', campaign_id FROM camp_v UNION ALL
SELECT entity, 'FORECAST_GENERATED', last_ts + k * 60, 'INFO', 'FORECAST', CAST(k AS VARCHAR) FROM prof_e, (SELECT unnest(range(1, 6)) AS k))""")(
    lambda t: en.entity_timeline(t.profile, t.changes, t.deviations, t.findings, t.transitions, t.patterns, t.campaigns, forecasts(t), MONTH))
register("ent18_relationships", """
WITH d AS (SELECT e.entity, peer, CASE WHEN o THEN 1 ELSE 2 END AS rank, CASE WHEN o AND contains(roles, 'SCANNER') THEN 'SCANS' WHEN NOT o AND contains(roles, 'SCANNER') THEN 'SCANNED_BY' ELSE 'COMMUNICATES_WITH' END AS rt, count(*) AS weight
 FROM ends_v e JOIN prof_e USING (entity) WHERE e.entity <> peer GROUP BY ALL),
ct AS (SELECT c.entity AS h, e.peer AS t, count(DISTINCT campaign_id) AS w FROM camp_v c JOIN ends_v e ON e.entity = c.entity AND e.o AND e.bucket BETWEEN c.start_window AND c.end_window WHERE c.entity <> e.peer GROUP BY 1, 2),
a AS (SELECT * FROM d UNION ALL SELECT h, t, 3, 'SHARES_CAMPAIGN', w FROM ct UNION ALL SELECT t, h, 3, 'SHARES_CAMPAIGN', w FROM ct UNION ALL SELECT src_ip, dst_ip, 5, 'BEACON_RELATIONSHIP', count(*) FROM be_v GROUP BY 1, 2)
SELECT entity, peer, arg_min(rt, rank) AS relationship_type, arg_min(weight, rank) AS weight FROM a GROUP BY 1, 2""")(
    lambda t: en.relationships(t.ends, t.profile, t.members, t.beacons))
register("ent19_dossier", f"""
SELECT f.entity, roles, current_state, peak_state, mitre_techniques, contradiction_count, campaign_id, score, priority_level, activity_count, unique_peers, unique_ports, h.findings_count, investigation_value_score, value_tier, semantic_tier, grounding_state
FROM score_v f JOIN hist_v h USING (entity) JOIN ({VALUE}) v USING (entity) JOIN ({TIER}) t USING (entity)""")(
    lambda t: en.dossier(t.facts, t.scored, t.history, en.investigation_value(t.facts), en.threat_tier(t.facts, t.patterns)).withColumn(
        "contradiction_count", F.col("contradiction_count").cast("int")))
register("ent20_forecast_context", """
SELECT entity, current_state, peak_state, active_windows_count AS state_duration_windows, trajectory_length, change_count, campaign_id,
 concat_ws(',', CASE WHEN active_windows_count < 3 THEN 'LIMITED_HISTORY' END, CASE WHEN current_state = 'RECONNAISSANCE' THEN 'DOWNSTREAM_PROGRESSION' END) AS abstention_reasons FROM facts_v""")(lambda t: en.forecast_context(t.facts))
register("ent21_questions", f"""
SELECT entity, 'AUTHORIZATION' AS category, '' AS detail FROM facts_v WHERE contains(roles, 'SCANNER') OR current_state IN ('RECONNAISSANCE', 'DISCOVERY') UNION ALL
SELECT entity, 'ATTACK_SURFACE', '' FROM facts_v WHERE targeted_ports_count > 0 UNION ALL SELECT entity, 'TEMPORAL_PERSISTENCE', '' FROM facts_v WHERE window_count < 8 UNION ALL
SELECT entity, 'CAMPAIGN_CORRELATION', '' FROM facts_v WHERE campaign_count > 0 UNION ALL SELECT entity, 'BENIGN_DISPROVAL', hypothesis_type FROM ({HYPO})""")(
    lambda t: en.questions(t.facts, en.benign_hypotheses(t.facts)))
register("ent22_threat_story", """
SELECT entity, 'Initial Observation' AS stage, first_seen_window AS window, roles AS detail, 1 AS stage_order FROM facts_v UNION ALL
SELECT entity, 'Behavioral Change', bucket, change_type, 2 FROM chg_v UNION ALL SELECT entity, 'Kinematic Transition', window_after, from_state || '>' || to_state, 3 FROM kt_v UNION ALL
SELECT entity, 'Attack Pattern Manifestation', start_window, pattern_type, 4 FROM pat_v UNION ALL
SELECT entity, 'Contradicting Evidence', first_seen_window, 'clean_sessions_baseline', 5 FROM facts_v WHERE successful_sessions > 20 AND failure_ratio < 0.05""")(
    lambda t: en.threat_story(t.facts, t.changes, t.transitions, t.patterns))
register("ent23_incident_dossier", """
WITH tg AS (SELECT entity, count(DISTINCT t) AS target_count FROM (
 SELECT p.entity, e.peer AS t FROM pat_v p JOIN ends_v e ON e.entity = p.entity AND e.bucket = p.start_window WHERE p.pattern_type <> 'VOLUME_AMPLIFICATION' UNION ALL
 SELECT c.entity, e.peer FROM camp_v c JOIN ends_v e ON e.entity = c.entity AND e.o AND e.bucket BETWEEN c.start_window AND c.end_window) GROUP BY 1),
cs AS (SELECT entity, string_agg(DISTINCT s, ',' ORDER BY s) AS attack_states, count(DISTINCT campaign_id) AS campaigns FROM (SELECT entity, campaign_id, unnest(string_split(attack_states, ',')) AS s FROM camp_v) GROUP BY 1),
ps AS (SELECT entity, count(*) AS patterns FROM pat_v GROUP BY 1)
SELECT f.entity, current_state, mitre_techniques, coalesce(target_count, 0) AS target_count, coalesce(attack_states, '') AS attack_states, coalesce(campaigns, 0) AS campaigns, coalesce(patterns, 0) AS patterns
FROM facts_v f LEFT JOIN tg USING (entity) LEFT JOIN cs USING (entity) LEFT JOIN ps USING (entity) WHERE campaigns IS NOT NULL OR patterns IS NOT NULL""")(
    lambda t: en.incident_dossier(t.facts, t.patterns, t.patterns.filter("pattern_type <> 'VOLUME_AMPLIFICATION'").select(
        "pattern_id", "entity", F.col("start_window").alias("bucket")).join(t.ends.select("entity", "bucket", F.col("peer").alias("target")), ["entity", "bucket"]).select(
        "pattern_id", "target").distinct(), t.campaigns, t.members))
cte("stg_v", """
SELECT entity, CASE attack_category WHEN 'port_scan' THEN 'RECONNAISSANCE' WHEN 'dos_flood' THEN 'IMPACT' ELSE 'INITIAL_ACCESS' END AS stage, 'HEURISTIC' AS source, 0.8 AS confidence FROM fe_v UNION ALL
SELECT src_ip, 'COMMAND_AND_CONTROL', 'ZEEK', 0.85 FROM be_v""")


def stage_evidence(t):
    cat = F.col("attack_category")
    f = t.findings.select("entity", F.when(cat == "port_scan", "RECONNAISSANCE").when(cat == "dos_flood", "IMPACT").otherwise("INITIAL_ACCESS").alias("stage"),
                          F.lit("HEURISTIC").alias("source"), F.lit(0.8).alias("confidence"))
    return f.unionByName(t.beacons.filter("is_beaconing").select(F.col("src_ip").alias("entity"), F.lit("COMMAND_AND_CONTROL").alias("stage"),
                                                                 F.lit("ZEEK").alias("source"), F.lit(0.85).alias("confidence")))


register("ent25_stage_inference", """
WITH s AS (SELECT entity, stage, sum(confidence) AS weight, avg(confidence) AS a, max(confidence) AS m, count(DISTINCT source) AS n, bool_or(source = 'ZEEK') AS ob FROM stg_v GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER w AS i, lead(weight) OVER w AS rw FROM s WINDOW w AS (PARTITION BY entity ORDER BY weight DESC, stage))
SELECT entity, CASE WHEN coalesce(weight < 0.8 AND weight - rw < 0.1, false) THEN 'UNKNOWN' ELSE stage END AS primary_stage, round(weight, 4) AS weight, round(rw, 4) AS runner_weight,
 CASE WHEN ob THEN 'OBSERVED' ELSE 'INFERRED' END AS classification, round(greatest(0.1, least(0.99, a * CASE WHEN n >= 2 THEN 1.1 ELSE 0.9 END)), 4) AS overall_confidence,
 round(a, 4) AS stage_confidence, round(m, 4) AS technique_confidence FROM k WHERE i = 1""")(
    lambda t: en.stage_inference(t_round(stage_evidence(t)), "entity").withColumns({n: r(F.col(n), 4) for n in (
        "weight", "runner_weight", "overall_confidence", "stage_confidence", "technique_confidence")}))


def t_round(df):
    # decimals add up exactly, so equal weights tie on both sides
    return df.withColumn("confidence", F.col("confidence").cast("decimal(10,4)"))


register("pat1_horizontal_scan", """
SELECT src_ip, n AS target_count, round(a, 6) AS avg_ports_per_target, bucket FROM (SELECT bucket, src_ip, count(*) AS n, avg(p) AS a FROM (SELECT bucket, src_ip, dst_ip, count(DISTINCT dst_port) AS p FROM mf_v GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE n >= 5 AND a <= 4""")(
    lambda t: pt.horizontal_scans(t.sessions, ["bucket"]).select("src_ip", "target_count", r(F.col("avg_ports_per_target")).alias("avg_ports_per_target"), "bucket"))
register("pat2_vertical_scan", "SELECT src_ip, dst_ip, count(DISTINCT dst_port) AS port_count, min(bucket) AS start_window, max(bucket) AS end_window FROM mf_v GROUP BY 1, 2 HAVING count(DISTINCT dst_port) >= 6")(
    lambda t: pt.vertical_scans(t.sessions, min_ports=6))
register("pat3_distributed_scan", "SELECT dst_ip, bucket, count(DISTINCT src_ip) AS source_count FROM mf_v GROUP BY 1, 2 HAVING count(DISTINCT src_ip) >= 5")(
    lambda t: pt.distributed_scans(t.sessions, ["bucket"]).select("dst_ip", "bucket", "source_count"))
register("pat4_beacon_cluster", "SELECT count(*) AS beacon_count, count(DISTINCT src_ip) AS source_count, count(DISTINCT dst_ip) AS target_count FROM be_v HAVING count(DISTINCT src_ip) >= 2")(
    lambda t: pt.beacon_cluster(t.beacons))
register("pat4_volume_amp", "SELECT entity, bucket, 'CRITICAL' AS severity, 'pat_' || (sha256(entity || ':VOL_AMP:' || bucket)) AS pattern_id FROM fe_v WHERE attack_category = 'dos_flood'")(
    lambda t: pt.volume_amplification(t.findings))
register("pat5_campaigns", "SELECT campaign_id, entity, start_window, end_window, duration_seconds, episode_count, attack_states, mitre_techniques, severity FROM camp_v")(lambda t: t.campaigns)
register("pat6_campaign_dossier", """
SELECT campaign_id, c.entity, episode_id, e.start_window, e.end_window, finding_count, CASE c.severity WHEN 'CRITICAL' THEN 'ISOLATE' WHEN 'HIGH' THEN 'INVESTIGATE' ELSE 'MONITOR' END AS action
FROM camp_v c JOIN epi_v e ON e.entity = c.entity AND e.start_window >= c.start_window AND e.end_window <= c.end_window""")(lambda t: pt.campaign_dossier(t.campaigns, t.episodes))
register("pat12_network_world_rollup", """
SELECT (SELECT count(DISTINCT entity) FROM ends_v) AS active_entity_count, (SELECT count(DISTINCT bucket) FROM ends_v) AS total_windows, (SELECT count(*) FROM ends_v) AS session_ends, (SELECT count(*) FROM epi_v) AS episodes,
 (SELECT count(*) FROM epi_v WHERE severity = 'HIGH') AS high_episodes, (SELECT CAST(sum(contradiction_count) AS BIGINT) FROM facts_v) AS contradictions, (SELECT count(*) FROM facts_v WHERE campaign_count > 0) AS entities_in_campaigns""")(
    lambda t: pt.network_rollup(t.ends, t.episodes, en.attack_states(t.findings, t.changes), t.facts).drop("recon_entities", "dos_entities"))
