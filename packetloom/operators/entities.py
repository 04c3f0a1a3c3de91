"""Entity intelligence: histories, profiles, kinematics, priorities and the views built on them.

Every view reads one wide ``facts`` table (one row per entity, see :func:`entity_facts`), so the rules
are plain column expressions and nothing is shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.columns import bucket, choose, count_when, set_size, stable_id, tag_string
from packetloom.functions.ordered import global_row_number
from packetloom.functions.spans import join_spans

W = Window
c = F.col


def by_source_window(sessions: DataFrame, seconds: int) -> DataFrame:
    """Sessions with their window ``bucket``, laid out by source and window.

    What is counted per source and window then needs no shuffle, and counts by anything else shrink before theirs.
    """
    return with_window(sessions, seconds).repartition("src_ip", "bucket")


def with_window(sessions: DataFrame, seconds: int) -> DataFrame:
    """Sessions with their window ``bucket``."""
    return sessions.withColumn("bucket", bucket("start_ts", seconds))


def endpoint_rows(sessions: DataFrame, seconds: int) -> DataFrame:
    """Rows of (entity, window, peer, port, direction, protocol, state) with counts that add up: the base of all profiles.

    One row each, or one per session where those have a ``bucket`` (see ``by_source_window``): they lie so that the first count
    of a reader reduces them without a shuffle. Both directions are branches of their own, so a reader of one leaves the other out.
    """
    packets, size = c("fwd_packets") + c("rev_packets"), c("fwd_bytes") + c("rev_bytes")
    keys = ("bucket", "src_ip", "dst_ip", "dst_port", "protocol", "state")
    if "bucket" in sessions.columns:
        s = sessions.select(*keys, F.lit(1).cast("bigint").alias("n"), packets.alias("packets"), size.alias("bytes"),
                            c("start_ts").alias("first_ts"), c("end_ts").alias("last_ts"))
    else:
        s = sessions.withColumn("bucket", bucket("start_ts", seconds)).groupBy(*keys).agg(
            F.count("*").alias("n"), F.sum(packets).alias("packets"), F.sum(size).alias("bytes"), F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"))
    side = lambda a, b, out: s.select(
        c(a).alias("entity"), c(b).alias("peer"), F.lit(out).alias("out"), "bucket", "dst_port", "protocol", "state", "n", "packets", "bytes", "first_ts", "last_ts")
    return side("src_ip", "dst_ip", True).unionByName(side("dst_ip", "src_ip", False))


def window_totals(ends: DataFrame, out: bool) -> DataFrame:
    """One row per (entity, window) of one direction: sums, first and last times, and the sets of ports and states, both of bounded domains.

    Histories, profiles, states and episodes count from these rows (``totals``), so the sessions are read once a direction for all
    of them. Where sessions are laid out by source and window the outgoing rows need no shuffle.
    """
    many = lambda *states: F.sum(F.when(c("state").isin(*states), c("n")).otherwise(0))
    g = ends.filter("out" if out else "NOT out").groupBy("entity", "bucket").agg(
        F.sum("n").alias("n"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        many("ESTABLISHED", "FIN_ACK", "CLOSED").alias("ok"), many("REJECTED", "ATTEMPTED").alias("refused"), many("RESET").alias("reset"),
        many("REJECTED", "RESET").alias("broken"), F.collect_set("dst_port").alias("ports"), F.array_sort(F.collect_set("state")).alias("states"))
    return g.withColumn("out", F.lit(out))


def both_totals(ends: DataFrame) -> DataFrame:
    """``window_totals`` of both directions."""
    return window_totals(ends, True).unionByName(window_totals(ends, False))


def port_counts(totals: DataFrame) -> DataFrame:
    """Distinct ports per entity, over its windows."""
    return totals.select("entity", F.explode("ports").alias("port")).distinct().groupBy("entity").agg(F.count("*").alias("port_count"))


def peer_counts(ends: DataFrame) -> DataFrame:
    """Distinct peers per entity; each (entity, peer) is reduced to one row first, from the outgoing rows: incoming ones mirror them."""
    met = ends.filter("out").select("entity", "peer").distinct()
    turned = F.explode(F.array(F.struct("entity", "peer"), F.struct(c("peer").alias("entity"), c("entity").alias("peer")))).alias("_x")
    both = met.select(turned).select("_x.*").distinct()
    return both.groupBy("entity").agg(F.count("*").alias("peer_count"))


def entity_history(ends: DataFrame, findings: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Activity, peers, ports, volumes and findings per entity with the expansion flags; ``totals`` where they are at hand."""
    totals = both_totals(ends) if totals is None else totals
    h = totals.groupBy("entity").agg(
        F.min("bucket").alias("_a"), F.max("bucket").alias("_b"), set_size(c("bucket")).alias("active_windows"),
        F.sum("n").alias("activity_count"), F.sum("packets").alias("total_packets"), F.sum("bytes").alias("total_bytes"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("states")))), ",").alias("observed_states"))
    h = h.join(port_counts(totals).withColumnRenamed("port_count", "unique_ports"), "entity", "left")
    h = h.join(peer_counts(ends).withColumnRenamed("peer_count", "unique_peers"), "entity")
    f = findings.groupBy("entity").agg(F.count("*").alias("findings_count"), F.min("bucket").alias("_fa"), F.max("bucket").alias("_fb"))
    j = h.join(f, "entity", "full_outer")
    return j.select("entity", F.least("_a", "_fa").alias("first_seen_window"), F.greatest("_b", "_fb").alias("last_seen_window"),
                    *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in (
                        "active_windows", "activity_count", "unique_peers", "unique_ports", "total_packets", "total_bytes",
                        "findings_count")],
                    F.coalesce("observed_states", F.lit("")).alias("observed_states"),
                    (F.coalesce("unique_peers", F.lit(0)) >= 5).alias("is_expanding_peers"),
                    (F.coalesce("unique_ports", F.lit(0)) >= 5).alias("is_expanding_ports"))


def entity_peers(ends: DataFrame) -> DataFrame:
    """The long form of the peer sets: one row per (entity, peer)."""
    return ends.groupBy("entity", "peer").agg(F.sum("n").alias("sessions"), F.min("first_ts").alias("first_ts"),
                                              F.max("last_ts").alias("last_ts"))


def entity_profile(ends: DataFrame, findings: DataFrame, beacons: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Counts, failure ratio, roles and techniques per entity; ``totals`` where they are at hand."""
    totals = both_totals(ends) if totals is None else totals
    sent = lambda n: F.sum(F.when(c("out"), c(n)).otherwise(0))
    g = totals.groupBy("entity").agg(
        sent("n").alias("connection_attempts"), F.sum(F.when(c("out"), 0).otherwise(c("n"))).alias("inbound_sessions"),
        F.sum("packets").alias("packet_volume"), F.sum("bytes").alias("byte_volume"),
        sent("ok").alias("successful_sessions"), sent("refused").alias("failed_sessions"), sent("reset").alias("reset_sessions"),
        F.min("bucket").alias("first_seen_window"), F.max("bucket").alias("last_seen_window"),
        set_size(c("bucket")).alias("active_windows_count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    g = g.join(port_counts(totals.filter("out")).withColumnRenamed("port_count", "targeted_ports_count"), "entity", "left")
    g = g.withColumn("targeted_ports_count", F.coalesce("targeted_ports_count", F.lit(0).cast("bigint")))
    g = g.join(peer_counts(ends), "entity")
    b = beacons.filter("is_beaconing").groupBy(c("src_ip").alias("entity")).agg(
        F.min("coefficient_of_variation").alias("min_beacon_cv"), F.max("coefficient_of_variation").alias("max_beacon_cv"),
        F.max("score").alias("beacon_score"))
    cat = F.lower("attack_category")
    f = findings.groupBy("entity").agg(F.count("*").alias("findings_count"), F.bool_or(cat.contains("scan")).alias("_scan"),
                                       F.bool_or(cat.contains("dos")).alias("_dos"))
    p = g.join(b, "entity", "left").join(f, "entity", "left")
    att, ports, peers, inn = c("connection_attempts"), c("targeted_ports_count"), c("peer_count"), c("inbound_sessions")
    p = p.withColumns({"failure_ratio": (c("failed_sessions") + c("reset_sessions")) / F.greatest(F.lit(1), att),
                       "beaconing_detected": c("beacon_score").isNotNull(), "findings_count": F.coalesce("findings_count", F.lit(0).cast("bigint"))})
    one = F.lit(1)
    scanner = (ports >= 10) | ((att >= 10) & (ports / F.greatest(one, att) > 0.6))
    server = inn > 3 * F.greatest(one, att)
    big = (c("packet_volume") > 5000) | (c("byte_volume") > 1000000)
    wins = c("active_windows_count")
    quiet = (wins <= 1) & (att <= 2)
    emerge = ~quiet & (wins == 1) & (att >= 10)
    roles = tag_string(
        (scanner, "SCANNER"), ((peers >= 5) & (att >= 10), "FANOUT_SOURCE"), (server, "SERVER"), (server & (peers >= 5), "FANIN_TARGET"),
        (~server & (att > 2 * F.greatest(one, inn)), "CLIENT"), (c("beaconing_detected"), "BEACON"),
        (c("beaconing_detected"), "PERIODIC_COMMUNICATOR"),
        ((c("reset_sessions") >= 5) | ((att >= 5) & (c("failure_ratio") >= 0.7)), "RESET_HEAVY"),
        (big & (att >= inn), "HIGH_VOLUME_SOURCE"), (big & (att < inn), "HIGH_VOLUME_TARGET"), (quiet, "QUIET_ENTITY"),
        (emerge, "EMERGING_ENTITY"), (emerge, "BURSTY_SOURCE"))
    p = p.withColumn("roles", F.when(roles == "", "CLIENT").otherwise(roles))
    p = p.withColumns({"scan_detected": F.coalesce("_scan", F.lit(False)) | c("roles").contains("SCANNER"),
                       "volume_anomalies_detected": F.coalesce("_dos", F.lit(False))})
    return p.withColumn("mitre_techniques", tag_string(
        (c("scan_detected"), "T1046"), (c("beaconing_detected"), "T1071"), (c("volume_anomalies_detected"), "T1498"))).drop("_scan", "_dos")


# Severity order of states and the allowed single steps.
STATE_RANK = {"BENIGN": 0, "UNKNOWN_STATE": 1, "DISCOVERY": 2, "RECONNAISSANCE": 3, "TARGETING": 4, "EXPLOITATION_INDICATOR": 5,
              "EXECUTION_INDICATOR": 6, "COMMAND_AND_CONTROL": 7, "IMPACT": 8}
ALLOWED_STEPS = {
    "BENIGN": ("DISCOVERY", "RECONNAISSANCE"), "DISCOVERY": ("RECONNAISSANCE", "TARGETING"),
    "RECONNAISSANCE": ("TARGETING", "EXPLOITATION_INDICATOR"), "TARGETING": ("EXPLOITATION_INDICATOR",),
    "EXPLOITATION_INDICATOR": ("EXECUTION_INDICATOR", "COMMAND_AND_CONTROL", "IMPACT"),
    "EXECUTION_INDICATOR": ("COMMAND_AND_CONTROL", "IMPACT"), "COMMAND_AND_CONTROL": ("IMPACT",)}


def kinematic_states(ends: DataFrame, findings: DataFrame, changes: DataFrame, beacons: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Prioritised state of each (entity, window) with its strength; ``totals`` where they are at hand."""
    totals = both_totals(ends) if totals is None else totals
    s = totals.groupBy("entity", "bucket").agg(F.sum("n").alias("sessions"), F.sum("broken").alias("failed"))
    cat = F.lower("attack_category")
    f = findings.groupBy("entity", "bucket").agg(
        F.bool_or(cat.rlike("dos|flood|slowloris|hulk")).alias("dos"), F.bool_or(cat.rlike("c2|beacon")).alias("c2"),
        F.bool_or(cat.rlike("exploit|injection|overflow")).alias("exploit"), F.bool_or(cat.rlike("scan|recon|probe")).alias("scan"),
        F.bool_or(cat.rlike("probe|discovery")).alias("probe"), F.bool_or(F.upper("severity") == "CRITICAL").alias("critical"))
    ch = changes.groupBy("entity", "bucket").agg(F.bool_or(c("change_type").contains("PORT_FANOUT")).alias("surge"))
    b = beacons.filter("is_beaconing").groupBy(c("src_ip").alias("entity")).agg(F.max("score").alias("bscore"))
    x = s.join(f, ["entity", "bucket"], "full_outer").join(ch, ["entity", "bucket"], "full_outer").join(b, "entity", "left")
    t = lambda n: F.coalesce(c(n), F.lit(False))
    disc = (t("probe") | (F.coalesce("sessions", F.lit(0)) >= 5)) & (F.coalesce("failed", F.lit(0)) >= 3)
    c2 = c("bscore").isNotNull() | t("c2")
    recon = t("scan") | t("surge")
    state = choose((t("dos"), "IMPACT"), (c2, "COMMAND_AND_CONTROL"), (t("exploit"), "EXPLOITATION_INDICATOR"),
                   (recon, "RECONNAISSANCE"), (disc, "DISCOVERY"), default="BENIGN")
    strength = choose((t("dos") & t("critical"), 0.9), (t("dos"), 0.75), (c2, F.greatest(F.lit(0.7), F.coalesce("bscore", F.lit(0.7)))),
                      (t("exploit"), 0.85), (t("surge") & t("scan"), 0.85), (recon, 0.70), (disc, 0.60),
                      (F.coalesce("sessions", F.lit(0)) > 0, 0.90), default=0.50)
    return x.select("entity", "bucket", state.alias("state"), strength.alias("strength"))


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv])


def kinematic_transitions(states: DataFrame) -> DataFrame:
    """Consecutive states per entity with whether the step is supported (one row per observed pair)."""
    w = W.partitionBy("entity").orderBy("bucket")
    x = states.withColumns({"from_state": F.lag("state").over(w), "window_before": F.lag("bucket").over(w)}).filter("from_state IS NOT NULL")
    steps = [f"{a}>{b}" for a, bs in ALLOWED_STEPS.items() for b in bs]
    ok = (c("from_state") == c("state")) | F.concat("from_state", F.lit(">"), "state").isin(*steps)
    return x.select("entity", "from_state", c("state").alias("to_state"), "window_before", c("bucket").alias("window_after"), "strength",
                    F.when(ok, "SUPPORTED_TRANSITION").otherwise("UNSUPPORTED_TRANSITION").alias("transition_type"))


def kinematic_trajectory(states: DataFrame, transitions: DataFrame) -> DataFrame:
    """Current and peak state, length and unsupported steps per entity."""
    rank = _map(STATE_RANK)
    s = states.groupBy("entity").agg(
        F.max_by("state", "bucket").alias("current_state"), F.max_by("state", F.struct(rank[c("state")].alias("r"), (-c("bucket")).alias("b"))).alias("peak_state"),
        F.count("*").alias("trajectory_length"), F.min("bucket").alias("first_window"), F.max("bucket").alias("last_window"))
    t = transitions.groupBy("entity").agg(F.count("*").alias("total_transitions"),
                                          count_when(c("transition_type") == "UNSUPPORTED_TRANSITION").alias("unsupported_transition_count"))
    z = F.lit(0).cast("bigint")
    return s.join(t, "entity", "left").withColumns({n: F.coalesce(n, z) for n in ("total_transitions", "unsupported_transition_count")})


def attack_states(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """RECONNAISSANCE, DENIAL_OF_SERVICE or UNKNOWN_STATE per entity with findings; one benign row when there are none."""
    cat = F.lower("attack_category")
    f = findings.groupBy("entity").agg(F.min("bucket").alias("start_window"), F.max("bucket").alias("end_window"),
                                       F.bool_or(cat.rlike("scan|recon")).alias("_scan"), F.bool_or(cat.rlike("dos|flood")).alias("_dos"))
    s = changes.filter(c("change_type").contains("PORT_FANOUT")).select("entity").distinct().withColumn("_surge", F.lit(True))
    j = f.join(s, "entity", "left")
    scan = c("_scan") | F.coalesce("_surge", F.lit(False))
    rows = j.select("entity", choose((scan, "RECONNAISSANCE"), (c("_dos"), "DENIAL_OF_SERVICE"), default="UNKNOWN_STATE").alias("attack_state"),
                    "start_window", "end_window", choose((scan, "T1046"), (c("_dos"), "T1498"), default="").alias("mitre_techniques"))
    none = findings.groupBy().agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("network").alias("entity"), F.lit("BENIGN_OBSERVATION").alias("attack_state"), F.lit(0).cast("bigint").alias("start_window"),
        F.lit(0).cast("bigint").alias("end_window"), F.lit("").alias("mitre_techniques"))
    return rows.unionByName(none)


def episodes(findings: DataFrame, ends: DataFrame, per_window_gap: int | None = None, seconds: int = 60, totals: DataFrame | None = None) -> DataFrame:
    """Findings of an entity as one episode, or split where more than ``per_window_gap`` windows pass between findings; ``totals`` where they are at hand."""
    f = findings
    if per_window_gap is None:
        f = f.withColumn("_ep", F.lit(0).cast("bigint"))
    else:
        w = W.partitionBy("entity").orderBy("bucket")
        days = f.select("entity", "bucket").distinct()
        days = days.withColumn("_new", F.coalesce((c("bucket") - F.lag("bucket").over(w) > per_window_gap).cast("int"), F.lit(0)))
        days = days.withColumn("_ep", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
        f = f.join(days, ["entity", "bucket"])
    cat = F.lower("attack_category")
    g = f.groupBy("entity", "_ep").agg(
        F.min("bucket").alias("start_window"), F.max("bucket").alias("end_window"), F.count("*").alias("finding_count"),
        F.array_join(F.array_sort(F.collect_set("attack_category")), ",").alias("categories"),
        F.bool_or(F.upper("severity").isin("HIGH", "CRITICAL")).alias("_hi"), F.bool_or(cat.rlike("recon|scan")).alias("_scan"),
        F.bool_or(cat.rlike("dos|flood")).alias("_dos"), F.bool_or(cat.contains("dos")).alias("_dos_only"))
    # an entity's episodes don't overlap: each of its windows belongs to one at most
    if totals is None:
        per_window = ends.groupBy("entity", "bucket").agg(F.collect_set("dst_port").alias("_ports"), F.sum("n").alias("n"))
    else:
        per_window = totals.select("entity", "bucket", "n", c("ports").alias("_ports"))
    during = join_spans(per_window, g.select("entity", "_ep", "start_window", "end_window"), ["entity"],
                        "bucket", "start_window", "end_window")
    during = during.select("entity", "_ep", "n", F.posexplode_outer("_ports").alias("_i", "dst_port"))
    met = during.groupBy("entity", "_ep").agg(F.array_sort(F.collect_set("dst_port")).alias("destination_ports"),
                                              F.sum(F.when(F.coalesce("_i", F.lit(0)) == 0, c("n"))).alias("session_count"))
    g = g.join(met, ["entity", "_ep"], "left")
    return g.select(
        stable_id("ep", c("entity"), c("start_window"), c("end_window"), c("finding_count")).alias("episode_id"), "entity",
        "start_window", "end_window", F.greatest(F.lit(float(seconds)), (c("end_window") - c("start_window") + 1) * float(seconds)).alias("duration_seconds"),
        "finding_count", F.coalesce("session_count", F.lit(0).cast("bigint")).alias("session_count"), "categories", "destination_ports",
        F.when(c("_hi"), "HIGH").otherwise("MEDIUM").alias("severity"),
        choose((c("_dos_only"), "DENIAL_OF_SERVICE"), (c("_scan"), "RECONNAISSANCE"), default="BENIGN_OBSERVATION").alias("attack_state"),
        tag_string((c("_scan"), "T1046"), (c("_dos"), "T1498")).alias("mitre_techniques"))


def episode_targets(episode_rows: DataFrame, ends: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """``entity, episode_id, target``: the peers an entity contacted during each of its episodes."""
    return episode_rows.select("entity", "episode_id", "start_window", "end_window").join(
        targets_during(episode_rows, ends, totals), ["entity", "start_window", "end_window"]).select("entity", "episode_id", "target")


def targets_during(spans: DataFrame, ends: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """``entity, start_window, end_window, target``: the peers an entity contacted during each of its spans; windows come from ``totals`` where they are at hand."""
    met = ends.filter("out").select("entity", "bucket", c("peer").alias("target")).distinct()
    cut = spans.select("entity", "start_window", "end_window").distinct()
    active = None if totals is None else totals.filter("out")
    return join_spans(met, cut, ["entity"], "bucket", "start_window", "end_window", active).select("entity", "start_window", "end_window", "target").distinct()


def entity_facts(profile: DataFrame, trajectory: DataFrame, changes: DataFrame, deviations: DataFrame, campaigns: DataFrame,
                 windows: DataFrame) -> DataFrame:
    """The wide table: profile, kinematics, change and deviation counts, first campaign, contradictions."""
    ch = changes.groupBy("entity").agg(count_when(c("change_type").contains("PORT_FANOUT")).alias("port_surges"),
                                       count_when(c("change_type").contains("CONNECTION_ATTEMPT")).alias("connection_surges"),
                                       F.count("*").alias("change_count"))
    dv = deviations.groupBy("entity").agg(F.count("*").alias("deviation_count"))
    cm = campaigns.groupBy("entity").agg(F.min_by("campaign_id", F.struct("start_window", "campaign_id")).alias("campaign_id"),
                                         F.count("*").alias("campaign_count"))
    n = windows.agg(F.count_distinct("bucket").alias("n")).scalar()
    f = (profile.join(trajectory.select("entity", "current_state", "peak_state", "trajectory_length", "total_transitions",
                                        "unsupported_transition_count"), "entity", "left")
         .join(ch, "entity", "left").join(dv, "entity", "left").join(cm, "entity", "left"))
    z = F.lit(0).cast("bigint")
    fill = ("trajectory_length", "total_transitions", "unsupported_transition_count", "port_surges", "connection_surges", "change_count",
            "deviation_count", "campaign_count")
    f = f.withColumns({x: F.coalesce(x, z) for x in fill} | {"current_state": F.coalesce("current_state", F.lit("BENIGN")),
                                                              "peak_state": F.coalesce("peak_state", F.lit("BENIGN")), "window_count": n})
    return f.withColumn("contradiction_count", sum((k.cast("int") for k in contradiction_flags().values()), F.lit(0)).cast("bigint"))


def contradiction_flags(forecast: bool = True) -> dict[str, Column]:
    return {
        "CLEAN_SESSIONS": (c("successful_sessions") >= 15) & (c("failure_ratio") <= 0.05),
        "NARROW_SCANNER": c("roles").contains("SCANNER") & (c("targeted_ports_count") < 5) & (c("peer_count") < 3),
        "IRREGULAR_BEACON": F.coalesce(c("roles").contains("BEACON") & (c("max_beacon_cv") > 0.40), F.lit(False)),
        "INSUFFICIENT_HISTORY_FORECAST": F.lit(forecast) & (c("window_count") < 8),
        "UNSUPPORTED_TRANSITIONS": c("unsupported_transition_count") > 0}


CONTRADICTION_SEVERITY = {"CLEAN_SESSIONS": "MEDIUM", "NARROW_SCANNER": "HIGH", "IRREGULAR_BEACON": "HIGH",
                          "INSUFFICIENT_HISTORY_FORECAST": "MEDIUM", "UNSUPPORTED_TRANSITIONS": "HIGH"}


def _rows(facts: DataFrame, entries: Sequence[tuple[Column, dict[str, Column | str]]]) -> DataFrame:
    """Explode the entries whose condition holds into rows ``entity, <fields>``."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    arr = F.array_compact(F.array(*[F.when(cond, F.struct(*[lit(v).alias(k) for k, v in d.items()])) for cond, d in entries]))
    return facts.select("entity", F.explode(arr).alias("_x")).select("entity", "_x.*")


def contradictions(facts: DataFrame) -> DataFrame:
    return _rows(facts, [(cond, {"rule": n, "severity": CONTRADICTION_SEVERITY[n],
                                 "contradiction_id": stable_id("contra", c("entity"), F.lit(n))})
                         for n, cond in contradiction_flags().items()])


def risk_score(facts: DataFrame) -> DataFrame:
    """Additive threat score with its parts, priority level and the kinds of evidence behind it."""
    st, roles = c("current_state"), c("roles")
    state = choose((st == "IMPACT", 100), (st == "COMMAND_AND_CONTROL", 90), (st == "EXPLOITATION_INDICATOR", 80),
                   (st == "RECONNAISSANCE", 60), (st == "DISCOVERY", 40), (roles.contains("SCANNER"), 45), (roles.contains("BEACON"), 50),
                   (roles.contains("RESET_HEAVY"), 30), default=0)
    calm = (c("successful_sessions") > 15) & (c("failure_ratio") < 0.10) & ~st.isin("IMPACT", "COMMAND_AND_CONTROL")
    f = facts.withColumns({
        "state_contribution": state.cast("bigint"), "change_contribution": 25 * c("port_surges") + 20 * c("connection_surges"),
        "breadth_contribution": (F.when(c("peer_count") >= 10, 20).otherwise(0) + F.when(c("targeted_ports_count") >= 20, 20).otherwise(0)).cast("bigint"),
        "campaign_contribution": F.when(c("campaign_count") > 0, 15).otherwise(0).cast("bigint"),
        "mitigation_discount": F.when(calm, 30).otherwise(0).cast("bigint")})
    score = c("state_contribution") + c("change_contribution") + c("breadth_contribution") + c("campaign_contribution") - c("mitigation_discount")
    f = f.withColumn("score", score)
    return f.withColumn("priority_level", choose((c("score") >= 100, "P1_CRITICAL"), (c("score") >= 70, "P2_HIGH"), (c("score") >= 40, "P3_MEDIUM"),
                                                 (c("score") >= 20, "P4_LOW"), default="P5_INFORMATIONAL"))


def prioritize(scored: DataFrame) -> DataFrame:
    """Rank all entities by score, ties by name, without sorting them in one task."""
    return global_row_number(scored.select("entity", "score", "priority_level", "current_state", "campaign_id"), [F.desc("score"), F.asc("entity")],
                             "priority_rank")


def threat_contacts(states: DataFrame, ends: DataFrame) -> DataFrame:
    """``entity, kind, value``: every peer and port of the entities with an inferred state."""
    kind = lambda name, col: ends.select("entity", c(col)).distinct().select("entity", F.lit(name).alias("kind"), c(col).cast("string").alias("value"))
    met = kind("PEER", "peer").unionByName(kind("PORT", "dst_port")).filter("value IS NOT NULL")
    return met.join(states.select("entity").distinct(), "entity", "left_semi")


def threat_view(states: DataFrame, history: DataFrame, ends: DataFrame) -> DataFrame:
    """Entities with an inferred state: level, modalities, contradictions, numbers of peers and ports (``threat_contacts`` lists them)."""
    met = threat_contacts(states, ends).groupBy("entity").agg(count_when(c("kind") == "PEER").alias("peers"), count_when(c("kind") == "PORT").alias("ports"))
    odd = ends.groupBy("entity").agg(F.bool_and(c("dst_port").isin(80, 443, 53)).alias("_web"))
    j = (states.filter("entity <> 'network'").select("entity", "attack_state", "mitre_techniques").join(history, "entity", "left")
         .join(met, "entity", "left").join(odd, "entity", "left"))
    return j.select("entity", "attack_state", "mitre_techniques", "first_seen_window", "last_seen_window", "peers", "ports",
                    c("activity_count").alias("total_sessions"), "findings_count",
                    F.when(c("attack_state").isin("RECONNAISSANCE", "DENIAL_OF_SERVICE"), "HIGH").otherwise("LOW").alias("threat_level"),
                    tag_string((F.lit(True), "ML_DETECTION"), (c("activity_count") > 0, "TCP_SESSION"), (c("unique_ports") > 0, "FLOW_STATISTICS")).alias("modalities"),
                    (F.coalesce("_web", F.lit(True)) & (c("findings_count") <= 1)).alias("only_web_ports"))


def benign_hypotheses(facts: DataFrame) -> DataFrame:
    st, roles, ok, fr = c("current_state"), c("roles"), c("successful_sessions"), c("failure_ratio")
    sup = (ok > 0) | (c("targeted_ports_count") > 10)
    metronome = F.coalesce(c("min_beacon_cv") < 0.15, F.lit(False))
    return _rows(facts, [
        (roles.contains("SCANNER") | (st == "RECONNAISSANCE"), {"hypothesis_type": "ADMINISTRATIVE_SCAN", "resolution_state": choose(
            (sup & ~(fr > 0.80), "PARTIALLY_SUPPORTED"), (fr > 0.80, "SUPPORTED_THREAT"), default="UNRESOLVED")}),
        ((ok >= 20) & (fr <= 0.05), {"hypothesis_type": "LEGITIMATE_INFRASTRUCTURE", "resolution_state": choose(
            (st.isin("IMPACT", "COMMAND_AND_CONTROL"), "PARTIALLY_SUPPORTED"), default="SUPPORTED_BENIGN")}),
        (roles.contains("BEACON"), {"hypothesis_type": "SCHEDULED_POLLING", "resolution_state": choose(
            (metronome, "SUPPORTED_THREAT"), default="UNRESOLVED")})])


def threat_tier(facts: DataFrame, pattern_members: DataFrame, forecast_available: bool = False) -> DataFrame:
    """Ordered tiering by campaign, state, scan breadth, findings and forecast-only evidence."""
    pm = pattern_members.select("entity").distinct().withColumn("_pat", F.lit(True))
    f = facts.join(pm, "entity", "left")
    st = c("current_state")
    mods = (F.lit(1) + (c("findings_count") > 0).cast("int") + F.coalesce("_pat", F.lit(False)).cast("int")
            + (c("campaign_count") > 0).cast("int") + (c("total_transitions") > 0).cast("int"))
    strong = F.when(mods >= 2, "STRONGLY_SUPPORTED").otherwise("SUPPORTED")
    recon = (st == "RECONNAISSANCE") | c("roles").contains("SCANNER")
    broad = (c("targeted_ports_count") >= 5) | (c("peer_count") >= 3)
    odd = (c("findings_count") > 0) | c("roles").contains("RESET_HEAVY")
    fc = F.lit(forecast_available) & (c("findings_count") == 0) & (st == "BENIGN")
    rules = [((c("campaign_count") > 0) & ~st.isin("BENIGN", "DISCOVERY"), "CAMPAIGN_ACTIVITY", strong),
             (st.isin("IMPACT", "COMMAND_AND_CONTROL", "EXPLOITATION_INDICATOR"), "ACTIVE_ATTACK_INDICATOR", strong),
             (recon & broad, "SUPPORTED_RECONNAISSANCE", F.lit("DIRECTLY_OBSERVED")), (recon, "SUSPICIOUS_BEHAVIOR", F.lit("WEAKLY_SUPPORTED")),
             (odd, "SUSPICIOUS_BEHAVIOR", F.lit("SUPPORTED")), (fc, "FORECAST_ONLY", F.lit("FORECAST_ONLY")),
             (c("window_count") < 2, "INSUFFICIENT_EVIDENCE", F.lit("INSUFFICIENT_EVIDENCE"))]
    return f.select("entity", choose(*[(a, b) for a, b, _ in rules], default="NOISE").alias("semantic_tier"),
                    choose(*[(a, g) for a, _, g in rules], default="DIRECTLY_OBSERVED").alias("grounding_state"), mods.alias("modality_count"))


def investigation_value(facts: DataFrame) -> DataFrame:
    st = c("current_state")
    s = (25 * c("contradiction_count")
         + choose((st.isin("IMPACT", "COMMAND_AND_CONTROL"), 50), (st.isin("EXPLOITATION_INDICATOR", "RECONNAISSANCE"), 35), default=0)
         + F.when(c("campaign_count") > 0, 30).otherwise(0) + F.when((c("peer_count") >= 5) | (c("targeted_ports_count") >= 10), 20).otherwise(0)
         + F.least(F.lit(20), 5 * c("findings_count")) + F.when(c("window_count") < 8, 15).otherwise(0)).cast("bigint")
    return facts.select("entity", s.alias("investigation_value_score")).withColumn("value_tier", choose(
        (c("investigation_value_score") >= 80, "VERY_HIGH"), (c("investigation_value_score") >= 50, "HIGH"),
        (c("investigation_value_score") >= 25, "MODERATE"), default="LOW"))


def mitigations(facts: DataFrame) -> DataFrame:
    st, roles = c("current_state"), c("roles")
    wide = (c("targeted_ports_count") > 20) | (c("peer_count") > 5)
    return _rows(facts, [
        (st.isin("IMPACT", "COMMAND_AND_CONTROL", "EXPLOITATION_INDICATOR"), {"action_type": "PRIORITIZE_CONTAINMENT", "urgency": "CRITICAL"}),
        (roles.contains("SCANNER") | st.isin("RECONNAISSANCE", "DISCOVERY"),
         {"action_type": "REVIEW_EXPOSED_SERVICES", "urgency": F.when(wide, "HIGH").otherwise("MEDIUM")}),
        (roles.contains("BEACON"), {"action_type": "INSPECT_PERIODIC_RELATIONSHIP", "urgency": "HIGH"}),
        (roles.contains("RESET_HEAVY"), {"action_type": "INSPECT_RESET_PATTERNS", "urgency": "MEDIUM"}),
        (c("campaign_count") > 0, {"action_type": "INVESTIGATE_CAMPAIGN", "urgency": "HIGH"}),
        (c("window_count") < 8, {"action_type": "COLLECT_MORE_TELEMETRY", "urgency": "LOW"})])


def questions(facts: DataFrame, hypotheses: DataFrame) -> DataFrame:
    st = c("current_state")
    q = _rows(facts, [
        (c("roles").contains("SCANNER") | st.isin("RECONNAISSANCE", "DISCOVERY"), {"category": "AUTHORIZATION"}),
        (c("targeted_ports_count") > 0, {"category": "ATTACK_SURFACE"}), (c("window_count") < 8, {"category": "TEMPORAL_PERSISTENCE"}),
        (c("campaign_count") > 0, {"category": "CAMPAIGN_CORRELATION"})]).withColumn("detail", F.lit(""))
    return q.unionByName(hypotheses.select("entity", F.lit("BENIGN_DISPROVAL").alias("category"), c("hypothesis_type").alias("detail")))


def forecast_context(facts: DataFrame) -> DataFrame:
    return facts.select("entity", "current_state", "peak_state", c("active_windows_count").alias("state_duration_windows"), "trajectory_length",
                        "change_count", "campaign_id", tag_string((c("active_windows_count") < 3, "LIMITED_HISTORY"),
                                                                  (c("current_state") == "RECONNAISSANCE", "DOWNSTREAM_PROGRESSION")).alias("abstention_reasons"))


def what_changed(transitions: DataFrame, changes: DataFrame, deviations: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Union of state steps, behaviour changes, deviations and campaign joins, with significance."""
    cols = lambda df, dim, at, mag, sig, what: df.select(
        "entity", F.lit(dim).alias("change_dimension"), at.alias("window_after"), mag.cast("double").alias("magnitude"),
        sig.alias("significance"), what.alias("detail"))
    hot = c("to_state").isin("IMPACT", "COMMAND_AND_CONTROL")
    return (cols(transitions, "ATTACK_STATE", c("window_after"), c("strength"), F.when(hot, "CRITICAL").otherwise("HIGH"),
                 F.concat("from_state", F.lit(">"), "to_state"))
            .unionByName(cols(changes, "BEHAVIORAL_METRIC", c("bucket"), c("magnitude"),
                              F.when(c("change_type").contains("FANOUT") | (c("magnitude") > 5.0), "HIGH").otherwise("MEDIUM"), c("change_type")))
            .unionByName(cols(deviations, "STATISTICAL_BASELINE", c("bucket"), c("z_score"),
                              F.when(c("z_score") > 3.0, "HIGH").otherwise("MEDIUM"), c("metric_name")))
            .unionByName(cols(campaigns, "CAMPAIGN_MEMBERSHIP", c("start_window"), c("target_count"), F.lit("HIGH"), c("campaign_id"))))


def entity_timeline(profile: DataFrame, changes: DataFrame, deviations: DataFrame, findings: DataFrame, transitions: DataFrame,
                    patterns: DataFrame, campaigns: DataFrame, forecasts: DataFrame, seconds: int) -> DataFrame:
    """Union of eight kinds of event with time, scope and severity."""
    def ev(df, kind, at, sev, what, scope="OBSERVED"):
        return df.select("entity", F.lit(kind).alias("event_type"), at.cast("double").alias("timestamp"), sev.alias("severity"),
                         F.lit(scope).alias("scope"), what.cast("string").alias("detail"))
    hot = c("to_state").isin("IMPACT", "COMMAND_AND_CONTROL")
    t = lambda col: c(col) * float(seconds)
    out = ev(profile, "FIRST_SEEN", c("first_ts"), F.lit("INFO"), F.lit(""))
    for part in (ev(changes, "BEHAVIOR_CHANGE", t("bucket"), F.when(c("change_type").contains("FANOUT"), "HIGH").otherwise("MEDIUM"), c("change_type")),
                 ev(deviations, "BASELINE_DEVIATION", t("bucket"), F.when(c("z_score") > 3, "HIGH").otherwise("MEDIUM"), c("metric_name")),
                 ev(findings, "ANOMALY", t("bucket"), F.upper("severity"), c("attack_category")),
                 ev(transitions.filter("from_state <> to_state"), "KINEMATIC_TRANSITION", t("window_after"), F.when(hot, "CRITICAL").otherwise("HIGH"), c("to_state")),
                 ev(patterns, "PATTERN_START", t("start_window"), c("severity"), c("pattern_type")),
                 ev(campaigns, "CAMPAIGN_JOIN", t("start_window"), c("severity"), c("campaign_id")),
                 ev(forecasts, "FORECAST_GENERATED", c("at_ts"), F.lit("INFO"), c("horizon"), "FORECAST")):
        out = out.unionByName(part)
    return out.withColumn("event_id", stable_id("evt", c("entity"), c("event_type"), c("timestamp").cast("bigint"), c("detail")))


def relationships(ends: DataFrame, profile: DataFrame, campaign_members: DataFrame, beacons: DataFrame) -> DataFrame:
    """Per entity and peer the first rule that holds: SCANS / COMMUNICATES_WITH, SCANNED_BY, SHARES_CAMPAIGN, BEACON.

    ``campaign_members``: ``campaign_id, entity, role`` (PRIMARY or TARGET). Pairs are taken between the
    primary entity and its targets, one row per member.
    """
    scan = profile.select("entity", c("roles").contains("SCANNER").alias("_s"))
    pair = ends.groupBy("entity", "peer", "out").agg(F.sum("n").alias("weight")).filter("entity <> peer").join(scan, "entity", "left")
    s = F.coalesce("_s", F.lit(False))
    direct = pair.select("entity", "peer", F.when(c("out"), 1).otherwise(2).alias("rank"), "weight",
                         F.when(c("out") & s, "SCANS").when(~c("out") & s, "SCANNED_BY").otherwise("COMMUNICATES_WITH").alias("relationship_type"))
    head = campaign_members.filter("role = 'PRIMARY'").select("campaign_id", c("entity").alias("head"))
    tgt = campaign_members.filter("role = 'TARGET'").select("campaign_id", c("entity").alias("tail"))
    ct = head.join(tgt, "campaign_id").filter("head <> tail").groupBy("head", "tail").agg(F.count("*").alias("weight"))
    camp = ct.select(c("head").alias("entity"), c("tail").alias("peer"), F.lit(3).alias("rank"), "weight", F.lit("SHARES_CAMPAIGN").alias("relationship_type"))
    camp = camp.unionByName(ct.select(c("tail").alias("entity"), c("head").alias("peer"), F.lit(3).alias("rank"), "weight",
                                      F.lit("SHARES_CAMPAIGN").alias("relationship_type")))
    bc = beacons.filter("is_beaconing").groupBy(c("src_ip").alias("entity"), c("dst_ip").alias("peer")).agg(F.count("*").alias("weight")).select(
        "entity", "peer", F.lit(5).alias("rank"), "weight", F.lit("BEACON_RELATIONSHIP").alias("relationship_type"))
    allr = direct.unionByName(camp).unionByName(bc)
    # first rule per pair as a grouped minimum, which combines map-side
    return allr.groupBy("entity", "peer").agg(F.min_by(F.struct("relationship_type", "weight"), "rank").alias("_x")).select("entity", "peer", "_x.*")


def dossier(facts: DataFrame, scored: DataFrame, history: DataFrame, value: DataFrame, tier: DataFrame) -> DataFrame:
    """One row per entity joining what the other operators say about it."""
    return (facts.select("entity", "roles", "current_state", "peak_state", "mitre_techniques", "contradiction_count", "campaign_id")
            .join(scored.select("entity", "score", "priority_level"), "entity", "left")
            .join(history.select("entity", "activity_count", "unique_peers", "unique_ports", "findings_count"), "entity", "left")
            .join(value, "entity", "left").join(tier.select("entity", "semantic_tier", "grounding_state"), "entity", "left"))


def threat_story(facts: DataFrame, changes: DataFrame, transitions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Narrative stage rows of each entity: observation, changes, transitions, patterns, counter-evidence."""
    st = lambda df, stage, at, what, order: df.select("entity", F.lit(stage).alias("stage"), at.cast("bigint").alias("window"),
                                                      what.alias("detail"), F.lit(order).alias("stage_order"))
    clean = facts.filter((c("successful_sessions") > 20) & (c("failure_ratio") < 0.05))
    return (st(facts, "Initial Observation", c("first_seen_window"), c("roles"), 1)
            .unionByName(st(changes, "Behavioral Change", c("bucket"), c("change_type"), 2))
            .unionByName(st(transitions, "Kinematic Transition", c("window_after"), F.concat("from_state", F.lit(">"), "to_state"), 3))
            .unionByName(st(patterns, "Attack Pattern Manifestation", c("start_window"), c("pattern_type"), 4))
            .unionByName(st(clean, "Contradicting Evidence", c("first_seen_window"), F.lit("clean_sessions_baseline"), 5)))


def decisions(scored: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Every threat and campaign as a decision P0..P3, with its rank among those of its type."""
    t = global_row_number(scored.select("entity", "score", "current_state", "priority_level"), [F.desc("score"), F.asc("entity")], "decision_rank")
    st, lv = c("current_state"), c("priority_level")
    pr = choose((lv.contains("CRITICAL") | st.isin("IMPACT", "COMMAND_AND_CONTROL"), "P0_CRITICAL"),
                (lv.contains("HIGH") | st.isin("EXPLOITATION_INDICATOR", "RECONNAISSANCE"), "P1_HIGH"), (lv.contains("MEDIUM"), "P2_MEDIUM"),
                default="P3_LOW")
    a = t.select(F.lit("INVESTIGATE_ENTITY").alias("decision_type"), c("entity").alias("subject"), pr.alias("priority"), "decision_rank")
    k = global_row_number(campaigns.select("campaign_id", "start_window", "severity"), [F.asc("start_window"), F.asc("campaign_id")], "decision_rank").select(
        F.lit("INVESTIGATE_CAMPAIGN").alias("decision_type"), c("campaign_id").alias("subject"),
        F.when(c("severity") == "CRITICAL", "P1_HIGH").otherwise("P2_MEDIUM").alias("priority"), "decision_rank")
    return a.unionByName(k).withColumn("decision_id", stable_id("dec", c("subject"), c("priority")))


def incident_dossier(facts: DataFrame, patterns: DataFrame, pattern_targets: DataFrame, campaigns: DataFrame, campaign_members: DataFrame) -> DataFrame:
    """Per primary entity: targets, ports, states and techniques over its patterns and campaigns (set sizes and bounded sets)."""
    t = (patterns.select("entity", "pattern_id").join(pattern_targets, "pattern_id").select("entity", "target")
         .unionByName(campaigns.select("entity", "campaign_id").join(campaign_members.filter("role = 'TARGET'").select(
             "campaign_id", c("entity").alias("target")), "campaign_id").select("entity", "target"))).distinct()
    tg = t.groupBy("entity").agg(F.count("*").alias("target_count"))
    cs = campaigns.groupBy("entity").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("attack_states", ","))))), ",").alias("attack_states"),
                                         F.count("*").alias("campaigns"))
    ps = patterns.groupBy("entity").agg(F.count("*").alias("patterns"))
    z = F.lit(0).cast("bigint")
    return (facts.select("entity", "current_state", "mitre_techniques").join(tg, "entity", "left").join(cs, "entity", "left").join(ps, "entity", "left")
            .filter("campaigns IS NOT NULL OR patterns IS NOT NULL")
            .withColumns({"target_count": F.coalesce("target_count", z), "campaigns": F.coalesce("campaigns", z), "patterns": F.coalesce("patterns", z),
                          "attack_states": F.coalesce("attack_states", F.lit(""))}))


def stage_inference(evidence: DataFrame, key: str) -> DataFrame:
    """Stage per key ranked by summed supporting confidence; UNKNOWN when weak and nearly tied.

    ``evidence``: ``key, stage, source, confidence`` (supporting rows).
    """
    s = evidence.groupBy(key, "stage").agg(F.sum("confidence").alias("weight"), F.avg("confidence").alias("_avg"),
                                           F.max("confidence").alias("_max"), F.count_distinct("source").alias("_src"),
                                           F.bool_or(c("source").isin("PCAP", "ZEEK", "SURICATA")).alias("_obs"))
    w = W.partitionBy(key).orderBy(F.desc("weight"), "stage")  # one row per stage
    s = s.withColumns({"_r": F.row_number().over(w), "runner_weight": F.lead("weight").over(w)}).filter("_r = 1")
    vague = F.coalesce((c("weight") < 0.8) & (c("weight") - c("runner_weight") < 0.1), F.lit(False))
    mod = F.when(c("_src") >= 2, 1.10).otherwise(0.90)
    return s.select(key, F.when(vague, "UNKNOWN").otherwise(c("stage")).alias("primary_stage"), "weight", "runner_weight",
                    F.when(c("_obs"), "OBSERVED").otherwise("INFERRED").alias("classification"),
                    F.greatest(F.lit(0.10), F.least(F.lit(0.99), c("_avg") * mod)).alias("overall_confidence"), c("_avg").alias("stage_confidence"),
                    c("_max").alias("technique_confidence"))


def state_estimate(state: DataFrame, features: Sequence[str], stages: DataFrame) -> DataFrame:
    """Per window: feature map plus the threat distribution that follows from the stage distribution."""
    j = state.join(stages, "bucket", "left")
    get = lambda s: F.coalesce(F.try_element_at(c("stage_distribution"), F.lit(s)), F.lit(0.0))
    return j.select("bucket", F.map_filter(F.create_map(*[v for f in features for v in (F.lit(f), c(f).cast("double"))]),
                                           lambda k, v: v.isNotNull()).alias("network_features"),
                    get("RECONNAISSANCE").alias("scanning"), get("COMMAND_AND_CONTROL").alias("c2_beacon"),
                    get("IMPACT").alias("denial_of_service"), get("LATERAL_MOVEMENT").alias("lateral_movement"))
