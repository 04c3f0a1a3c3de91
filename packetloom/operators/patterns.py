"""Attack patterns, campaigns, incident correlation, stage transitions and technique lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.columns import choose, count_when, stable_id, tag_string
from packetloom.functions.ordered import segmented_lag
from packetloom.functions.spans import join_spans
from packetloom.operators.entities import targets_during
from packetloom.operators.graph import connected_components

W = Window
c = F.col


def _edges(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (src, dst, port) with the first and last window: what every scan rule counts."""
    return sessions.filter("src_ip IS NOT NULL AND dst_ip IS NOT NULL").groupBy(*keys, "src_ip", "dst_ip", "dst_port").agg(
        F.min("bucket").alias("start_window"), F.max("bucket").alias("end_window"))


def horizontal_scans(sessions: DataFrame, keys: Sequence[str] = (), min_hosts: int = 5, max_ports: float = 4.0) -> DataFrame:
    """Sources that touch many hosts on few ports each."""
    e = _edges(sessions, keys).groupBy(*keys, "src_ip", "dst_ip").agg(
        F.count_distinct("dst_port").alias("_p"), F.min("start_window").alias("start_window"), F.max("end_window").alias("end_window"))
    g = e.groupBy(*keys, "src_ip").agg(F.count("*").alias("target_count"), F.avg("_p").alias("avg_ports_per_target"),
                                       F.min("start_window").alias("start_window"), F.max("end_window").alias("end_window"))
    return g.filter((c("target_count") >= min_hosts) & (c("avg_ports_per_target") <= max_ports))


def vertical_scans(sessions: DataFrame, keys: Sequence[str] = (), min_ports: int = 10) -> DataFrame:
    g = _edges(sessions, keys).groupBy(*keys, "src_ip", "dst_ip").agg(
        F.count_distinct("dst_port").alias("port_count"), F.min("start_window").alias("start_window"), F.max("end_window").alias("end_window"))
    return g.filter(c("port_count") >= min_ports)


def distributed_scans(sessions: DataFrame, keys: Sequence[str] = (), min_sources: int = 5) -> DataFrame:
    g = _edges(sessions, keys).groupBy(*keys, "dst_ip").agg(
        F.count_distinct("src_ip").alias("source_count"), F.min("start_window").alias("start_window"), F.max("end_window").alias("end_window"))
    return g.filter(c("source_count") >= min_sources)


def beacon_cluster(beacons: DataFrame) -> DataFrame:
    """One row when at least two sources beacon."""
    return beacons.filter("is_beaconing").groupBy().agg(
        F.count("*").alias("beacon_count"), F.count_distinct("src_ip").alias("source_count"), F.count_distinct("dst_ip").alias("target_count")
    ).filter("source_count >= 2")


def volume_amplification(findings: DataFrame) -> DataFrame:
    return findings.filter(F.lower("attack_category").rlike("dos|flood")).select(
        "entity", "bucket", F.lit("CRITICAL").alias("severity"), stable_id("pat", c("entity"), F.lit("VOL_AMP"), c("bucket")).alias("pattern_id"))


def entity_patterns(sessions: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All pattern kinds as rows ``entity, pattern_type, start_window, end_window, severity, pattern_id``."""
    one = lambda df, ent, kind, sev: df.select(
        c(ent).alias("entity"), F.lit(kind).alias("pattern_type"), "start_window", "end_window", F.lit(sev).alias("severity"),
        stable_id("pat", c(ent), F.lit(kind), c("start_window")).alias("pattern_id"))
    v = volume_amplification(findings).select("entity", F.lit("VOLUME_AMPLIFICATION").alias("pattern_type"), c("bucket").alias("start_window"),
                                              c("bucket").alias("end_window"), "severity", "pattern_id")
    return (one(horizontal_scans(sessions, keys), "src_ip", "HORIZONTAL_SCAN", "HIGH")
            .unionByName(one(distributed_scans(sessions, keys), "dst_ip", "DISTRIBUTED_SCAN", "HIGH")).unionByName(v))


def campaigns(episodes: DataFrame, targets: DataFrame, gap: int = 3, seconds: int = 60) -> DataFrame:
    """Chain the episodes of an entity while they are close in time and share targets or ports (or neither has any).

    ``episodes``: ``entity, episode_id, start_window, end_window, severity, attack_state, mitre_techniques`` and the array
    ``destination_ports``. ``targets``: ``entity, episode_id, target``, rows however many: a target is shared with the episode
    before when it occurs in two consecutive ones.
    """
    w = W.partitionBy("entity").orderBy("start_window", "episode_id")
    x = episodes.withColumn("_nth", F.row_number().over(w))
    own = targets.join(x.select("entity", "episode_id", "_nth"), ["entity", "episode_id"]).select("entity", "target", "_nth").distinct()
    again = own.withColumn("_same", F.lag("_nth").over(W.partitionBy("entity", "target").orderBy("_nth")) == c("_nth") - 1)
    again = again.groupBy("entity", "_nth").agg(F.coalesce(F.bool_or("_same"), F.lit(False)).alias("_shares"))
    x = x.join(again, ["entity", "_nth"], "left").withColumn("_aims", c("_shares").isNotNull())
    prev = lambda n: F.lag(n).over(w)
    ports = F.coalesce("destination_ports", F.array())
    x = x.withColumn("_ports", ports).withColumns({"_pe": prev("end_window"), "_pa": prev("_aims"), "_pp": prev("_ports")})
    by_target = F.coalesce("_shares", F.lit(False)) | (~c("_aims") & ~c("_pa"))
    by_port = F.arrays_overlap("_ports", "_pp") | ((F.size("_ports") == 0) & (F.size("_pp") == 0))
    joined = (c("start_window") - c("_pe") <= gap) & (by_target | by_port)
    x = x.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = x.groupBy("entity", "_island").agg(
        F.min("start_window").alias("start_window"), F.max("end_window").alias("end_window"), F.count("*").alias("episode_count"),
        F.array_join(F.array_sort(F.collect_set("attack_state")), ",").alias("attack_states"),
        F.bool_or(c("severity") == "CRITICAL").alias("_c"), F.bool_or(c("severity") == "HIGH").alias("_h"),
        F.array_join(F.array_sort(F.collect_set(F.when(c("mitre_techniques") != "", c("mitre_techniques")))), ",").alias("mitre_techniques"))
    return g.select(stable_id("cmp", c("entity"), c("start_window"), c("end_window"), c("episode_count")).alias("campaign_id"), "entity",
                    "start_window", "end_window", ((c("end_window") - c("start_window") + 1) * float(seconds)).alias("duration_seconds"),
                    "episode_count", "attack_states", "mitre_techniques",
                    choose((c("_c"), "CRITICAL"), (c("_h"), "HIGH"), default="MEDIUM").alias("severity"))


def campaign_members(campaign_rows: DataFrame, ends: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(campaign, entity, role): the primary entity and the peers it contacted while the campaign ran; ``totals`` where they are at hand."""
    primary = campaign_rows.select("campaign_id", "entity", F.lit("PRIMARY").alias("role"))
    spans = campaign_rows.select("campaign_id", "entity", "start_window", "end_window")
    tgt = spans.join(targets_during(campaign_rows, ends, totals), ["entity", "start_window", "end_window"]).select("campaign_id", c("target").alias("entity"), F.lit("TARGET").alias("role"))
    return primary.unionByName(tgt)


def campaign_dossier(campaign_rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Campaign joined to its episodes; the action follows the severity."""
    e = campaign_rows.select("campaign_id", "entity", c("severity").alias("campaign_severity"), c("start_window").alias("_from"), c("end_window").alias("_to"))
    j = join_spans(episodes.drop("campaign_id", "campaign_severity"), e, ["entity"], "start_window", "_from", "_to")  # campaigns are runs of whole episodes, so its start places an episode
    return j.select("campaign_id", "entity", "episode_id", "start_window", "end_window", "finding_count",
                    choose((c("campaign_severity") == "CRITICAL", "ISOLATE"), (c("campaign_severity") == "HIGH", "INVESTIGATE"),
                           default="MONITOR").alias("action"))


# --- incidents ----------------------------------------------------------------------------------
def incident_members(sessions: DataFrame, incident: str, is_attack: Column) -> DataFrame:
    """Long form of every incident's sets: ``incident, kind, item`` with kind ACTOR, TARGET, PORT, PROTOCOL.

    Sets stay rows; an incident with millions of actors is never one array.
    """
    base = sessions.withColumn("_atk", is_attack)
    kinds = F.array(F.when(c("_atk"), F.struct(F.lit("ACTOR").alias("kind"), c("src_ip").alias("item"))),
                    F.when(c("_atk"), F.struct(F.lit("TARGET").alias("kind"), c("dst_ip").alias("item"))),
                    F.when(c("_atk"), F.struct(F.lit("PORT").alias("kind"), c("dst_port").cast("string").alias("item"))),
                    F.struct(F.lit("PROTOCOL").alias("kind"), c("protocol").alias("item")))
    return base.select(incident, F.explode(F.array_compact(kinds)).alias("_x")).select(incident, "_x.*").distinct()


def incident_fingerprint(sessions: DataFrame, incident: str, is_attack: Column, failed: Column, members: DataFrame | None = None) -> DataFrame:
    """Set sizes, ratios, dominant category and the bounded protocol set of each incident; ``members`` where they are at hand."""
    m = (incident_members(sessions, incident, is_attack) if members is None else members).groupBy(incident).agg(
        count_when(c("kind") == "ACTOR").alias("actor_count"), count_when(c("kind") == "TARGET").alias("target_count"),
        count_when(c("kind") == "PORT").alias("port_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(c("kind") == "PROTOCOL", c("item")))), ",").alias("protocols"))
    s = sessions.groupBy(incident).agg(F.count("*").alias("total_sessions"), count_when(failed).alias("_failed"),
                                       F.min("bucket").alias("first_window"), F.max("bucket").alias("last_window"))
    return m.join(s, incident).withColumns({
        "failure_ratio": c("_failed") / c("total_sessions"), "fan_out_ratio": c("target_count") / F.greatest(F.lit(1), c("actor_count")),
        "attack_state": F.when(c("actor_count") > 0, "RECONNAISSANCE").otherwise("BENIGN"),
        "dominant_category": F.when(c("actor_count") > 0, "NETWORK_RECONNAISSANCE").otherwise("SUSPICIOUS_TRAFFIC")}).drop("_failed")


def incident_links(fingerprints: DataFrame, members: DataFrame, incident: str, every: bool = False) -> DataFrame:
    """Links ``incident_a, incident_b`` of incidents that share an actor or a target, with relation and evolution; with ``every`` all such pairs.

    Without ``every`` each incident is linked to the representative (the smallest incident) of each item it shares, for components only.
    A shared item is then a star, so rows grow with memberships: a gateway seen by 100,000 incidents is 99,999 links, not five billion
    pairs. ``shared_actors`` and ``shared_targets`` count the stars that the representative leads and the incident is in;
    relation and evolution are those of the two. Items come from attack sessions, and incidents that have some are all in the
    same attack state, so all members of a star are related to its representative and to each other: components over links
    equal components over pairs.
    """
    if every:
        return incident_correlate(fingerprints, members, incident)
    k = members.filter(c("kind").isin("ACTOR", "TARGET"))
    lead = k.groupBy("kind", "item").agg(F.min(incident).alias("incident_a"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    p = k.withColumnRenamed(incident, "incident_b").join(lead, ["kind", "item"]).filter("incident_a <> incident_b")
    return _relations(p.groupBy("incident_a", "incident_b").agg(*_shared()), fingerprints, members, incident)


#: Incidents of a shared item are paired in blocks of about so many, so that a gateway's pairs are dealt to many tasks.
PAIR_BLOCK = 512


def _block_rows(k: DataFrame, incident: str) -> tuple[DataFrame, DataFrame]:
    """Both sides ``kind, item, _i, _j`` with ``_x`` and ``_y``: the incidents of a shared item in blocks, each block once for every block that it meets."""
    size = k.groupBy("kind", "item").agg(F.count("*").alias("_n")).filter("_n > 1").select("kind", "item", F.ceil(c("_n") / PAIR_BLOCK).cast("int").alias("_blocks"))
    x = k.join(size, ["kind", "item"]).withColumn("_at", F.pmod(F.xxhash64(incident), c("_blocks")).cast("int"))
    one = x.select("kind", "item", c(incident).alias("_x"), c("_at").alias("_i"), F.explode(F.sequence("_at", c("_blocks") - 1)).alias("_j"))
    two = x.select("kind", "item", c(incident).alias("_y"), F.explode(F.sequence(F.lit(0), "_at")).alias("_i"), c("_at").alias("_j"))
    return one, two


def _pairs(k: DataFrame, incident: str) -> DataFrame:
    """``kind, item, incident_a, incident_b`` for all pairs of incidents that share an item; a task holds pairs of blocks, never an item."""
    one, two = _block_rows(k, incident)
    p = one.join(two, ["kind", "item", "_i", "_j"]).filter((c("_x") != c("_y")) & ((c("_i") < c("_j")) | (c("_x") < c("_y"))))
    return p.select("kind", "item", F.least("_x", "_y").alias("incident_a"), F.greatest("_x", "_y").alias("incident_b"))


def _shared() -> list[Column]:
    return [count_when(c("kind") == "ACTOR").alias("shared_actors"), count_when(c("kind") == "TARGET").alias("shared_targets")]


def incident_correlate(fingerprints: DataFrame, members: DataFrame, incident: str, named: DataFrame | None = None) -> DataFrame:
    """Related incident pairs that share an actor or a target, with relation and evolution; with ``named`` (a column ``incident``) those with a named incident.

    Candidate pairs come from the keys that identify infrastructure (actors and targets); the dimensions
    that nearly everyone shares (ports, protocols, states) are compared on the pair's fingerprints, so
    they never generate pairs. Shared items are counted per pair before the fingerprints are joined. Without ``named`` the
    result has all pairs of every shared item, made in blocks; ``incident_links`` can give components in rows that grow with memberships.
    """
    k = members.filter(c("kind").isin("ACTOR", "TARGET"))
    if named is None:
        p = _pairs(k, incident)
    else:
        some = k.join(named.select(incident).distinct(), incident, "left_semi")
        p = some.withColumnRenamed(incident, "_x").join(k.withColumnRenamed(incident, "_y"), ["kind", "item"]).filter("_x <> _y")
        p = p.select("kind", "item", F.least("_x", "_y").alias("incident_a"), F.greatest("_x", "_y").alias("incident_b")).distinct()  # two named incidents meet from both sides
    return _relations(p.groupBy("incident_a", "incident_b").agg(*_shared()), fingerprints, members, incident)


def _relations(p: DataFrame, fingerprints: DataFrame, members: DataFrame, incident: str) -> DataFrame:
    """Relation and evolution of pairs ``incident_a, incident_b, shared_actors, shared_targets``."""
    ports = members.filter("kind = 'PORT'").groupBy(incident).agg(F.collect_set("item").alias("_ports"))  # at most 65,536 ports
    f = fingerprints.join(ports, incident, "left").withColumn("_ports", F.coalesce("_ports", F.array().cast("array<string>")))
    cols = ("target_count", "protocols", "failure_ratio", "attack_state", "dominant_category", "_ports")
    side = lambda s: f.select(c(incident).alias(f"incident_{s}"), *[c(n).alias(f"{n}_{s}") for n in cols])
    x = p.join(side("a"), "incident_a").join(side("b"), "incident_b")
    scan = (c("attack_state_a") == c("attack_state_b")) & (c("attack_state_a") != "BENIGN")
    dims = tag_string(
        (c("shared_actors") > 0, "ENTITY_OVERLAP"), (c("shared_targets") > 0, "TARGET_OVERLAP"),
        (F.arrays_overlap("_ports_a", "_ports_b"), "PORT_PATTERN_SIMILARITY"),
        ((c("failure_ratio_a") > 0.70) & (c("failure_ratio_b") > 0.70), "SCAN_DYNAMICS_SIMILARITY"), (scan, "ATTACK_STATE_SIMILARITY"),
        (scan, "MITRE_TECHNIQUE_OVERLAP"))
    contra = (~F.arrays_overlap(F.split("protocols_a", ","), F.split("protocols_b", ","))).cast("int") + (
        (c("dominant_category_a") != c("dominant_category_b")) & ~scan & (c("shared_targets") == 0)).cast("int")
    x = x.withColumns({"supporting_dimensions": dims, "_contra": contra, "_n": F.when(dims == "", 0).otherwise(F.size(F.split(dims, ",")))})
    ent = c("shared_actors") > 0
    rel = choose((c("_contra") >= 2, "UNRELATED"), ((c("_n") >= 3) | (ent & (c("_n") >= 2)), "RELATED_CAMPAIGN"),
                 (c("_n") >= 1, "POSSIBLY_RELATED"), default="UNRELATED")
    x = x.withColumn("relationship", rel)
    evo = choose((c("relationship") == "POSSIBLY_RELATED", "RECURRING_PATTERN"), (c("relationship") == "UNRELATED", "UNCERTAIN_EVOLUTION"),
                 (~ent & c("supporting_dimensions").contains("PORT_PATTERN"), "CHANGING_INFRASTRUCTURE"),
                 ((c("shared_targets") > 0) & (c("target_count_b") > c("target_count_a")), "EXPANDING_TARGET_SCOPE"),
                 (scan & (c("attack_state_a") == "RECONNAISSANCE"), "REPEATED_RECONNAISSANCE"), default="RECURRING_PATTERN")
    return x.select("incident_a", "incident_b", "shared_actors", "shared_targets", "supporting_dimensions", "relationship", evo.alias("evolution"))


def campaign_clusters(correlations: DataFrame, fingerprints: DataFrame, incident: str) -> DataFrame:
    """Components over RELATED_CAMPAIGN pairs with more than one member, with size and time span."""
    pairs = correlations.filter("relationship = 'RELATED_CAMPAIGN'").select(c("incident_a").alias("src_ip"), c("incident_b").alias("dst_ip"))
    comp = connected_components(pairs)
    j = comp.join(fingerprints, comp.node == fingerprints[incident])
    g = j.groupBy("component").agg(F.count("*").alias("members"), F.min("first_window").alias("first_window"), F.max("last_window").alias("last_window"),
                                   F.sum("actor_count").alias("actor_rows"), F.sum("target_count").alias("target_rows"))
    return g.filter("members > 1").withColumn("cluster_id", stable_id("cluster", c("component")))


def incident_story(events: DataFrame, incident: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events in order, phases with span, actors with their rank) of each incident.

    ``events``: ``incident, entity, event_type, bucket, severity, phase``.
    """
    ordered = events.withColumn("event_id", stable_id("evt", c(incident), c("entity"), c("event_type"), c("bucket")))
    phases = events.groupBy(incident, "phase").agg(F.min("bucket").alias("start_window"), F.max("bucket").alias("end_window"), F.count("*").alias("events"))
    act = events.groupBy(incident, "entity").agg(F.count("*").alias("events"))
    w = W.partitionBy(incident).orderBy(F.desc("events"), "entity")
    return ordered, phases, act.withColumn("rank", F.row_number().over(w))


def compare_runs(a: DataFrame, b: DataFrame, horizons_a: DataFrame, horizons_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, per-horizon deltas) of two analyses.

    ``a``/``b``: one row ``threat_level, risk_score, packets, flows``; horizons: ``horizon, p, stage``.
    """
    z = lambda n: F.coalesce(c(n), F.lit(0.0))
    s = lambda n: F.coalesce(c(n), F.lit("NORMAL"))
    h = horizons_a.select("horizon", c("p").alias("p_a"), c("stage").alias("stage_a")).join(
        horizons_b.select("horizon", c("p").alias("p_b"), c("stage").alias("stage_b")), "horizon", "full_outer").select(
        "horizon", z("p_a").alias("p_a"), z("p_b").alias("p_b"), (z("p_b") - z("p_a")).alias("delta_p"), s("stage_a").alias("stage_a"),
        s("stage_b").alias("stage_b"), (s("stage_a") != s("stage_b")).alias("stage_changed"))
    changed = h.agg(F.bool_or("stage_changed").alias("x")).scalar()
    pre = lambda df, t: df.select(F.lit(1).alias("_k"), *[c(n).alias(f"{n}_{t}") for n in ("threat_level", "risk_score", "packets", "flows")])
    j = pre(a, "a").join(pre(b, "b"), "_k").drop("_k")
    d = c("risk_score_b") - c("risk_score_a")
    rel = lambda n: F.when(c(f"{n}_a") > 0, (c(f"{n}_b") - c(f"{n}_a")) / c(f"{n}_a"))
    shift = lambda n: F.when(F.abs(rel(n)) > 0.2, F.when(rel(n) > 0, "INCREASE").otherwise("DECREASE")).otherwise("NONE")
    up = (F.upper("threat_level_a") != F.upper("threat_level_b")) & F.upper("threat_level_b").isin("HIGH", "CRITICAL")
    return j.withColumns({
        "delta_risk": d, "verdict": choose(((d > 15.0) | up, "ESCALATION"), (d < -15.0, "DE_ESCALATION"), (changed, "DIVERGENT"), default="EQUILIBRIUM"),
        "packet_shift": shift("packets"), "flow_shift": shift("flows")}), h


def network_rollup(ends: DataFrame, episodes: DataFrame, states: DataFrame, facts: DataFrame) -> DataFrame:
    """Capture-level counts in one row."""
    one = lambda df, *a: df.agg(*a).withColumn("_k", F.lit(1))
    e = one(ends, F.count_distinct("entity").alias("active_entity_count"), F.count_distinct("bucket").alias("total_windows"), F.sum("n").alias("session_ends"))
    p = one(episodes, F.count("*").alias("episodes"), count_when(c("severity") == "HIGH").alias("high_episodes"))
    s = one(states, count_when(c("attack_state") == "RECONNAISSANCE").alias("recon_entities"), count_when(c("attack_state") == "DENIAL_OF_SERVICE").alias("dos_entities"))
    f = one(facts, F.sum("contradiction_count").alias("contradictions"), count_when(c("campaign_count") > 0).alias("entities_in_campaigns"))
    return e.join(p, "_k").join(s, "_k").join(f, "_k").drop("_k")


# --- stages and techniques ------------------------------------------------------------------------
# The stages in life-cycle order.
STAGES = ("BENIGN", "RECONNAISSANCE", "RESOURCE_DEVELOPMENT", "INITIAL_ACCESS", "EXECUTION", "PERSISTENCE", "PRIVILEGE_ESCALATION",
          "DEFENSE_EVASION", "CREDENTIAL_ACCESS", "DISCOVERY", "LATERAL_MOVEMENT", "COLLECTION", "COMMAND_AND_CONTROL", "EXFILTRATION", "IMPACT")


def transition_rule(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(semantics, needs direct evidence, confidence modifier) of a stage step, as a rule over ordinals."""
    lookup = F.create_map(*[F.lit(v) for i, s in enumerate(STAGES) for v in (s, i)])
    i, j = lookup[a], lookup[b]
    back_ok = a.isin("LATERAL_MOVEMENT", "COMMAND_AND_CONTROL") & b.isin("DISCOVERY", "CREDENTIAL_ACCESS")
    rules = [(a == b, "EXPECTED", False, 1.0), (b == "BENIGN", "POSSIBLE", False, 0.85),
             ((a == "BENIGN") & b.isin("RECONNAISSANCE", "RESOURCE_DEVELOPMENT"), "EXPECTED", True, 0.90),
             ((a == "BENIGN") & (b == "INITIAL_ACCESS"), "POSSIBLE", True, 0.80), ((a == "BENIGN") & (b == "IMPACT"), "POSSIBLE", True, 0.85),
             (a == "BENIGN", "UNUSUAL", True, 0.55), (j == i + 1, "EXPECTED", False, 0.95), (j > i, "POSSIBLE", True, 0.80),
             (back_ok, "POSSIBLE", True, 0.75), (j < i, "UNUSUAL", True, 0.60)]
    return tuple(choose(*[(r[0], r[k]) for r in rules]) for k in (1, 2, 3))


def transition_validate(steps: DataFrame, base_confidence: float = 0.70) -> DataFrame:
    """Status and confidence of ``from_stage -> to_stage`` given ``supporting``, ``contradicting`` and ``sources`` counts."""
    a, b, s, k, n = c("from_stage"), c("to_stage"), c("supporting"), c("contradicting"), c("sources")
    sem, need, mod = transition_rule(a, b)
    unknown = a.isNull() | b.isNull() | ~a.isin(*STAGES) | ~b.isin(*STAGES)
    agree = choose((n == 0, 0.5), ((s > 0) & (k > 0), 0.45), ((n >= 2) & (s > 0), 1.10), (s > 0, 0.90), default=0.50)
    base = F.lit(float(base_confidence))
    status = choose((unknown, "INSUFFICIENT_EVIDENCE"), ((a == b) & (k > 0), "CONTRADICTORY"), (a == b, "VALID"), (k > s, "CONTRADICTORY"),
                    (need & (s == 0), "INSUFFICIENT_EVIDENCE"), (sem == "UNUSUAL", "VALID_BUT_UNUSUAL"), default="VALID")
    conf = choose((unknown, 0.20), ((a == b) & (k > 0), base * 0.5), (a == b, base), (k > s, F.greatest(F.lit(0.05), base * 0.35)),
                  (need & (s == 0), F.greatest(F.lit(0.05), base * 0.25)), default=F.least(F.lit(0.99), F.greatest(F.lit(0.05), base * mod * agree)))
    return steps.withColumns({"semantics": F.when(~unknown, sem), "status": status, "confidence": conf})


def timeline_audit(events: DataFrame, order: str, segment_rows: int = 65536) -> DataFrame:
    """Out-of-order rows, confidences outside [0, 1], and BENIGN beside an attack stage at one time, per ``story``."""
    x = events.withColumn("_seg", F.floor(c(order) / segment_rows))
    x = segmented_lag(x, ["story"], "_seg", [order], {"_p": "timestamp"})
    a = x.groupBy("story").agg(F.count("*").alias("events"), count_when(c("timestamp") < c("_p")).alias("out_of_order"),
                               count_when((c("confidence") < 0) | (c("confidence") > 1)).alias("bad_confidence"))
    t = events.groupBy("story", "timestamp").agg(F.bool_or(c("stage") == "BENIGN").alias("b"), F.bool_or(c("stage") != "BENIGN").alias("o"))
    k = t.groupBy("story").agg(count_when(c("b") & c("o")).alias("contradictory_times"))
    return a.join(k, "story").withColumn("valid", (c("out_of_order") + c("bad_confidence") + c("contradictory_times")) == 0)


# Technique -> (tactic, first stage, second stage).
TECHNIQUES = {
    "T1046": ("TA0043", "RECONNAISSANCE", "DISCOVERY"), "T1190": ("TA0001", "INITIAL_ACCESS", "EXECUTION"),
    "T1071": ("TA0011", "COMMAND_AND_CONTROL", "EXFILTRATION"), "T1498": ("TA0040", "IMPACT", "UNKNOWN"),
    "T1021": ("TA0008", "LATERAL_MOVEMENT", "INITIAL_ACCESS"), "T1041": ("TA0010", "EXFILTRATION", "COMMAND_AND_CONTROL"),
    "T1059": ("TA0002", "EXECUTION", "INITIAL_ACCESS"), "T1078": ("TA0001", "INITIAL_ACCESS", "PERSISTENCE"),
    "T1110": ("TA0006", "CREDENTIAL_ACCESS", "INITIAL_ACCESS"), "T1005": ("TA0009", "COLLECTION", "DISCOVERY"),
    "T1566": ("TA0001", "INITIAL_ACCESS", "EXECUTION"), "T1583": ("TA0042", "RESOURCE_DEVELOPMENT", "RECONNAISSANCE")}
# Stage -> legacy state name.
LEGACY_STATE = {
    "BENIGN": "BENIGN_OBSERVATION", "RECONNAISSANCE": "RECONNAISSANCE", "RESOURCE_DEVELOPMENT": "RECONNAISSANCE", "INITIAL_ACCESS": "EXPLOITATION",
    "EXECUTION": "EXPLOITATION", "PERSISTENCE": "COMMAND_AND_CONTROL", "PRIVILEGE_ESCALATION": "EXPLOITATION", "DEFENSE_EVASION": "COMMAND_AND_CONTROL",
    "CREDENTIAL_ACCESS": "EXPLOITATION", "DISCOVERY": "RECONNAISSANCE", "LATERAL_MOVEMENT": "LATERAL_MOVEMENT", "COLLECTION": "EXFILTRATION",
    "COMMAND_AND_CONTROL": "COMMAND_AND_CONTROL", "EXFILTRATION": "EXFILTRATION", "IMPACT": "DENIAL_OF_SERVICE"}


def technique_lookup(df: DataFrame, technique: str) -> DataFrame:
    """Syntax check and catalogue join of a technique id (upper-cased, trimmed)."""
    t = F.upper(F.trim(c(technique)))
    rows = [(k, *v) for k, v in TECHNIQUES.items()]
    cat = df.sparkSession.createDataFrame(rows, "_t string, tactic string, primary_stage string, secondary_stage string")
    j = df.withColumn("_t", t).join(F.broadcast(cat), "_t", "left")
    legacy = F.create_map(*[F.lit(x) for kv in LEGACY_STATE.items() for x in kv])
    ok = F.coalesce(c("_t").rlike(r"^T\d{4}(\.\d{3})?$"), F.lit(False))
    return j.withColumns({"well_formed": ok, "is_valid": ok & c("tactic").isNotNull(),
                          "legacy_state": F.coalesce(legacy[c("primary_stage")], F.lit("UNKNOWN_STATE"))}).drop("_t")
