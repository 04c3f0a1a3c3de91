"""Episodes, leakage-safe cases and splits, baseline forecasts, trajectories and policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.columns import choose, clip, count_when, r, tag_string
from packetloom.functions.ordered import global_row_number

W = Window
c = F.col
LOOKBACK = 8
HORIZONS = (1, 2, 3, 4, 5)


def contiguous_episodes(windows: DataFrame, step: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Number runs of windows whose ``bucket`` grows by exactly ``step`` (one row per window)."""
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("bucket")
    new = F.coalesce((c("bucket") - F.lag("bucket").over(w) != step).cast("bigint"), F.lit(0))
    return windows.withColumn("_n", new).withColumn("episode_id", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_n")


def episode_stats(ep: DataFrame, min_length: int = LOOKBACK + max(HORIZONS), seconds: int = 60) -> DataFrame:
    g = ep.groupBy("episode_id").agg(
        F.min("bucket").alias("start_bucket"), F.max("bucket").alias("end_bucket"), F.count("*").alias("windows"),
        count_when(c("attack_state") == 1).alias("attack_windows"), count_when(c("attack_state") == 0).alias("benign_windows"),
        count_when(c("attack_state").isNull()).alias("unknown_windows"))
    w = W.partitionBy(F.lit(0)).orderBy("episode_id")
    return g.withColumns({
        "has_both_classes": (c("attack_windows") > 0) & (c("benign_windows") > 0),
        "eligible_cases": F.greatest(F.lit(0), c("windows") - min_length + 1),
        "prior_gap_seconds": F.coalesce((c("start_bucket") - F.lag("end_bucket").over(w)) * seconds, F.lit(0))})


def forecast_cases(ep: DataFrame, lookback: int = LOOKBACK, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Cases with a full history and a known label at every horizon, all inside one episode."""
    w = W.partitionBy("episode_id").orderBy("bucket")
    h = w.rowsBetween(-(lookback - 1), 0)
    x = ep.withColumns({"history": F.collect_list("attack_state").over(h), "_hs": F.min("bucket").over(h), "target_bucket": F.lead("bucket", 1).over(w),
                        **{f"y{k}": F.lead("attack_state", k).over(w) for k in horizons}})
    x = x.filter(F.size("history") == lookback)
    for k in horizons:
        x = x.filter(c(f"y{k}").isNotNull())
    return x.withColumnRenamed("_hs", "history_start").withColumnRenamed("bucket", "source_bucket")


def onset_events(ep: DataFrame) -> DataFrame:
    """0 -> 1 changes with the length of the quiet run before and of the attack run after; teardowns are 1 -> 0."""
    w = W.partitionBy("episode_id").orderBy("bucket")
    x = ep.withColumns({"_p": F.lag("attack_state").over(w), "_i": F.row_number().over(w)})
    x = x.withColumn("_run", F.sum(F.coalesce((c("attack_state") != c("_p")).cast("bigint"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = x.groupBy("episode_id", "_run").agg(F.min("bucket").alias("bucket"), F.count("*").alias("run_length"), F.min("_i").alias("_i"),
                                               F.min("attack_state").alias("attack_state"), F.min_by("_p", "bucket").alias("_p"))
    rw = W.partitionBy("episode_id").orderBy("_run")
    runs = runs.withColumn("pre_run", F.lag("run_length").over(rw))
    return runs.filter("_p IS NOT NULL").select(
        "episode_id", "bucket", F.when(c("attack_state") == 1, "ONSET").otherwise("TEARDOWN").alias("event"), "run_length", "pre_run",
        (c("_i") - 1).alias("rows_before"))


def chronological_split(rows: DataFrame, order: Sequence, train: float = 0.70, val: float = 0.15, holdout: Column | None = None) -> DataFrame:
    """train / val / test by position (``int(n * ratio)``); held-out families are set apart before counting."""
    held = rows.filter(holdout).withColumns({"position": F.lit(None).cast("bigint"), "split": F.lit("holdout_test")}) if holdout is not None else None
    free = rows.filter(~holdout) if holdout is not None else rows
    n = free.agg(F.count("*").alias("n")).scalar()
    x = global_row_number(free, order, "position").withColumn("position", c("position") - 1)
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    x = x.withColumn("split", F.when(c("position") < a, "train").when(c("position") < b, "val").otherwise("test"))
    return x.unionByName(held) if held is not None else x


def embargo(split: DataFrame, ts: str, seconds: float) -> DataFrame:
    """Drop validation and test rows that fall within ``seconds`` of the rows kept before them."""
    last_train = split.filter("split = 'train'").agg(F.max(ts).alias("m")).scalar()
    kept = split.filter((c("split") != "val") | (c(ts) > last_train + seconds))
    last_val = kept.filter("split = 'val'").agg(F.max(ts).alias("m")).scalar()
    return kept.filter((c("split") != "test") | (c(ts) > F.coalesce(last_val, last_train) + seconds))


def embargo_steps(split: DataFrame, steps: int) -> DataFrame:
    """Drop the first ``steps`` rows of validation and of test."""
    first = split.groupBy("split").agg(F.min("position").alias("_f"))
    return split.join(F.broadcast(first), "split").filter(
        ~c("split").isin("val", "test") | (c("position") >= c("_f") + steps)).drop("_f")


def split_audit(split: DataFrame, ts: str, gap: float = 0.0) -> DataFrame:
    """One row of assertions: train < val < test and gaps at least the embargo."""
    m = lambda s, fn: fn(F.when(c("split") == s, c(ts)))
    g = split.groupBy().agg(m("train", F.max).alias("train_max"), m("val", F.min).alias("val_min"), m("val", F.max).alias("val_max"),
                            m("test", F.min).alias("test_min"))
    return g.withColumns({"train_before_val": c("train_max") < c("val_min"), "val_before_test": c("val_max") < c("test_min"),
                          "embargo_respected": (c("val_min") - c("train_max") >= gap) & (c("test_min") - c("val_max") >= gap)})


def window_leakage(cases: DataFrame, step: int = 1, lookback: int = LOOKBACK) -> DataFrame:
    """Counts of cases whose history is not contiguous or reaches past its first target."""
    return cases.agg(F.count("*").alias("cases"), count_when(c("source_bucket") - c("history_start") != step * (lookback - 1)).alias("broken_history"),
                     count_when(c("source_bucket") >= c("target_bucket")).alias("future_in_history"))


def episode_split(ep: DataFrame, train_share: float | None = None) -> DataFrame:
    """Whole episodes to splits: first to train, second to val, rest to test (or by share of episodes)."""
    x = ep.withColumn("_r", c("episode_id"))
    if train_share is None:
        return x.withColumn("split", F.when(c("_r") == 0, "train").when(c("_r") == 1, "val").otherwise("test")).drop("_r")
    n = ep.agg(F.max("episode_id").alias("m")).scalar() + 1
    return x.withColumn("split", F.when(c("_r") < F.floor(n * F.lit(train_share)), "train").otherwise("test")).drop("_r")


def event_split(events: DataFrame, key: str, val_ids: Sequence, test_ids: Sequence) -> DataFrame:
    return events.withColumn("split", F.when(c(key).isin(*test_ids), "test").when(c(key).isin(*val_ids), "val").otherwise("train"))


def mixed_run_split(ep: DataFrame, share: float = 0.8) -> DataFrame:
    """The first episode holding both classes, cut at ``share`` of its length."""
    mixed = ep.groupBy("episode_id").agg(F.count_distinct("attack_state").alias("_k"), F.count("*").alias("_n")).filter("_k > 1")
    first = mixed.agg(F.min("episode_id").alias("e")).scalar()
    x = ep.filter(c("episode_id") == first)
    w = W.partitionBy("episode_id").orderBy("bucket")
    n = F.count("*").over(W.partitionBy("episode_id"))
    return x.withColumn("split", F.when(F.row_number().over(w) <= F.floor(n * F.lit(share)), "train").otherwise("test"))


def horizons_of(cases: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Long form: one row per (case, horizon) with its target."""
    arr = F.array(*[F.struct(F.lit(k).alias("horizon"), c(f"y{k}").alias("target")) for k in horizons])
    return cases.select("episode_id", "source_bucket", c("attack_state").alias("current"), F.explode(arr).alias("_x")).select(
        "episode_id", "source_bucket", "current", "_x.*")


def persistence(points: DataFrame) -> DataFrame:
    return points.withColumns({"model": F.lit("persistence"), "p": c("current").cast("double")})


def majority(points: DataFrame, training: DataFrame) -> DataFrame:
    rate = training.agg(F.avg(c("attack_state").cast("double")).alias("p")).scalar()
    return points.withColumns({"model": F.lit("majority"), "p": rate})


def markov(points: DataFrame, training: DataFrame) -> DataFrame:
    """Laplace-smoothed two-state chain; the k-step probability in closed form pi + (p0 - pi) * lambda^k."""
    w = W.partitionBy("episode_id").orderBy("bucket")
    t = training.withColumn("_p", F.lag("attack_state").over(w))
    n = lambda a, b: (count_when((c("_p") == a) & (c("attack_state") == b)) + 1).cast("double")
    m = t.agg(F.struct((n(0, 1) / (n(0, 0) + n(0, 1))).alias("up"), (n(1, 1) / (n(1, 0) + n(1, 1))).alias("stay")).alias("m")).scalar()
    x = points.withColumn("_m", m)
    lam = c("_m.stay") - c("_m.up")
    pi = c("_m.up") / (1.0 - lam)
    return x.withColumns({"model": F.lit("markov"), "p": pi + (c("current") - pi) * F.pow(lam, c("horizon"))}).drop("_m")


def heuristic_baseline(state: DataFrame, horizons: Sequence[int] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Step probability from SYN share and port diversity, with 1 - (1 - p)^h as cumulative risk."""
    syn = c("syn_count") / F.greatest(F.lit(1.0), c("total_packets").cast("double"))
    div = c("unique_dst_ports") / F.greatest(F.lit(1.0), c("flow_count").cast("double"))
    p = r(F.least(F.lit(0.95), F.greatest(F.lit(0.05), syn * 0.5 + div * 0.4)), 4)
    x = state.withColumn("p", p).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return x.withColumn("cumulative_risk", r(1.0 - F.pow(1.0 - c("p"), c("horizon")), 4))


def cumulative_risk(points: DataFrame, key: str = "case_id") -> DataFrame:
    """1 - product of (1 - p) up to each horizon; a certain step makes all later ones certain."""
    w = W.partitionBy(key).orderBy("horizon").rowsBetween(W.unboundedPreceding, 0)
    q = 1.0 - clip(F.coalesce(c("p"), F.lit(0.0)), 0.0, 1.0)
    sure = F.max((q <= 0).cast("int")).over(w) == 1
    return points.withColumn("cumulative_risk", F.when(sure, 1.0).otherwise(1.0 - F.exp(F.sum(F.log(F.when(q > 0, q).otherwise(1.0))).over(w))))


def _wide(points: DataFrame, key: str, cols: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    return points.groupBy(key).agg(*[F.max(F.when(c("horizon") == k, c(n))).alias(f"{n}{k}") for n in cols for k in horizons])


def early_warning(points: DataFrame, key: str = "case_id") -> DataFrame:
    """0..100 from the next step, the five-step risk, acceleration and port growth."""
    x = _wide(points, key, ["p", "ports"])
    surv = F.lit(1.0)
    for k in HORIZONS:
        surv = surv * (1.0 - F.coalesce(c(f"p{k}"), F.lit(0.0)))
    grow = clip((c("ports3") - c("ports1")) / F.greatest(c("ports1").cast("double"), F.lit(1.0)), 0.0, 1.0)
    raw = 35.0 * c("p1") + 35.0 * (1.0 - surv) + 15.0 * F.greatest(F.lit(0.0), c("p3") - c("p1")) + 15.0 * grow
    x = x.withColumn("early_warning_score", r(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 0).cast("int"))
    s = c("early_warning_score")
    return x.select(key, "early_warning_score", choose((s >= 75, "CRITICAL"), (s >= 50, "HIGH"), (s >= 25, "ELEVATED"), default="NORMAL").alias("level"))


def risk_level(p: Column) -> Column:
    return choose((p.isNull(), "LOW"), (p >= 0.75, "CRITICAL"), (p >= 0.50, "HIGH"), (p >= 0.25, "MEDIUM"), default="LOW")


def stage_rule(p: Column, ports: Column, tcp: Column, udp: Column, packets: Column, syn: Column, src: Column, dst: Column) -> Column:
    flood = (syn > 50) | ((packets > 1000) & (tcp > 0.8 * packets)) | ((packets > 2000) & (udp > 0.8 * packets))
    return choose((p < 0.40, "STABLE_BENIGN"), (flood, "DENIAL_OF_SERVICE"), ((ports > 15) | ((ports > 8) & (packets < 500)), "RECONNAISSANCE"),
                  ((src > 500000) & (src > dst * 5), "EXFILTRATION"), (dst > src * 4, "COMMAND_AND_CONTROL"), (p >= 0.70, "EXPLOITATION"),
                  default="ATTACK_IMMINENT")


def attack_horizon(points: DataFrame, key: str = "case_id", threshold: float = 0.5, seconds: int = 60, band: float = 0.03) -> DataFrame:
    """Onset, length, lead time, consistency and decay of the first run at or above the threshold.

    A case has a handful of horizons, so its probabilities are folded as one short array.
    """
    g = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("horizon", "p"))).alias("_s"))
    g = g.withColumns({"_p": F.transform("_s", lambda x: x["p"]), "_h": F.transform("_s", lambda x: x["horizon"])})
    g = g.withColumns({"_a": F.transform("_p", lambda x: (x >= threshold).cast("int")), "_n": F.size("_s"),
                       "_null": F.exists("_p", lambda x: x.isNull() | F.isnan(x))})
    pairs = F.expr("slice(transform(_a, (x, i) -> if(i > 0, int(x <> _a[i - 1]), 0)), 1, _n)")
    total = F.aggregate("_a", F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    near = F.size(F.filter("_p", lambda x: F.abs(x - threshold) <= band))
    g = g.withColumns({"_flips": F.aggregate(pairs, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))), "_pos": total, "_near": near,
                       "_adj": F.expr("exists(sequence(1, greatest(_n - 1, 1)), i -> _a[i] = 1 and _a[i - 1] = 1)"),
                       "_on": F.array_position("_a", 1).cast("int")})
    g = g.withColumn("_tail", F.expr("if(_on > 0, slice(_a, _on, _n - _on + 1), array())"))
    g = g.withColumn("_run", F.expr("if(_on > 0, if(array_position(_tail, 0) = 0, size(_tail), cast(array_position(_tail, 0) as int) - 1), 0)"))
    decay = F.expr("_run > 1 and _on < _n and forall(sequence(_on, greatest(_n - 1, _on)), i -> _p[i - 1] >= _p[i] - 1e-6)")
    vague = ((c("_pos") >= 2) & (c("_flips") >= 3) & ~c("_adj")) | ((c("_near") >= F.floor(c("_n") / 2) + 1) & (c("_flips") >= 1))
    state = choose((c("_null"), "ABSTAINED"), (vague, "UNCERTAIN_FORECAST"), (c("_pos") == 0, "NO_ATTACK_FORECAST"),
                   (c("_run") >= 2, "SUSTAINED_ATTACK_FORECAST"), default="EARLY_SIGNAL")
    g = g.withColumn("state", state)
    hit = c("state").isin("SUSTAINED_ATTACK_FORECAST", "EARLY_SIGNAL")
    onset = F.when(hit, F.try_element_at("_h", F.greatest(c("_on"), F.lit(1))))
    return g.select(
        key, "state", onset.alias("onset_horizon"), (onset * seconds).alias("lead_time_seconds"), F.when(hit, c("_run")).otherwise(0).alias("horizon_windows"),
        F.when(hit, F.try_element_at("_h", F.greatest(c("_on") + c("_run") - 1, F.lit(1)))).alias("end_horizon"),
        choose((c("state") == "ABSTAINED", None), (c("state") == "UNCERTAIN_FORECAST", F.greatest(F.lit(0.0), 1.0 - c("_flips") / F.greatest(F.lit(1), c("_n") - 1))),
               (c("state") == "NO_ATTACK_FORECAST", 1.0), default=c("_run") / F.greatest(c("_pos"), F.lit(1))).alias("temporal_consistency"),
        F.coalesce(hit & decay, F.lit(False)).alias("decay_observed"))


# Probability of staying / moving after k steps, per state.
STAGE_STEPS = {
    "BENIGN_OBSERVATION": {"BENIGN_OBSERVATION": (0.992, 0.984, 0.977, 0.969, 0.962), "RECONNAISSANCE": (0.005, 0.010, 0.015, 0.020, 0.025),
                           "DENIAL_OF_SERVICE": (0.003, 0.006, 0.008, 0.011, 0.013)},
    "RECONNAISSANCE": {"RECONNAISSANCE": (0.975, 0.950, 0.924, 0.898, 0.873), "BENIGN_OBSERVATION": (0.025, 0.050, 0.076, 0.102, 0.127)},
    "COMMAND_AND_CONTROL": {"COMMAND_AND_CONTROL": (0.960, 0.935, 0.910, 0.880, 0.850), "LATERAL_MOVEMENT": (0.030, 0.048, 0.065, 0.085, 0.105),
                            "EXFILTRATION": (0.010, 0.017, 0.025, 0.035, 0.045)},
    "DENIAL_OF_SERVICE": {"DENIAL_OF_SERVICE": (0.985, 0.968, 0.950, 0.920, 0.890), "BENIGN_OBSERVATION": (0.015, 0.032, 0.050, 0.080, 0.110)}}


def stage_markov(cases: DataFrame, state: str, matrices: DataFrame) -> DataFrame:
    """Most likely stage per case and horizon from k-step rows ``from_state, horizon, to_state, p``; more than 5 steps abstains."""
    j = cases.join(F.broadcast(matrices.filter("horizon <= 5")), c(state) == c("from_state"))
    keep = [x for x in cases.columns]
    return j.groupBy(*keep, "horizon").agg(F.max_by("to_state", F.struct("p", "to_state")).alias("predicted_stage"), F.max("p").alias("stage_probability"))


def stage_matrices(spark) -> DataFrame:
    rows = [(s, k, t, p) for s, to in STAGE_STEPS.items() for t, ps in to.items() for k, p in enumerate(ps, start=1)]
    return spark.createDataFrame(rows, "from_state string, horizon int, to_state string, p double")


def forecast_validation(points: DataFrame, windows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Prediction at T+h against the window that came: CONSISTENT, DIVERGENT or NOT AVAILABLE."""
    a = windows.select((c("bucket")).alias("_b"), c("attack_state").alias("actual"))
    j = points.join(a, c("source_bucket") + c("horizon") == c("_b"), "left")
    return j.withColumn("validation_status", choose((c("actual").isNull(), "NOT_AVAILABLE"), ((c("p") >= threshold) == (c("actual") == 1), "CONSISTENT"),
                                                    default="DIVERGENT")).drop("_b")


def abstention_gate(x: DataFrame) -> DataFrame:
    """First reason that blocks a forecast and the operating tier.

    Columns: ``gaps, windows, missing, quality, unknown, ood, uncertainty, degraded``.
    """
    reason = choose((c("gaps") > 0, "GAPPED_HISTORY"), (c("windows") < LOOKBACK, "INSUFFICIENT_HISTORY"), (c("missing") > 0, "MISSING_REQUIRED_FEATURES"),
                    (c("quality") == "INSUFFICIENT", "POOR_CAPTURE_QUALITY"), (c("unknown"), "UNKNOWN_BEHAVIOR"))
    tier = choose((c("gaps") > 0, "ABSTAIN"), (c("windows") < LOOKBACK, "ABSTAIN"), (c("quality") == "INSUFFICIENT", "ABSTAIN"),
                  (c("ood") > 0.85, "ANOMALY_ONLY"), (c("uncertainty") > 0.80, "ANOMALY_ONLY"), (c("degraded"), "DEGRADED_FORECAST"), default="FULL_FORECAST")
    return x.withColumns({"abstention_reason": reason, "tier": tier})


def unknown_behaviour(x: DataFrame) -> DataFrame:
    """Ordered rules over a window's protocol mix, ports and volumes, then over the evidence for a predicted attack.

    Columns: ``tcp, udp, other, flows, ports, bytes, packets, attack_predicted, supporting, contradicting, strength``.
    """
    total = c("tcp") + c("udp") + c("other")
    rules = [((total > 10) & (c("other") / F.greatest(total, F.lit(1)) > 0.60), "UNKNOWN_PROTOCOL_MIX"), ((c("flows") > 50) & (c("ports") == 0), "PORTLESS_FLOWS"),
             ((c("bytes") > 1000000) & (c("packets") == 0), "BYTES_WITHOUT_PACKETS"),
             (c("attack_predicted") & (c("strength") < 0.15) & (c("contradicting") >= 2), "MODEL_EVIDENCE_DISAGREEMENT"),
             ((c("contradicting") >= 3) & (c("contradicting") > c("supporting")), "CONTRADICTORY_EVIDENCE"),
             (c("attack_predicted") & (c("strength") >= 0.60) & (c("supporting") >= 2), "KNOWN_ATTACK"), (c("attack_predicted"), "WEAK_ATTACK_EVIDENCE"),
             (c("contradicting") == 0, "KNOWN_BENIGN")]
    return x.withColumn("behaviour", choose(*rules, default="MIXED_BENIGN")).withColumn("abstain_recommended", c("behaviour").isin(
        "UNKNOWN_PROTOCOL_MIX", "PORTLESS_FLOWS", "BYTES_WITHOUT_PACKETS", "MODEL_EVIDENCE_DISAGREEMENT", "CONTRADICTORY_EVIDENCE"))


def confidence_state(x: DataFrame) -> DataFrame:
    """Uncertainty and confidence state of a score; a number is withheld while uncalibrated.

    Columns: ``p, strength, contradicting, supporting, degraded, uncertain_horizon, calibrated``.
    """
    hover = F.abs(c("p") - 0.5) <= 0.05
    contra = (c("contradicting") >= 2) & (c("contradicting") >= c("supporting"))
    unc = choose((c("uncertain_horizon") | (hover & contra) | c("degraded"), "HIGH"), (hover | contra | (c("strength") < 0.35), "MEDIUM"), default="LOW")
    x = x.withColumn("uncertainty_level", unc)
    hi = c("uncertainty_level") == "HIGH"
    state = choose((c("p").isNull(), "UNKNOWN"), (hi, "HIGH_UNCERTAINTY"), ((c("strength") < 0.25) & (c("calibrated") | (c("p") >= 0.5)), "LOW_SUPPORT"),
                   (~c("calibrated"), "UNCALIBRATED"), default="CALIBRATED")
    return x.withColumns({"confidence_state": state, "confidence": F.when(c("calibrated") & c("p").isNotNull(), F.abs(c("p") - 0.5) * 2)})


def graph_fusion(points: DataFrame, projection: DataFrame) -> DataFrame:
    """Forecast points joined to the projected graph by step, with density trend and technique hints."""
    j = points.join(F.broadcast(projection), c("horizon") == c("horizon_step"), "left")
    return j.withColumns({"density_trend": choose((c("predicted_density") > c("current_density") * 1.05, "EXPANDING"),
                                                  (c("predicted_density") < c("current_density") * 0.95, "CONTRACTING"), default="STABLE"),
                          "attributions": tag_string(((c("p") >= 0.5) & (c("predicted_fanout_expansion") >= 10), "T1046"),
                                                     ((c("p") >= 0.5) & (c("threat_nodes") > 0), "T1021"))})


def belief_update(points: DataFrame, evidence: DataFrame, key: str = "case_id") -> DataFrame:
    """Scale a case's probabilities by 0.75 (mostly contradicting), 1.15 (supporting) or 1, kept in [0.01, 0.99].

    ``evidence``: ``key, protocol, bytes``; silent or housekeeping traffic contradicts.
    """
    quiet = (F.coalesce("bytes", F.lit(0)) == 0) | F.upper("protocol").isin("NTP", "ARP")
    e = evidence.groupBy(key).agg(count_when(quiet).alias("contradicting"), count_when(~quiet).alias("supporting"))
    j = points.join(e, key, "left").withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in ("contradicting", "supporting")})
    f = choose((c("contradicting") > c("supporting"), 0.75), (c("supporting") > 0, 1.15), default=1.0)
    return j.withColumns({"factor": f, "p_updated": F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.coalesce("p", F.lit(0.5)) * f))})


# Damping weight of each intervention.
DAMPING = {"isolate_host": 0.45, "block_port": 0.35, "rate_limit": 0.25, "contain_ip": 0.40}


def what_if(points: DataFrame, interventions: DataFrame, key: str = "case_id") -> DataFrame:
    """Damped probabilities and cumulative risk under a case's interventions (``key, type, intensity``)."""
    wt = F.create_map(*[F.lit(x) for kv in DAMPING.items() for x in kv])
    d = interventions.groupBy(key).agg(F.sum(F.coalesce(wt[c("type")], F.lit(0.0)) * clip(c("intensity"), 0.1, 1.0)).alias("_d"))
    j = points.join(d, key, "left").withColumn("damping", F.least(F.lit(0.85), F.coalesce("_d", F.lit(0.0)))).drop("_d")
    lag = F.least(F.lit(1.0), 0.5 + c("horizon") * 0.15)
    j = j.withColumnRenamed("p", "p_base").withColumn("p", r(F.greatest(F.lit(0.04), c("p_base") * (1.0 - c("damping") * lag)), 4))
    return cumulative_risk(j, key)


def probability_trend(points: DataFrame, key: str = "case_id", rapid: float = 0.25, rising: float = 0.10, low: float = 0.35, high: float = 0.65,
                      margin: float = 0.10) -> DataFrame:
    w = W.partitionBy(key).orderBy("horizon")
    p, q = c("p"), F.lag("p").over(w)
    level = choose((p < low, "STABLE_LOW"), (p >= high, "STABLE_HIGH"), default="UNCERTAIN")
    d = p - q
    return points.withColumn("trend", choose(
        (p.isNull() | F.isnan(p), "INSUFFICIENT_EVIDENCE"), (q.isNull() | F.isnan(q), level), (d >= rapid, "RAPIDLY_RISING"), (d >= rising, "RISING"),
        (d <= -rising, "FALLING"), (F.abs(p - 0.5) < margin, "UNCERTAIN"), default=level))


def trajectory_findings(points: DataFrame, key: str = "case_id") -> DataFrame:
    """Port growth, packet doubling and sustained risk as progression rows, else STABLE_BENIGN."""
    x = _wide(points, key, ["p", "ports", "packets"])
    hot = sum((F.coalesce(c(f"p{k}") >= 0.65, F.lit(False)).cast("int") for k in HORIZONS), F.lit(0))
    arr = F.array_compact(F.array(
        F.when((c("ports3") > c("ports1") * 1.5) & (c("ports3") >= 10), "RECONNAISSANCE"),
        F.when((c("packets5") > c("packets1") * 2.0) & (c("packets5") > 500), "DENIAL_OF_SERVICE"), F.when(hot >= 2, "SUSTAINED_ATTACK_PROGRESSION")))
    return x.select(key, F.explode(F.when(F.size(arr) == 0, F.array(F.lit("STABLE_BENIGN"))).otherwise(arr)).alias("stage"))


def progression_timeline(cases: DataFrame, points: DataFrame, key: str = "case_id") -> DataFrame:
    t0 = cases.select(key, F.lit(0).alias("horizon"), F.lit("OBSERVED").alias("provenance"), c("current").cast("double").alias("p"))
    return t0.unionByName(points.select(key, "horizon", F.lit("FORECAST").alias("provenance"), "p")).withColumn(
        "label", F.when(c("horizon") == 0, "T0").otherwise(F.concat(F.lit("T+"), "horizon")))


def forecast_intelligence(horizon: DataFrame, warning: DataFrame, confidence: DataFrame, behaviour: DataFrame, key: str = "case_id") -> DataFrame:
    """Horizon, warning, confidence and behaviour of each case in one row."""
    return (horizon.join(warning, key, "left").join(confidence.select(key, "uncertainty_level", "confidence_state"), key, "left")
            .join(behaviour.select(key, "behaviour", "abstain_recommended"), key, "left"))
