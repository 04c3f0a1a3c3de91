"""Beaconing, periodicity, entity baselines, regimes, behavioural vectors and evidence."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from packetloom.functions.columns import bucket, choose, clip, count_when, r, set_size, stable_id
from packetloom.functions.ordered import segmented_running
from packetloom.functions.quantiles import group_entropy, group_gini, group_quantiles
from packetloom.session import shared

W = Window
PAIR = ["src_ip", "dst_ip", "dst_port", "protocol"]
FAILED = ("REJECTED", "RESET")


def beaconing(flows: DataFrame, min_connections: int = 4, cv_threshold: float = 0.35,
              segment_seconds: int = 86400) -> DataFrame:
    """Regular connection starts per (src, dst, port, protocol).

    Mean and deviation of the gaps come from sums per (pair, day) plus the gaps that cross days, so a
    pair with a third of all flows is spread over its days; over its windows where flows have a ``bucket``.
    """
    seg = F.col("bucket") if "bucket" in flows.columns else F.floor(F.col("start_ts") / segment_seconds)
    f = flows.filter("src_ip IS NOT NULL AND dst_ip IS NOT NULL").select(*PAIR, "start_ts", seg.alias("_seg"))
    gap = F.col("start_ts") - F.lag("start_ts").over(W.partitionBy(*PAIR, "_seg").orderBy("start_ts"))
    seg = f.withColumn("_g", gap).groupBy(*PAIR, "_seg").agg(
        F.count("*").alias("_n"), F.min("start_ts").alias("_a"), F.max("start_ts").alias("_b"),
        F.coalesce(F.sum(F.col("_g") * F.col("_g")), F.lit(0.0)).alias("_s2"))
    edge = F.col("_a") - F.lag("_b").over(W.partitionBy(*PAIR).orderBy("_seg"))
    g = seg.withColumn("_e", F.coalesce(edge, F.lit(0.0))).groupBy(*PAIR).agg(
        F.sum("_n").alias("connection_count"), F.min("_a").alias("_first"), F.max("_b").alias("_last"),
        F.sum(F.col("_s2") + F.col("_e") * F.col("_e")).alias("_s2"))
    n = F.col("connection_count") - 1
    mean = (F.col("_last") - F.col("_first")) / n
    g = g.filter(F.col("connection_count") >= max(2, min_connections)).withColumn("_mean", mean).filter("_mean >= 0.1")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") / n - F.col("_mean") * F.col("_mean")))
    g = g.withColumn("_std", std).withColumn("_cv", F.col("_std") / F.greatest("_mean", F.lit(1e-6)))
    score = clip(1.0 - F.col("_cv") / 0.70, 0.0, 1.0)
    return g.select(*PAIR, "connection_count", F.col("_mean").alias("mean_interval_seconds"),
                    F.col("_std").alias("std_interval_seconds"), F.col("_cv").alias("coefficient_of_variation"),
                    score.alias("score"), F.least(F.lit(1.0), F.col("connection_count") / 10.0).alias("confidence"),
                    ((F.col("_cv") <= cv_threshold) & (score >= 0.50)).alias("is_beaconing"))


def interval_rows(events: DataFrame, keys: Sequence[str], ts: str, segment_seconds: int) -> DataFrame:
    """Distinct times per key with ``interval`` to the previous one and ``prev_interval`` before that.

    Gaps inside a (key, segment) come from one window; the gaps that cross segments from a table with
    one row per segment.
    """
    keys = list(keys)
    d = shared(events.select(*keys, F.col(ts).alias("_t")).distinct()
               .withColumn("_seg", F.floor(F.col("_t") / segment_seconds)))
    inner = W.partitionBy(*keys, "_seg").orderBy("_t")
    rows = d.withColumn("_i", F.col("_t") - F.lag("_t").over(inner)).withColumn("_pi", F.lag("_i").over(inner))
    seg = rows.groupBy(*keys, "_seg").agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"), F.count("*").alias("_n"),
                                          F.max_by("_i", "_t").alias("_li"))
    across = W.partitionBy(*keys).orderBy("_seg")
    seg = seg.withColumn("_first", F.col("_a") - F.lag("_b").over(across)).withColumn(
        "_last", F.when(F.col("_n") == 1, F.col("_first")).otherwise(F.col("_li"))).withColumn(
        "_carry", F.lag("_last").over(across))
    out = rows.join(seg.select(*keys, "_seg", "_first", "_carry"), [*keys, "_seg"]).withColumns({
        "interval": F.coalesce("_i", "_first"),
        "prev_interval": F.when(F.col("_i").isNull(), F.col("_carry")).otherwise(F.coalesce("_pi", "_first"))})
    return out.filter("interval IS NOT NULL").select(*keys, "interval", "prev_interval")


LOWER_HINGE = lambda n: (F.floor(n / 2) - 1) / 2.0
UPPER_HINGE = lambda n: (n - 1) - (F.floor(n / 2) - 1) / 2.0


def interval_shape(rows: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Count, mean, deviation, median, MAD, Bowley skewness, binned entropy and jitter of intervals."""
    keys = list(keys)
    rows = shared(rows)
    x = F.col("interval")
    base = rows.groupBy(*keys).agg(F.count("*").alias("interval_count"), F.avg(x).alias("mean_interval"),
                                   F.stddev_pop(x).alias("std_interval"), F.min(x).alias("_lo"), F.max(x).alias("_hi"),
                                   F.avg(F.abs(x - F.col("prev_interval"))).alias("jitter"))
    q = group_quantiles(rows, keys, "interval", {"median_interval": 0.5, "q1": LOWER_HINGE, "q3": UPPER_HINGE})
    base = shared(base.join(q, keys))
    back = rows.join(base.select(*keys, "_lo", "_hi", "median_interval"), keys).withColumns({
        "_dev": F.abs(x - F.col("median_interval")),
        "_b": F.when(F.col("_hi") - F.col("_lo") >= 1e-6, F.least(
            F.floor((x - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)))})
    mad = group_quantiles(back, keys, "_dev", {"mad_interval": 0.5})
    ent = group_entropy(back, keys, "_b", "interval_entropy")
    return shape_of(base.join(mad, keys).join(ent, keys, "left").drop("_lo", "_hi"))


def shape_of(stats: DataFrame) -> DataFrame:
    """Bowley skewness from the hinges; a single bin has entropy 0, a single interval jitter 0."""
    iqr = F.col("q3") - F.col("q1")
    return stats.withColumns({
        "interval_entropy": F.coalesce("interval_entropy", F.lit(0.0)), "jitter": F.coalesce("jitter", F.lit(0.0)),
        "bowley_skewness": F.when(F.col("interval_count") < 4, None).when(iqr < 1e-6, 0.0).otherwise(
            clip((F.col("q3") + F.col("q1") - 2 * F.col("median_interval")) / iqr, -1.0, 1.0))})


def interval_shape_arrays(events: DataFrame, keys: Sequence[str], ts: str, bins: int = 10) -> DataFrame:
    """``interval_shape`` of the intervals between distinct times, from one sorted array per key: a single shuffle.

    For keys of a bounded number of events; others go through ``interval_rows``. Both give the same values.
    """
    keys = list(keys)
    d = events.groupBy(*keys).agg(F.array_sort(F.collect_set(ts)).alias("_t"))
    d = d.filter(F.size("_t") > 1).withColumn("_n", F.size("_t") - 1)
    d = d.withColumn("_x", F.zip_with(F.slice("_t", 2, F.col("_n")), F.slice("_t", 1, F.col("_n")), lambda b, a: b - a))
    d = d.withColumns({"_s": F.array_sort("_x"), "_j": F.zip_with(F.slice("_x", 2, F.col("_n")), F.slice("_x", 1, F.col("_n") - 1), lambda b, a: F.abs(b - a))})
    n = F.col("_n")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)

    def at(a: str, pos: Column) -> Column:
        lo, hi = F.get(a, F.floor(pos).cast("int")), F.get(a, F.ceil(pos).cast("int"))
        return lo + (hi - lo) * (pos - F.floor(pos))

    middle = (n - 1) * 0.5
    d = d.withColumns({"mean_interval": total("_x") / n, "median_interval": at("_s", middle), "q1": at("_s", LOWER_HINGE(n)), "q3": at("_s", UPPER_HINGE(n)),
                       "_lo": F.get("_s", F.lit(0)), "_hi": F.get("_s", n - 1)})
    spread = F.col("_hi") - F.col("_lo")
    place = F.when(spread >= 1e-6, F.transform("_x", lambda v: F.least(F.floor((v - F.col("_lo")) / (spread / bins)), F.lit(bins - 1))))
    d = d.withColumns({
        "std_interval": F.sqrt(F.aggregate("_x", F.lit(0.0), lambda acc, v: acc + (v - F.col("mean_interval")) * (v - F.col("mean_interval"))) / n),
        "jitter": F.when(n > 1, total("_j") / (n - 1)),
        "_dev": F.array_sort(F.transform("_x", lambda v: F.abs(v - F.col("median_interval")))),
        "_c": F.aggregate(place, F.array_repeat(F.lit(0), bins), lambda acc, b: F.transform(acc, lambda k, i: k + (i == b).cast("int")))})
    d = d.withColumns({"mad_interval": at("_dev", middle), "interval_entropy": F.log2(n) - F.aggregate(
        "_c", F.lit(0.0), lambda acc, k: acc + F.when(k > 0, k * F.log2(k.cast("double"))).otherwise(0.0)) / n})
    return shape_of(d.select(*keys, n.cast("bigint").alias("interval_count"), "mean_interval", "std_interval", "jitter", "median_interval", "q1", "q3",
                             "mad_interval", "interval_entropy"))


def interval_shapes(events: DataFrame, keys: Sequence[str], ts: str, segment_seconds: int = 86400, array_events: int = 1 << 16) -> DataFrame:
    """Shape of the intervals of every key: keys of at most ``array_events`` events from one sorted array, busier ones by segments and value bins.

    Rows with a null key belong to no key. The two columns are kept, so events are made once.
    """
    keys = list(keys)
    f = shared(events.dropna(subset=keys).select(*keys, ts))
    busy = shared(f.groupBy(*keys).agg(F.count("*").alias("_events")).filter(F.col("_events") > array_events).select(*keys))
    if busy.isEmpty():
        return interval_shape_arrays(f, keys, ts)
    rare = interval_shape_arrays(f.join(busy, keys, "left_anti"), keys, ts)
    return rare.unionByName(interval_shape(interval_rows(f.join(busy, keys, "left_semi"), keys, ts, segment_seconds), keys))


def periodicity(flows: DataFrame, min_connections: int = 4, segment_seconds: int = 86400, array_events: int = 1 << 16) -> DataFrame:
    """Five-class regularity of every (src, dst, port, protocol), with its destination consistency.

    Pairs of at most ``array_events`` events are judged from one sorted array, busier ones by segments and value bins, with equal results.
    """
    # a missing port or protocol is a key like any other; stand-ins keep the joins below on plain equality
    none = {"dst_port": F.lit(-1), "protocol": F.lit("")}
    f = shared(flows.filter("src_ip IS NOT NULL AND dst_ip IS NOT NULL").select(*[F.coalesce(F.col(k), none[k]).alias(k) if k in none else k for k in PAIR], "start_ts"))
    ev = shared(f.groupBy(*PAIR).agg(F.count("*").alias("event_count"), F.min("start_ts").alias("_a"), F.max("start_ts").alias("_b")))
    src = ev.groupBy("src_ip").agg(F.sum("event_count").alias("_src_total"))
    # rare pairs cannot be judged: they are dropped before any interval is formed
    busy = F.col("event_count") > array_events
    often = lambda which: f.join(ev.filter((F.col("event_count") >= min_connections) & which).select(*PAIR), PAIR, "left_semi")
    s = interval_shape_arrays(often(~busy), PAIR, "start_ts")
    if not ev.filter(busy).isEmpty():
        s = s.unionByName(interval_shape(interval_rows(often(busy), PAIR, "start_ts", segment_seconds), PAIR))
    j = ev.join(s, PAIR, "left").join(src, "src_ip")
    enough = (F.col("event_count") >= min_connections) & (F.coalesce("interval_count", F.lit(0)) >= 3)
    cv = F.col("std_interval") / F.greatest("mean_interval", F.lit(1e-6))
    mad_s = F.greatest(F.lit(0.0), 1.0 - F.col("mad_interval") / F.greatest("median_interval", F.lit(1e-6)))
    skew_s = F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.abs("bowley_skewness")), mad_s)
    cv_s = F.greatest(F.lit(0.0), 1.0 - cv / 0.70)
    j = j.withColumns({"coefficient_of_variation": F.when(enough, cv), "regularity_score": F.when(
        enough, r(0.4 * cv_s + 0.35 * mad_s + 0.25 * skew_s, 4)).otherwise(0.0)})
    reg, c = F.col("regularity_score"), F.col("coefficient_of_variation")
    only = lambda n: F.when(enough, F.col(n)).alias(n)
    return j.select(
        *[F.when(F.col(k) != none[k], F.col(k)).alias(k) if k in none else k for k in PAIR], "event_count", (F.col("_b") - F.col("_a")).alias("observation_duration_seconds"),
        F.when(F.col("event_count") < min_connections, F.col("event_count") - 1).otherwise(
            F.coalesce("interval_count", F.lit(0))).alias("interval_count"),
        *[only(n) for n in ("median_interval", "mad_interval", "mean_interval", "std_interval", "jitter", "bowley_skewness",
                            "interval_entropy")],
        "coefficient_of_variation", "regularity_score",
        r(F.col("event_count") / F.greatest(F.lit(1), F.col("_src_total")), 4).alias("destination_consistency"),
        choose((~enough, "INSUFFICIENT_OBSERVATIONS"), ((reg >= 0.85) & (c <= 0.15), "HIGHLY_PERIODIC"),
               ((reg >= 0.65) & (c <= 0.35), "PERIODIC"), ((reg >= 0.40) & (c <= 0.60), "WEAKLY_PERIODIC"),
               default="IRREGULAR").alias("classification"))


def string_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy of the characters of each whole text, in bits; a text without characters has no row."""
    return df.filter(F.length(text) > 0).select(key, r(_entropy(text), 4).alias("entropy"))


@F.pandas_udf(T.DoubleType())
def _bits(texts: pd.Series) -> pd.Series:
    def bits(text: str | None) -> float | None:
        if not text:
            return None
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        counts = np.bincount(codes) if codes.max() < 65536 else np.unique(codes, return_counts=True)[1]
        share = counts[counts > 0] / len(codes)
        return float(-(share * np.log2(share)).sum())
    return texts.map(bits, na_action="ignore").astype("float64")


def _entropy(text: str) -> Column:
    """Row-local: one pass over the code points of each text; null where it has none."""
    return _bits(F.col(text))


def dns_tunnel_signals(dns: DataFrame, client: str = "src_ip", name: str = "query", entropy_limit: float = 3.6,
                       length_limit: float = 24.0) -> DataFrame:
    """Clients whose looked-up names are long and look random."""
    names = dns.select(client, name).distinct()
    per = names.filter(F.length(name) > 0).withColumn("entropy", r(_entropy(name), 4)).groupBy(client).agg(
        F.count("*").alias("names"), F.avg("entropy").alias("mean_entropy"), F.avg(F.length(name)).alias("mean_length"))
    return per.withColumn("is_suspicious", (F.col("mean_entropy") >= entropy_limit) | (F.col("mean_length") >= length_limit))


def behaviour_risk_score(beacons: DataFrame, flows: DataFrame, dns_signals: DataFrame | None = None,
                         long_seconds: float = 300.0) -> DataFrame:
    b = beacons.agg(count_when(F.col("is_beaconing") & (F.col("score") >= 0.7)).alias("high_risk_beacons"))
    long_lived = flows.agg(count_when(F.col("end_ts") - F.col("start_ts") >= long_seconds).alias("n"))
    dns = dns_signals.agg(count_when(F.col("is_suspicious")).alias("n")).scalar() if dns_signals is not None else F.lit(0)
    out = b.withColumns({"long_lived_flow_count": long_lived.scalar(), "dns_signals": dns})
    score = (F.least(F.lit(60.0), 25.0 * F.col("high_risk_beacons")) + F.least(F.lit(20.0), 5.0 * F.col("long_lived_flow_count"))
             + F.least(F.lit(20.0), 10.0 * F.col("dns_signals")))
    return out.withColumn("summary_score", r(F.least(F.lit(100.0), score), 2))


def entity_windows(sessions: DataFrame, seconds: int, totals: DataFrame | None = None) -> DataFrame:
    """Per (source, window): sessions, packets, bytes, distinct ports and peers, failures.

    Sessions are first reduced to one row per (source, window, peer), then (source, window, port), so a busy source is
    spread before it is counted; nothing is shuffled where they are laid out by source and window (and have a ``bucket``).
    With ``totals`` (outgoing ``entities.window_totals``) only the peers are counted from the sessions.
    """
    s = sessions if "bucket" in sessions.columns else sessions.withColumn("bucket", bucket("start_ts", seconds))
    s = s.withColumnRenamed("src_ip", "entity")
    if totals is not None:
        met = s.select("entity", "bucket", "dst_ip").distinct().groupBy("entity", "bucket").agg(F.count("*").alias("peers"))
        return totals.select("entity", "bucket", F.col("n").alias("sessions"), "packets", "bytes", F.size(F.filter("ports", lambda p: p != 0)).cast("bigint").alias("ports"),
                             F.col("broken").alias("failed_sessions")).join(met, ["entity", "bucket"])
    peer = s.groupBy("entity", "bucket", "dst_ip").agg(
        F.count("*").alias("n"), F.sum(F.col("fwd_packets") + F.col("rev_packets")).alias("p"),
        F.sum(F.col("fwd_bytes") + F.col("rev_bytes")).alias("b"), count_when(F.col("state").isin(*FAILED)).alias("f"))
    g = peer.groupBy("entity", "bucket").agg(
        F.sum("n").alias("sessions"), F.sum("p").alias("packets"), F.sum("b").alias("bytes"), F.sum("f").alias("failed_sessions"), F.count("*").alias("peers"))
    ports = s.groupBy("entity", "bucket", "dst_port").agg(F.lit(1).alias("one")).groupBy("entity", "bucket").agg(
        count_when(F.col("dst_port") != 0).alias("ports"))
    return g.join(ports, ["entity", "bucket"]).select("entity", "bucket", "sessions", "packets", "bytes", "ports", "failed_sessions", "peers")


BASELINE_METRICS = ("packets", "bytes", "ports", "peers", "failed_sessions")


def entity_baseline(ew: DataFrame, min_windows: int = 3) -> DataFrame:
    """All windows of an entity but its last form the baseline; the last is tested against it."""
    last = F.max("bucket").over(W.partitionBy("entity"))
    x = ew.withColumn("_last", F.col("bucket") == last)
    aggs = [F.count("*").alias("window_count"), F.max("bucket").alias("evaluation_window")]
    for m in BASELINE_METRICS:
        hist = F.when(~F.col("_last"), F.col(m).cast("double"))
        aggs += [F.avg(hist).alias(f"{m}_mean"), F.stddev_pop(hist).alias(f"{m}_std"), F.min(hist).alias(f"{m}_min"),
                 F.max(hist).alias(f"{m}_max"), F.max(F.when(F.col("_last"), F.col(m).cast("double"))).alias(f"{m}_now")]
    g = x.groupBy("entity").agg(*aggs)
    z = lambda m: F.when(F.col(f"{m}_std") > 0, (F.col(f"{m}_now") - F.col(f"{m}_mean")) / F.col(f"{m}_std"))
    ready = F.col("window_count") >= min_windows
    g = g.withColumns({"ports_z": z("ports"), "peers_z": z("peers"), "packets_z": z("packets")})
    hit = lambda m, lim: F.coalesce(ready & (F.col(f"{m}_z") >= lim), F.lit(False))
    g = g.withColumns({"port_expansion": hit("ports", 2.5), "peer_expansion": hit("peers", 2.5),
                       "volume_shift": hit("packets", 3.0)})
    return g.withColumn("status", choose(
        (~ready, "INSUFFICIENT_HISTORY"),
        (F.col("port_expansion") | F.col("peer_expansion") | F.col("volume_shift"), "BASELINE_SHIFT"),
        default="BASELINE_STABLE"))


def entity_deviations(baseline: DataFrame) -> DataFrame:
    """One row per deviation found by :func:`entity_baseline`."""
    kinds = (("port_expansion", "PORT_EXPANSION", "ports"), ("peer_expansion", "PEER_EXPANSION", "peers"),
             ("volume_shift", "VOLUME_SHIFT", "packets"))
    rows = F.array_compact(F.array(*[F.when(F.col(flag), F.struct(
        F.lit(name).alias("deviation_type"), F.lit(m).alias("metric_name"), F.col(f"{m}_mean").alias("baseline_mean"),
        F.col(f"{m}_std").alias("baseline_std"), F.col(f"{m}_now").alias("observed_value"), F.col(f"{m}_z").alias("z_score")))
        for flag, name, m in kinds]))
    out = baseline.select("entity", F.col("evaluation_window").alias("bucket"), F.explode(rows).alias("_x"))
    return out.select("entity", "bucket", "_x.*").withColumn(
        "deviation_id", stable_id("dev", F.col("entity"), F.col("bucket"), F.col("deviation_type")))


NOVEL, QUIET = 0.15, 0.02
CHUNK = 65536


def regime_memory(observations: DataFrame, order: Sequence[str], ts: str, segment_seconds: int = 86400) -> DataFrame:
    """Final novelty score of each entity: +0.15 on a new peer or port, -0.02 otherwise, kept in [0, 1].

    ``observations``: ``entity, peer, port`` and the order columns. A clamped step is a function
    ``x -> min(H, max(L, x + s))`` and such functions compose into one of the same form, so the walk
    is folded in bounded pieces: novel rows by chunks of row numbers, then the chunks.
    """
    rows = observations.withColumns({"_seg": F.floor(F.col(ts) / segment_seconds), "_one": F.lit(1)})
    rows = segmented_running(rows, ["entity"], "_seg", list(order), {"_i": ("sum", "_one")}, inclusive=True)
    total = rows.groupBy("entity").agg(F.max("_i").alias("observations"))
    first_peer = rows.filter("peer IS NOT NULL").groupBy("entity", "peer").agg(F.min("_i").alias("_i")).select("entity", "_i")
    first_port = rows.filter("port IS NOT NULL").groupBy("entity", "port").agg(F.min("_i").alias("_i")).select("entity", "_i")
    # the first peer and the first port of an entity are not novel
    drop_first = lambda df: df.join(
        df.groupBy("entity").agg(F.min("_i").alias("_f")), "entity").filter("_i > _f").drop("_f")
    novel = drop_first(first_peer).unionByName(drop_first(first_port)).distinct()

    def compose(acc, s, lo, hi, gap):
        # quiet rows between the pieces, then the piece itself
        d = -QUIET * gap
        clamp01 = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        l1, h1, s1 = clamp01(acc["lo"] + d), clamp01(acc["hi"] + d), acc["s"] + d
        fit = lambda v: F.least(F.greatest(v + s, lo), hi)
        return s1 + s, fit(l1), fit(h1)

    def fold(arr, start, with_shape):
        def step(acc, x):
            s, lo, hi = (x["s"], x["lo"], x["hi"]) if with_shape else (F.lit(NOVEL), F.lit(0.0), F.lit(1.0))
            first = x["a"] if with_shape else x
            last = x["b"] if with_shape else x
            s2, l2, h2 = compose(acc, s, lo, hi, (first - acc["at"] - 1).cast("double"))
            return F.struct(s2.alias("s"), l2.alias("lo"), h2.alias("hi"), last.alias("at"))
        init = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), start.alias("at"))
        return F.aggregate(arr, init, step)

    c = novel.groupBy("entity", F.floor(F.col("_i") / CHUNK).alias("_c")).agg(F.array_sort(F.collect_list("_i")).alias("_l"))
    c = c.withColumn("_f", fold(F.col("_l"), (F.element_at("_l", 1) - 1), False))
    for width in (4096, None):
        group = ["entity"] if width is None else ["entity", F.floor(F.col("_c") / width).alias("_c")]
        piece = F.struct(F.element_at("_l", 1).alias("a"), F.col("_f.at").alias("b"), F.col("_f.s").alias("s"),
                         F.col("_f.lo").alias("lo"), F.col("_f.hi").alias("hi")) if width else F.col("_p")
        c = c.withColumn("_p", piece).groupBy(*group).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
        f = fold(F.col("_ps"), F.element_at("_ps", 1)["a"] - 1, True)
        c = c.withColumn("_f", f).withColumn("_p", F.struct(
            F.element_at("_ps", 1)["a"].alias("a"), F.col("_f.at").alias("b"), F.col("_f.s").alias("s"),
            F.col("_f.lo").alias("lo"), F.col("_f.hi").alias("hi")))
    out = total.join(c.select("entity", F.col("_p.s").alias("s"), F.col("_p.lo").alias("lo"), F.col("_p.hi").alias("hi"),
                              F.col("_p.b").alias("b")), "entity", "left")
    # before the first novel row the score is 0; after the last one it only decays
    at_last = F.coalesce(clip(F.least(F.greatest(F.col("s"), F.col("lo")), F.col("hi")), 0.0, 1.0), F.lit(0.0))
    end = F.greatest(F.lit(0.0), at_last - QUIET * (F.col("observations") - F.coalesce("b", F.col("observations"))))
    return out.select("entity", "observations", end.alias("divergence_score")).withColumn("active_regime", choose(
        (F.col("divergence_score") >= 0.70, "SEVERE_REGIME_DEPARTURE"), (F.col("divergence_score") >= 0.35, "ELEVATED_NOVELTY"),
        default="BENIGN_EQUILIBRIUM"))


def observed_window_index(rows: DataFrame) -> DataFrame:
    """Dense 1-based index of the windows seen anywhere (one row per window)."""
    return rows.select("bucket").distinct().withColumn("idx", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("bucket")))


def with_previous(rows: DataFrame, keys: Sequence[str], values: Sequence[str], index: DataFrame | None = None) -> DataFrame:
    """Add ``prev_<value>`` from the window observed just before; NULL when the key was absent there."""
    idx = index if index is not None else observed_window_index(rows)
    x = rows.join(idx, "bucket")
    w = W.partitionBy(*keys).orderBy("idx")
    near = F.lag("idx").over(w) == F.col("idx") - 1
    return x.withColumns({f"prev_{v}": F.when(near, F.lag(v).over(w)) for v in values})


def change_detection(ew: DataFrame) -> DataFrame:
    """Port fan-out, connection and failure surges against the previous observed window."""
    x = with_previous(ew, ["entity"], ["ports", "sessions", "failed_sessions"]).filter("idx > 1")
    p = lambda v: F.coalesce(F.col(f"prev_{v}"), F.lit(0))
    rules = (("PORT_FANOUT_SURGE", "ports", (F.col("ports") >= 5) & (F.col("ports") - p("ports") >= 4)),
             ("CONNECTION_ATTEMPT_SURGE", "sessions",
              (F.col("sessions") >= 10) & (F.col("sessions") >= 3 * F.greatest(F.lit(1), p("sessions")))),
             ("FAILED_SESSION_SPIKE", "failed_sessions",
              (F.col("failed_sessions") >= 5) & (F.col("failed_sessions") >= 2 * F.greatest(F.lit(1), p("failed_sessions")))))
    hits = F.array_compact(F.array(*[F.when(cond, F.struct(
        F.lit(name).alias("change_type"), (F.col(v) - p(v)).cast("double").alias("magnitude"),
        p(v).cast("double").alias("baseline_value"), F.col(v).cast("double").alias("current_value")))
        for name, v, cond in rules]))
    return x.select("entity", "bucket", F.explode(hits).alias("_x")).select("entity", "bucket", "_x.*")


def behavioural_vector(flows: DataFrame, seconds: int) -> DataFrame:
    """Diversity, novelty, entropy, fan ratios, concentration and churn of each window.

    New peers are endpoints never seen in an earlier window; edge churn compares with the previous one.
    """
    # read by every branch below: what they need of the flows is made once
    f = shared(flows.select(bucket("start_ts", seconds).alias("bucket"), "src_ip", "dst_ip", "dst_port", "protocol",
                            (F.col("fwd_bytes") + F.col("rev_bytes")).alias("_b"), (F.col("end_ts") - F.col("start_ts") < 2.0).alias("_short")))
    base = f.groupBy("bucket").agg(F.count("*").alias("n"), count_when(F.col("_short")).alias("short"))
    side = lambda c, s: f.groupBy("bucket", F.col(c).alias("ip")).agg(F.count("*").alias("k")).withColumn("side", F.lit(s))
    ends = side("src_ip", "s").unionByName(side("dst_ip", "d"))
    fan = ends.groupBy("bucket").agg(count_when(F.col("side") == "s").alias("srcs"), count_when(F.col("side") == "d").alias("dsts"))
    ips = ends.select("bucket", "ip").distinct()
    first = ips.groupBy("ip").agg(F.min("bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("fresh"))
    peers = ips.groupBy("bucket").agg(F.count("*").alias("peers")).join(first, "bucket", "left")
    port = group_entropy(f.filter("dst_port > 0"), ["bucket"], "dst_port", "port_entropy")
    proto = group_entropy(f.withColumn("_p", F.lower("protocol")), ["bucket"], "_p", "protocol_entropy")
    gini = group_gini(f, ["bucket"], "_b", "traffic_concentration_gini")
    idx = observed_window_index(base)
    edges = f.select("bucket", "src_ip", "dst_ip", "dst_port").distinct().withColumn("one", F.lit(1))
    kept = with_previous(edges, ["src_ip", "dst_ip", "dst_port"], ["one"], idx).groupBy("bucket").agg(
        F.count("*").alias("edges"), F.count("prev_one").alias("kept"))
    x = base.join(fan, "bucket").join(peers, "bucket").join(port, "bucket", "left").join(proto, "bucket", "left").join(
        gini, "bucket", "left").join(kept, "bucket")
    w = W.partitionBy(F.lit(0)).orderBy("bucket")
    prev_edges = F.lag("edges").over(w)
    churn = F.when(prev_edges.isNull(), 0.0).otherwise(
        (F.col("edges") + prev_edges - 2 * F.col("kept")) / F.greatest(F.lit(1.0), F.col("edges") + prev_edges))
    fresh = F.when(prev_edges.isNull(), 0.0).otherwise(
        F.coalesce("fresh", F.lit(0)) / F.greatest(F.lit(1.0), F.col("peers").cast("double")))
    x = x.withColumns({"edge_churn_rate": churn, "new_peer_rate": fresh, "port_entropy": F.coalesce("port_entropy", F.lit(0.0))})
    novelty = F.least(F.lit(5.0), F.col("new_peer_rate") * 2 + F.col("edge_churn_rate") * 1.5 + F.col("port_entropy") / 8)
    return x.select("bucket", F.col("n").alias("flow_count"), (F.col("peers") / F.col("n")).alias("peer_diversity"),
                    "new_peer_rate", (F.col("dsts") / F.col("n")).alias("dest_diversity"),
                    (F.col("srcs") / F.col("n")).alias("src_diversity"), "port_entropy", "protocol_entropy",
                    (F.col("n") / F.col("dsts")).alias("fan_in_ratio"), (F.col("n") / F.col("srcs")).alias("fan_out_ratio"),
                    "traffic_concentration_gini", "edge_churn_rate", (F.col("short") / F.col("n")).alias("connection_churn_rate"),
                    novelty.alias("behavioral_novelty_score"), F.col("peers").alias("node_count"), F.col("edges").alias("edge_count"))


def host_fans(flows: DataFrame, seconds: int) -> DataFrame:
    """Per (window, host): outbound peers, inbound peers, probed ports."""
    e = flows.withColumn("bucket", bucket("start_ts", seconds)).select("bucket", "src_ip", "dst_ip", "dst_port").distinct()
    out = e.groupBy("bucket", F.col("src_ip").alias("entity")).agg(
        F.count_distinct("dst_ip").alias("out_peers"), F.count_distinct(F.when(F.col("dst_port") > 0, F.col("dst_port"))).alias("probed_ports"))
    inn = e.groupBy("bucket", F.col("dst_ip").alias("entity")).agg(F.count_distinct("src_ip").alias("in_peers"))
    z = F.lit(0).cast("bigint")
    j = out.join(inn, ["bucket", "entity"], "full_outer")
    return j.select("bucket", "entity", *[F.coalesce(n, z).alias(n) for n in ("out_peers", "in_peers", "probed_ports")])


def risk_indicators(fans: DataFrame, vectors: DataFrame) -> DataFrame:
    """Six host and network indicators with severity and how often each has fired for the entity so far."""
    o, i, p = F.col("out_peers"), F.col("in_peers"), F.col("probed_ports")

    def row(name: str, cond: Column, value: Column, sev: Column, conf: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("indicator_type"), value.cast("double").alias("value"),
                                     sev.alias("severity"), conf.cast("double").alias("confidence")))
    hosts = F.array_compact(F.array(
        row("ABNORMAL_OUTBOUND_FANOUT", o >= 15, o, choose((o >= 50, "CRITICAL"), (o >= 25, "HIGH"), default="MEDIUM"),
            F.least(F.lit(0.95), 0.5 + o / 100.0)),
        row("ABNORMAL_INBOUND_FANIN", i >= 20, i, choose((i >= 40, "HIGH"), default="MEDIUM"),
            F.least(F.lit(0.92), 0.6 + i / 100.0)),
        row("UNUSUAL_SERVICE_EXPOSURE_PROBING", p >= 8, p, choose((p >= 20, "HIGH"), default="MEDIUM"),
            F.least(F.lit(0.95), 0.6 + p / 50.0))))
    n, c, g = F.col("new_peer_rate"), F.col("edge_churn_rate"), F.col("traffic_concentration_gini")
    net = F.array_compact(F.array(
        row("RAPID_PEER_EXPANSION", (n > 0.4) & (F.col("node_count") >= 5), n, choose((n > 0.7, "HIGH"), default="MEDIUM"),
            F.least(F.lit(0.90), 0.5 + n * 0.4)),
        row("HIGH_COMMUNICATION_CHURN", (c > 0.6) & (F.col("edge_count") >= 10), c, F.lit("MEDIUM"),
            F.least(F.lit(0.88), 0.5 + c * 0.4)),
        row("ABNORMAL_TRAFFIC_CONCENTRATION", g > 0.85, g, F.lit("MEDIUM"), F.lit(0.8))))
    rows = fans.select("bucket", "entity", F.explode(hosts).alias("_x")).unionByName(
        vectors.select("bucket", F.lit("network").alias("entity"), F.explode(net).alias("_x"))).select("bucket", "entity", "_x.*")
    w = W.partitionBy("indicator_type", "entity").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("persistence", F.count("*").over(w))


EVIDENCE = ["evidence_id", "scope", "modality", "source", "severity", "confidence", "technique"]


def _evidence(df: DataFrame, rows: Sequence[tuple[Column, str, str, str, Column, Column, str]]) -> DataFrame:
    arr = F.array_compact(F.array(*[F.when(cond, F.struct(
        F.lit(eid).alias("evidence_id"), F.lit("OBSERVED").alias("scope"), F.lit(mod).alias("modality"),
        F.lit(src).alias("source"), sev.alias("severity"), conf.cast("double").alias("confidence"), F.lit(tech).alias("technique")))
        for cond, eid, mod, src, sev, conf, tech in rows]))
    return df.select(F.explode(arr).alias("_x")).select("_x.*")


def session_evidence(metrics: DataFrame) -> DataFrame:
    f = F.col("failed_connection_ratio")
    return _evidence(metrics, [
        ((f >= 0.5) & (F.col("attempted_sessions") >= 3), "tcp-failed-connections", "PROTOCOL", "tcp_session_state",
         choose((f >= 0.8, "HIGH"), default="MEDIUM"), F.lit(0.9), "T1046"),
        ((F.col("rejected_sessions") >= 3) & (F.col("reset_ratio") >= 0.3), "tcp-rejected-connections", "PROTOCOL",
         "tcp_session_state", F.lit("MEDIUM"), F.lit(0.85), "T1046")])


def flow_evidence(summary: DataFrame) -> DataFrame:
    s, b = F.col("single_packet_flow_ratio"), F.col("bursty_flow_count")
    return _evidence(summary, [
        ((F.col("total_flows") >= 20) & (s >= 0.6), "flow-sweep", "ANOMALY", "flow_statistics",
         choose((s < 0.85, "MEDIUM"), default="HIGH"), r(F.least(F.lit(1.0), s), 2), "T1046"),
        (b >= 5, "flow-burst", "ANOMALY", "flow_statistics", choose((b >= 15, "HIGH"), default="MEDIUM"), F.lit(0.8), "T1498")])


def signature_evidence(alerts: DataFrame) -> DataFrame:
    """One evidence row per alert; numeric severity 1..4 to CRITICAL..LOW."""
    sev = choose((F.col("severity") == 1, "CRITICAL"), (F.col("severity") == 2, "HIGH"), (F.col("severity") == 3, "MEDIUM"),
                 default="LOW")
    return alerts.select(F.concat(F.lit("sig-"), F.col("alert_id")).alias("evidence_id"), F.lit("OBSERVED").alias("scope"),
                         F.lit("SIGNATURE").alias("modality"), F.lit("signature_alerts").alias("source"), sev.alias("severity"),
                         F.lit(0.95).alias("confidence"), "technique")


def finding_evidence(findings: DataFrame) -> DataFrame:
    recon = F.col("attack_category").rlike("reconnaissance|scan")
    return findings.select(F.col("finding_id").alias("evidence_id"), F.lit("OBSERVED").alias("scope"),
                           F.lit("ANOMALY").alias("modality"), F.lit("heuristics").alias("source"),
                           F.upper("severity").alias("severity"), F.lit(0.85).alias("confidence"),
                           F.when(recon, "T1046").otherwise("T1498").alias("technique"))


def beacon_evidence(beacons: DataFrame) -> DataFrame:
    return beacons.filter("is_beaconing").select(
        F.concat(F.lit("beacon-"), "src_ip", F.lit("-"), "dst_ip", F.lit("-"), "dst_port", F.lit("-"), "protocol").alias("evidence_id"),
        F.lit("OBSERVED").alias("scope"), F.lit("BEHAVIOR").alias("modality"), F.lit("beaconing").alias("source"),
        F.when(F.col("score") >= 0.7, "HIGH").otherwise("MEDIUM").alias("severity"), "confidence", F.lit("T1071").alias("technique"))


def forecast_evidence(points: DataFrame) -> DataFrame:
    p = F.col("probability")
    return points.filter(p >= 0.5).select(
        F.concat(F.lit("forecast-T+"), F.col("horizon")).alias("evidence_id"), F.lit("FORECAST").alias("scope"),
        F.lit("FORECAST").alias("modality"), F.lit("forecast").alias("source"),
        F.when(p >= 0.75, "HIGH").otherwise("MEDIUM").alias("severity"), r(F.abs(p - 0.5) * 2, 2).alias("confidence"),
        F.lit("T1071").alias("technique"))


def fuse_threat(evidence: DataFrame) -> DataFrame:
    """Current and future risk, stage and technique sets from the union of all evidence rows."""
    obs, fc = F.col("scope") == "OBSERVED", F.col("scope") == "FORECAST"
    g = evidence.groupBy().agg(
        F.count("*").alias("evidence_count"), count_when(fc).alias("_fc"),
        F.bool_or(obs & F.col("severity").isin("HIGH", "CRITICAL")).alias("_high"),
        F.bool_or(obs & (F.col("severity") == "MEDIUM")).alias("_med"),
        F.bool_or(obs & (F.col("technique") == "T1046")).alias("_scan"), F.bool_or(obs & (F.col("technique") == "T1071")).alias("_c2"),
        F.count_distinct(F.when(obs, F.col("modality"))).alias("observed_modalities"),
        F.array_join(F.array_sort(F.collect_set(F.when(obs, F.col("technique")))), ",").alias("observed_techniques"),
        F.array_join(F.array_sort(F.collect_set(F.when(fc, F.col("technique")))), ",").alias("forecast_techniques"))
    cur = choose((F.col("_high"), "HIGH"), (F.col("_med"), "MEDIUM"), default="LOW")
    return g.withColumn("current_risk", cur).select(
        "evidence_count", "observed_modalities", "observed_techniques", "forecast_techniques", "current_risk",
        choose((F.col("_fc") == 0, "UNKNOWN"), (F.col("current_risk") == "HIGH", "HIGH"), default="MEDIUM").alias("future_risk"),
        choose((F.col("_scan"), "Reconnaissance / Initial Access"), (F.col("_c2"), "Command & Control"),
               default="Benign Observation").alias("attack_stage"))


def sensor_agreement(items: DataFrame, key: str) -> DataFrame:
    """STRONG / PARTIAL / MIXED / CONFLICTING / UNKNOWN from distinct sources per polarity."""
    per = items.groupBy(key, "source").agg(F.bool_or(F.col("polarity") == "SUPPORTING").alias("s"),
                                           F.bool_or(F.col("polarity") == "CONTRADICTORY").alias("c"))
    g = per.groupBy(key).agg(count_when(F.col("s")).alias("supporting_sources"), count_when(F.col("c")).alias("contradicting_sources"),
                             count_when(~F.col("s") & ~F.col("c")).alias("neutral_sources"))
    s, c, n = F.col("supporting_sources"), F.col("contradicting_sources"), F.col("neutral_sources")
    level = choose((c > 0, "CONFLICTING"), (s >= 2, "STRONG"), ((s == 1) & (n > 0), "MIXED"), (s == 1, "PARTIAL"), default="UNKNOWN")
    mod = choose(((s > 0) & (c > 0), 0.45), (s >= 2, 1.15), ((s == 1) & (n > 0), 0.95), (s == 1, 1.0), (c > 0, 0.30), default=0.60)
    return g.withColumns({"agreement_level": level, "confidence_modifier": mod})


def fuse_evidence(items: DataFrame, key: str) -> DataFrame:
    """Mean supporting confidence x agreement modifier, less 0.15 per contradiction (at most 0.4)."""
    sup, con = F.col("polarity") == "SUPPORTING", F.col("polarity") == "CONTRADICTORY"
    g = items.groupBy(key).agg(count_when(sup).alias("supporting_count"), count_when(con).alias("contradictory_count"),
                               count_when(~sup & ~con).alias("neutral_count"), F.count_distinct("source").alias("source_diversity"),
                               F.avg(F.when(sup, F.col("confidence"))).alias("_avg"))
    j = g.join(sensor_agreement(items, key).select(key, "agreement_level", "confidence_modifier"), key)
    raw = F.col("_avg") * F.col("confidence_modifier")
    penal = F.greatest(F.lit(0.1), raw - F.least(F.lit(0.4), 0.15 * F.col("contradictory_count")))
    conf = choose((F.col("supporting_count") > 0, clip(F.when(F.col("contradictory_count") > 0, penal).otherwise(raw), 0.0, 1.0)),
                  (F.col("contradictory_count") > 0, 0.2), default=0.5)
    return j.withColumn("confidence", r(conf, 4)).drop("_avg", "confidence_modifier")
