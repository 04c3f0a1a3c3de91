"""Interval statistics: the array form and the segment form give the same values, also as plain Python has them."""

import math
import random
import statistics

from packetloom.operators import behavior as bh

STATS = ["interval_count", "mean_interval", "std_interval", "jitter", "median_interval", "mad_interval", "interval_entropy", "bowley_skewness"]


def times(seed=5):
    rng = random.Random(seed)
    out = {"steady": [60.0 * i for i in range(50)], "two": [1.0, 7.5], "three": [0.0, 1.0, 5.0], "same": [9.0] * 6, "one": [4.0],
           "repeats": [1.0, 1.0, 3.0, 3.0, 3.0, 8.0, 20.0, 20.0], "days": [86400.0 * i + (i % 3) * 100 for i in range(12)],
           "noise": [round(rng.random() * 300000, 2) for _ in range(200)]}
    return out


def plain(ts):
    t = sorted(set(ts))
    x = [b - a for a, b in zip(t, t[1:])]
    med = statistics.median(x)
    s, lo, hi, counts = sorted(x), min(x), max(x), {}
    for v in x:
        if hi - lo >= 1e-6:
            b = min(math.floor((v - lo) / ((hi - lo) / 10)), 9)
            counts[b] = counts.get(b, 0) + 1
    ent = math.log2(len(x)) - sum(k * math.log2(k) for k in counts.values()) / len(x) if counts else 0.0
    skew = None
    if len(x) >= 4:
        q1, q3 = statistics.median(s[:len(s) // 2]), statistics.median(s[-(len(s) // 2):])
        skew = 0.0 if q3 - q1 < 1e-6 else max(-1.0, min(1.0, (q3 + q1 - 2 * med) / (q3 - q1)))
    jit = [abs(b - a) for a, b in zip(x, x[1:])]
    return [len(x), statistics.fmean(x), statistics.pstdev(x), statistics.fmean(jit) if jit else 0.0, med, statistics.median(abs(v - med) for v in x), ent, skew]


def close(a, b):
    return a is b if a is None or b is None else abs(a - b) < 1e-6


def test_array_and_segment_forms_equal_plain_python(spark):
    data = times()
    df = spark.createDataFrame([(k, t) for k, ts in data.items() for t in ts] + [("steady", None), ("void", None)], "k string, t double").repartition(4)
    arrays = {r["k"]: r for r in bh.interval_shape_arrays(df, ["k"], "t").collect()}
    rows = {r["k"]: r for r in bh.interval_shape(bh.interval_rows(df, ["k"], "t", 86400), ["k"]).collect()}
    want = {k: plain(ts) for k, ts in data.items() if len(set(ts)) > 1}
    assert set(arrays) == set(rows) == set(want)
    for k, w in want.items():
        for got in (arrays[k], rows[k]):
            assert all(close(got[n], v) for n, v in zip(STATS, w)), (k, [got[n] for n in STATS], w)


def test_periodicity_does_not_depend_on_the_bound(spark):
    rows = [(k, "d", None if k == "days" else 443, "TCP", t) for k, ts in times().items() for t in ts]
    df = spark.createDataFrame(rows, "src_ip string, dst_ip string, dst_port int, protocol string, start_ts double").repartition(3)
    rounded = lambda out: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.collect()), key=repr)
    a, b, c = (rounded(bh.periodicity(df, array_events=n)) for n in (1 << 16, 40, 0))
    assert a == b == c and len(a) == 8
    assert bh.periodicity(df.limit(0)).count() == 0
