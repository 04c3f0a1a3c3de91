"""Moments, Mahalanobis scores and logistic fits against NumPy."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import evaluate as ev, solvers as so


def numpy_newton(x, y, l2, balanced=True, at=None):
    """Dense Newton on standardised columns of positive spread; returns the probabilities of ``x``, or of ``at``."""
    mean, std = x.mean(axis=0), x.std(axis=0, ddof=1)
    on = std > 0
    z = np.column_stack([np.ones(len(x)), (x[:, on] - mean[on]) / std[on]])
    w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) if balanced else np.full(len(y), 1 / len(y))
    pen = np.r_[0.0, np.full(on.sum(), l2)]
    b = np.zeros(z.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * q * (1 - q))[:, None]).T @ z + np.diag(pen), z.T @ (w * (q - y)) + pen * b)
    if at is not None:
        z = np.column_stack([np.ones(len(at)), (at[:, on] - mean[on]) / std[on]])
    return 1 / (1 + np.exp(-z @ b))


def sample(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 1e6] + [0.0, 1e4, 1e9]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 1e4) / 100)))).astype(int)
    return x, y


@pytest.mark.parametrize("l2", [0.0, 1e-3, 1e-1])
@pytest.mark.parametrize("parts", [1, 7])
def test_newton_equals_numpy(spark, l2, parts):
    x, y = sample()
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "i int, a double, b double, c double, y int").repartition(parts)
    m = so.newton_logistic(df, ["a", "b", "c"], "y", l2)
    got = {r["i"]: r["p"] for r in df.select("i", m.probability().alias("p")).collect()}
    want = numpy_newton(x, y, l2)
    assert m.converged and max(abs(got[i] - want[i]) for i in got) < 1e-9


def test_missing_values_have_an_indicator_and_no_row_is_lost(spark):
    x, y = sample(400)
    gone = np.random.default_rng(1).random(400) < 0.3
    rows = [(i, float(r[0]), None if g else float(r[1]), int(t)) for i, (r, g, t) in enumerate(zip(x, gone, y))]
    rows[5] = (5, rows[5][1], float("nan"), rows[5][3])
    gone[5] = True
    df = spark.createDataFrame(rows, "i int, a double, b double, y int").repartition(3)
    m = so.newton_logistic(df, ["a", "b"], "y", 1e-3)
    got = {r["i"]: r["p"] for r in ev.score(m, df).collect()}
    filled = np.column_stack([x[:, 0], np.where(gone, x[~gone, 1].mean(), x[:, 1]), gone.astype(float)])
    want = numpy_newton(filled, y, 1e-3)
    assert len(got) == 400 and max(abs(got[i] - want[i]) for i in got) < 1e-9


def test_many_labels_equal_single_fits(spark):
    """Each label by itself; one is NULL in places, one has a single class."""
    x, y = sample(300)
    rng = np.random.default_rng(2)
    other = [None if u < 0.2 else int(u > 0.6) for u in rng.random(300)]
    df = spark.createDataFrame([(i, float(r[0]), int(t), o, 1) for i, (r, t, o) in enumerate(zip(x, y, other))], "i int, a double, y1 int, y2 int, y3 int").repartition(4)
    one, two, three = so.newton_logistics(df, ["a"], ["y1", "y2", "y3"])
    assert three is None
    p = {r["i"]: r for r in df.select("i", one.probability().alias("p1"), two.probability().alias("p2")).collect()}
    want = numpy_newton(x[:, :1], y, 1e-3)
    assert max(abs(p[i]["p1"] - want[i]) for i in p) < 1e-9
    # the second label's weights by their zero gradient over its own rows
    z = (x[:, 0] - x[:, 0].mean()) / x[:, 0].std(ddof=1)
    keep = np.array([o is not None for o in other])
    t = np.array([o or 0 for o in other])
    w = np.where(t > 0, 0.5 / t[keep].sum(), 0.5 / (keep.sum() - t[keep].sum())) * keep
    res = w * (np.array([p[i]["p2"] for i in range(300)]) - t)
    assert abs(res.sum()) < 1e-9 and abs((res * z).sum() + 1e-3 * two.weights[0]) < 1e-9


def test_degenerate_fits(spark):
    schema = "a double, b double, y int"
    assert so.newton_logistic(spark.createDataFrame([], schema), ["a"], "y") is None
    assert so.newton_logistic(spark.createDataFrame([(1.0, None, 1), (2.0, None, None)], schema), ["a"], "y") is None
    constant = spark.createDataFrame([(1.0, None, i % 2) for i in range(10)], schema)
    m = so.newton_logistic(constant, ["a", "b"], "y")
    assert {round(r["p"], 9) for r in ev.score(m, constant).collect()} == {0.5}
    twins = spark.createDataFrame([(float(i), float(i), int(i * 7 % 10 > 4)) for i in range(40)], schema)  # equal columns
    m = so.newton_logistic(twins, ["a", "b"], "y", 0.0)
    assert m.converged and abs(m.weights[0] - m.weights[1]) < 1e-8
    apart = spark.createDataFrame([(float(i), None, int(i >= 5)) for i in range(10)], schema)  # no finite optimum
    m = so.newton_logistic(apart, ["a"], "y", 0.0, steps=8)
    assert not m.converged and all(math.isfinite(r["p"]) for r in ev.score(m, apart).collect())


def test_platt_equals_numpy(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.random(300), 3)
    y = (rng.random(300) < p ** 2).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "i int, p double, target int")
    out = ev.platt(df, df.unionByName(spark.createDataFrame([(-1, None, 0)], df.schema))).collect()
    got = {r["i"]: r["p_calibrated"] for r in out}
    want = numpy_newton(np.log(np.maximum(p, 1e-6) / np.maximum(1 - p, 1e-6))[:, None], y, 0.0)
    assert max(abs(got[i] - want[i]) for i in range(300)) < 1e-9
    assert got[-1] is None and {r["calibration_status"] for r in out} == {"CALIBRATED", "NO_PROBABILITY"}


def vectors(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) + 1e3).astype(np.float32)
    rows = [(i, i % 4, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, 0, None), (1001, 0, []), (1002, 0, [1.0] * 5), (1003, 0, [None] + [1.0] * 5), (1004, 1, [float("nan")] * 6), (1005, 1, [float("inf")] * 6)]
    return x.astype(float), spark.createDataFrame(rows + odd, "id int, g int, v array<float>")


@pytest.mark.parametrize("parts", [1, 5])
def test_vector_scores_equal_numpy(spark, parts):
    x, df = vectors(spark)
    df = df.repartition(parts)
    train = np.arange(500) % 4 < 2
    diag = {r["id"]: r for r in so.vector_diag_mahalanobis(df, "v", F.col("g") < 2).collect()}
    z = np.sqrt(((x - x[train].mean(axis=0)) ** 2 / np.maximum(x[train].var(axis=0, ddof=1), 1e-4)).mean(axis=1))
    assert max(abs(diag[i]["ood_score"] - z[i]) for i in range(500)) < 1e-9
    full = {r["id"]: r for r in so.vector_full_mahalanobis(df, "v", F.col("g") < 2).collect()}
    inv, dev = np.linalg.inv(np.cov(x[train].T) + 1e-3 * np.eye(6)), x - x[train].mean(axis=0)
    d = np.sqrt(np.einsum("ij,jk,ik->i", dev, inv, dev))
    assert max(abs(full[i]["distance"] - d[i]) for i in range(500)) < 1e-8
    p95, p99 = np.quantile(d[train], [0.95, 0.99])
    assert all(full[i]["ood_level"] == ("OUT" if d[i] > p99 else "BORDER" if d[i] > p95 else "IN") for i in range(500) if min(abs(d[i] - p95), abs(d[i] - p99)) > 1e-7)
    for i in range(1000, 1006):
        assert diag[i]["ood_score"] is None and diag[i]["is_ood"] is None and full[i]["distance"] is None and full[i]["ood_level"] is None


def test_vector_scores_of_empty_and_single_rows(spark):
    empty = spark.createDataFrame([], "id int, v array<double>")
    assert so.vector_diag_mahalanobis(empty, "v", F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    assert so.vector_diag_mahalanobis(one, "v", F.lit(True)).first()["ood_score"] is None
    assert so.vector_full_mahalanobis(one, "v", F.lit(True)).first()["distance"] is None


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
def test_horizon_models_equal_numpy_on_the_tables(spark):
    """Every prediction of the registered forecast, all horizons."""
    from packetloom.plans import i_forecast as plan
    train, test = (t.toPandas() for t in plan.train_test(spark, SF))
    got = {(r["source_bucket"], r["horizon"]): r["p"] for r in plan.fc12(spark, SF).collect()}
    fill = train[plan.FLAT].astype(float).mean()
    design = lambda t: np.column_stack([t[plan.FLAT].astype(float).fillna(fill).to_numpy(), t[plan.FLAT].isna().to_numpy(float)])
    assert len(got) == 5 * len(test)
    for k in range(1, 6):
        want = numpy_newton(design(train), train[f"y{k}"].to_numpy(float), 1e-3, at=design(test))
        assert max(abs(got[(b, k)] - w) for b, w in zip(test["source_bucket"], want)) <= 0.5e-4 + 1e-6  # shown with four places


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
def test_static_detection_equals_numpy_on_the_tables(spark):
    """The confusion counts of the registered query; flows without a port take part."""
    from packetloom.plans import base, i_forecast as plan
    cols = ["fwd_bytes", "rev_bytes", "fwd_packets", "rev_packets", "dst_port"]
    f = base.flows(spark, SF).select("start_ts", "end_ts", "state", *cols).toPandas()
    day, y = np.floor(f["start_ts"] / 86400), (f["state"] == "REJECTED").to_numpy(float)
    raw = np.column_stack([f["end_ts"] - f["start_ts"], f[cols].astype(float)])
    early = (day < (day.min() + day.max()) / 2).to_numpy()
    x = np.column_stack([np.where(np.isnan(raw), np.nanmean(raw[early], axis=0), raw), np.isnan(raw)])
    p = numpy_newton(x[early], y[early], 1e-3, at=x[~early])
    assert np.abs(p - 0.5).min() > 1e-7  # no row on the border
    got = plan.ev14(spark, SF).first()
    t = y[~early] == 1
    assert (got["n"], got["tp"], got["fp"], got["fn"], got["tn"]) == (len(p), *(int(v.sum()) for v in ((p >= 0.5) & t, (p >= 0.5) & ~t, (p < 0.5) & t, (p < 0.5) & ~t)))
