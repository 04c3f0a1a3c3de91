"""Forecast metrics, calibration, generalisation, outlier scores, model search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from packetloom.functions.columns import choose, count_when, r
from packetloom.operators.solvers import Logistic, complete, newton_logistic, newton_logistics

W = Window
c = F.col


def confusion(preds: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall, F1, accuracy, FPR, FNR, Brier; NULL with a reason where undefined."""
    y, hit = c("target") == 1, c("p") >= threshold
    ok = c("p").isNotNull() & c("target").isNotNull()
    g = preds.groupBy(*keys).agg(
        F.count("*").alias("total"), count_when(ok).alias("n"), count_when(ok & y & hit).alias("tp"), count_when(ok & ~y & hit).alias("fp"),
        count_when(ok & ~y & ~hit).alias("tn"), count_when(ok & y & ~hit).alias("fn"), F.avg(F.when(ok, F.pow(c("p") - c("target"), 2))).alias("_b"))
    rate = lambda a, b: F.when(b > 0, r(a / b, 4))
    g = g.withColumns({"precision": rate(c("tp"), c("tp") + c("fp")), "recall": rate(c("tp"), c("tp") + c("fn")),
                       "accuracy": rate(c("tp") + c("tn"), c("n")), "fpr": rate(c("fp"), c("fp") + c("tn")), "fnr": rate(c("fn"), c("fn") + c("tp")),
                       "brier": r(c("_b"), 4), "coverage": r(c("n") / c("total"), 4)}).drop("_b")
    pr = c("precision") + c("recall")
    return g.withColumns({"f1": F.when(pr > 0, r(2 * c("precision") * c("recall") / pr, 4)).when(pr == 0, 0.0),
                          "undefined_reason": choose((c("precision").isNull(), "no positive predictions"), (c("recall").isNull(), "no positive truths"))})


def ece_bins(preds: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Reliability rows of uniform bins (empty ones included)."""
    b = F.least(F.floor(c("p") * bins + 1e-12), F.lit(bins - 1)).cast("int")
    g = preds.filter("p IS NOT NULL").groupBy(*keys, b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(c("target").cast("double")).alias("accuracy"), F.avg("p").alias("confidence"))
    grid = (preds.select(*keys).distinct() if keys else preds.sparkSession.range(1).select()).withColumn("bin", F.explode(F.array(*[F.lit(i) for i in range(bins)])))
    x = grid.join(g, [*keys, "bin"], "left")
    return x.withColumns({"n": F.coalesce("n", F.lit(0).cast("bigint")), "error": F.abs(c("accuracy") - c("confidence"))})


def calibration_error(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n = F.sum("n")
    return bins.groupBy(*keys).agg((F.sum(c("n") * F.coalesce("error", F.lit(0.0))) / n).alias("ece"), F.max("error").alias("mce"), n.alias("n"))


def auc(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC by rank sums with tied ranks and average precision by distinct score.

    Works on one row per distinct score. Scores are ranked inside 4,096 bins of [0, 1]; only the bin
    totals are ordered as a whole, so many distinct scores do not meet in one task.
    """
    keys = list(keys)
    b = F.least(F.greatest(F.floor(c("p") * 4096), F.lit(0)), F.lit(4096)).cast("int")
    s = preds.filter("p IS NOT NULL").groupBy(*keys, "p", b.alias("_bin")).agg(F.sum(c("target").cast("bigint")).alias("pos"), F.count("*").alias("n"))
    part = keys or [F.lit(0)]
    low = W.partitionBy(*part).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    high = W.partitionBy(*part).orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1)
    z = lambda x: F.coalesce(x, F.lit(0))
    bins = s.groupBy(*keys, "_bin").agg(F.sum("pos").alias("_bp"), F.sum("n").alias("_bn"))
    bins = bins.select(*keys, "_bin", z(F.sum("_bn").over(low)).alias("_n0"), z(F.sum("_bp").over(high)).alias("_p1"),
                       z(F.sum("_bn").over(high)).alias("_n1"), F.sum("_bp").over(W.partitionBy(*part)).alias("_P"))
    up = W.partitionBy(*keys, "_bin").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys, "_bin").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumns({"_u": F.sum("n").over(up), "_dp": F.sum("pos").over(down), "_dn": F.sum("n").over(down)}).join(bins, [*keys, "_bin"])
    avg_rank = c("_n0") + c("_u") - c("n") + (c("n") + 1) / 2.0
    prec = (c("_p1") + c("_dp")) / (c("_n1") + c("_dn"))
    g = s.groupBy(*keys).agg(F.sum("pos").alias("positives"), (F.sum("n") - F.sum("pos")).alias("negatives"), F.sum(c("pos") * avg_rank).alias("_r"),
                             F.sum(prec * c("pos") / F.nullif(c("_P"), F.lit(0))).alias("_ap"))
    P, N = c("positives"), c("negatives")
    both = (P > 0) & (N > 0)
    return g.withColumns({"roc_auc": F.when(both, (c("_r") - P * (P + 1) / 2.0) / (P * N)), "average_precision": F.when(both, c("_ap"))}).drop("_r", "_ap")


def against_baseline(metrics: DataFrame, baseline: str = "persistence") -> DataFrame:
    """Per model and horizon the difference to a baseline model."""
    b = metrics.filter(c("model") == baseline).select("horizon", c("f1").alias("_f"), c("brier").alias("_b"))
    return metrics.join(F.broadcast(b), "horizon", "left").withColumns({"delta_f1": c("f1") - c("_f"), "delta_brier": c("brier") - c("_b")}).drop("_f", "_b")


def family_holdout(preds: DataFrame, family: str, unseen: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Each held-out family against all known ones: F1 retention and verdict."""
    x = preds.withColumn("_g", F.when(c(family).isin(*unseen), c(family)).otherwise("known"))
    m = confusion(x, ["_g"], threshold)
    known = m.filter("_g = 'known'").agg(F.max("f1").alias("f")).scalar()
    f = m.filter("_g <> 'known'").withColumn("known_f1", known)
    return f.select(c("_g").alias("held_out_family"), c("f1").alias("unseen_f1"), "known_f1", r(c("f1") / F.greatest(F.lit(1e-4), c("known_f1")), 4).alias("f1_retention"),
                    choose((c("f1").isNull(), "INSUFFICIENT_EVALUATION_DATA"), (c("f1") >= 0.70, "ROBUST_GENERALIZATION"), default="FAMILY_SPECIFIC_OVERFIT").alias("verdict"))


GRID = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)


def threshold_sweep(preds: DataFrame, keys: Sequence[str] = (), grid: Sequence[float] = GRID) -> DataFrame:
    """F1 and balanced accuracy per threshold from one pass: all thresholds are counted side by side."""
    y = c("target") == 1
    aggs = []
    for i, t in enumerate(grid):
        hit = c("p") >= t
        aggs += [count_when(y & hit).alias(f"tp{i}"), count_when(~y & hit).alias(f"fp{i}"), count_when(y & ~hit).alias(f"fn{i}"), count_when(~y & ~hit).alias(f"tn{i}")]
    g = preds.groupBy(*keys).agg(*aggs, F.count("*").alias("_all")).filter("_all > 0")
    arr = F.array(*[F.struct(F.lit(t).alias("threshold"), *[c(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(grid)])
    x = g.select(*keys, F.explode(arr).alias("_x")).select(*keys, "_x.*")
    tpr = F.coalesce(F.try_divide(c("tp"), c("tp") + c("fn")), F.lit(0.0))
    tnr = F.coalesce(F.try_divide(c("tn"), c("tn") + c("fp")), F.lit(0.0))
    return x.withColumns({"f1": F.coalesce(F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), F.lit(0.0)), "balanced_accuracy": (tpr + tnr) / 2})


def best_threshold(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rank = F.struct("f1", "balanced_accuracy", (-c("threshold")).alias("t"))
    return sweep.groupBy(*keys).agg(F.max_by("threshold", rank).alias("threshold"), F.max("f1").alias("f1")).filter("threshold IS NOT NULL")


def selective(preds: DataFrame, keys: Sequence[str] = (), threshold: float = 0.5, margin: float = 0.05) -> DataFrame:
    """F1 before and after dropping scores close to the threshold, with coverage."""
    y, hit = c("target") == 1, c("p") >= threshold
    keep = F.abs(c("p") - threshold) >= margin
    f1 = lambda tp, fp, fn: F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    cnt = lambda cond: count_when(cond)
    g = preds.groupBy(*keys).agg(F.count("*").alias("total"), cnt(~keep).alias("abstained"),
                                 f1(cnt(y & hit), cnt(~y & hit), cnt(y & ~hit)).alias("raw_f1"),
                                 f1(cnt(keep & y & hit), cnt(keep & ~y & hit), cnt(keep & y & ~hit)).alias("selective_f1"))
    return g.withColumns({"coverage": 1.0 - c("abstained") / F.greatest(c("total"), F.lit(1)), "f1_improvement": c("selective_f1") - c("raw_f1")})


def lead_time(alerts: DataFrame, onsets: DataFrame, back: int = 2) -> DataFrame:
    """First alert within ``back`` windows before each onset (or at it).

    The range join is an equi join: each onset is spread over the few windows it may match.
    """
    o = onsets.select("episode_id", c("bucket").alias("onset")).withColumn("bucket", F.explode(F.sequence(c("onset") - back, c("onset"))))
    j = o.join(alerts.select("episode_id", "bucket", F.lit(True).alias("_a")).distinct(), ["episode_id", "bucket"], "left")
    g = j.groupBy("episode_id", "onset").agg(F.min(F.when(c("_a"), c("bucket"))).alias("first_alert"),
                                             F.bool_or(F.coalesce("_a", F.lit(False)) & (c("bucket") == c("onset"))).alias("onset_recalled"))
    return g.withColumn("lead_steps", F.coalesce(c("onset") - c("first_alert"), F.lit(0)))


def diag_mahalanobis(rows: DataFrame, features: Sequence[str], train: Column, floor: float = 1e-4, limit: float = 3.5) -> DataFrame:
    """Root mean squared z-score of each row under per-feature training moments."""
    m = rows.filter(train).agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.greatest(F.var_samp(f), F.lit(floor)).alias(f"v_{f}") for f in features])
    m = m.select(F.struct("*").alias("m")).scalar()
    x = rows.withColumn("_m", m)
    z = sum((F.pow(c(f) - c(f"_m.m_{f}"), 2) / c(f"_m.v_{f}") for f in features), F.lit(0.0)) / len(features)
    return x.withColumn("ood_score", F.sqrt(z)).withColumn("is_ood", c("ood_score") > limit).drop("_m")


def full_mahalanobis(rows: DataFrame, features: Sequence[str], train: Column, ridge: float = 1e-3) -> DataFrame:
    """Mahalanobis score with a ridge covariance.

    Only the d x d covariance of the training rows comes to the driver, where it is inverted; the scores
    are a column expression and the p95 / p99 limits exact training quantiles.
    """
    import numpy as np

    from packetloom.functions.quantiles import group_quantiles
    d = len(features)
    cov = [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    row = rows.filter(train).agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *cov).first()
    mat = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    # with inverse = L L^T the distance is the norm of L^T (x - mean): d dot products of length d
    low = np.linalg.cholesky(np.linalg.inv(mat + ridge * np.eye(d)))
    rows_of_lt = F.array(*[F.array(*[F.lit(float(low[j, i])) for j in range(d)]) for i in range(d)])
    dev = F.array(*[c(f).cast("double") - F.lit(float(row[f"m{i}"])) for i, f in enumerate(features)])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    x = rows.withColumn("_dev", dev).withColumn("_y", F.transform(rows_of_lt, lambda l: dot(l, c("_dev"))))
    x = x.withColumn("distance", F.sqrt(F.aggregate("_y", F.lit(0.0), lambda acc, v: acc + v * v))).drop("_dev", "_y")
    lim = group_quantiles(x.filter(train).withColumn("_k", F.lit(0)), ["_k"], "distance", {"p95": 0.95, "p99": 0.99}).first()
    p95, p99 = F.lit(lim["p95"]), F.lit(lim["p99"])
    return x.withColumns({"epistemic": F.least(F.lit(1.0), c("distance") / p99),
                          "ood_level": choose((c("distance") > p99, "OUT"), (c("distance") > p95, "BORDER"), default="IN")})


def model_rank(metrics: DataFrame) -> DataFrame:
    """Rank models by mean, then worst macro-F1, then coverage; incomplete ones come last. One row per model."""
    g = metrics.groupBy("model").agg(F.avg("f1").alias("mean_f1"), F.min("f1").alias("min_f1"), F.avg("coverage").alias("coverage"),
                                     (F.count("f1") == F.count("*")).alias("complete"))
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("complete"), F.desc_nulls_last("mean_f1"), F.desc_nulls_last("min_f1"), F.desc("coverage"), "model")
    return g.withColumn("rank", F.row_number().over(w))


def episode_report(ep: DataFrame) -> DataFrame:
    """Per episode the histogram of consecutive labels and whether it holds both classes."""
    w = W.partitionBy("episode_id").orderBy("bucket")
    x = ep.withColumn("_p", F.lag("attack_state").over(w))
    n = lambda a, b: count_when((c("_p") == a) & (c("attack_state") == b)).alias(f"n{a}{b}")
    return x.groupBy("episode_id").agg(F.count("*").alias("windows"), n(0, 0), n(0, 1), n(1, 0), n(1, 1),
                                       (F.count_distinct("attack_state") > 1).alias("mixed"))


def state_error(ep: DataFrame, features: Sequence[str], horizons: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Scaled error of "nothing changes" per feature and horizon: the reference a state model must beat."""
    w = W.partitionBy("episode_id").orderBy("bucket")
    sd = ep.agg(F.struct(*[F.greatest(F.stddev_pop(f), F.lit(1e-9)).alias(f) for f in features]).alias("s")).scalar()
    x = ep.withColumn("_s", sd).withColumns({f"_e_{f}_{k}": (F.lead(f, k).over(w) - c(f)) / c(f"_s.{f}") for f in features for k in horizons})
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("horizon"), c(f"_e_{f}_{k}").alias("e")) for f in features for k in horizons])
    x = x.select(F.explode(arr).alias("_x")).select("_x.*").filter("e IS NOT NULL")
    return x.groupBy("feature", "horizon").agg(F.count("*").alias("n"), F.avg(c("e") * c("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"))


def hybrid_blend(preds: DataFrame, alphas: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), threshold: float = 0.5) -> DataFrame:
    """F1 of alpha * current label + (1 - alpha) * p for each alpha."""
    x = preds.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas]))).withColumn("p", c("alpha") * c("current") + (1 - c("alpha")) * c("p"))
    return confusion(x, ["alpha"], threshold).select("alpha", "n", "f1", "brier")


def rolling_origin(windows: DataFrame, folds: int = 5) -> DataFrame:
    """Expanding-window folds over time with label counts in train and test."""
    span = windows.agg(F.struct(F.min("bucket").alias("a"), F.max("bucket").alias("b")).alias("s")).scalar()
    x = windows.withColumn("_s", span).withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(1, folds + 1)])))
    width = (c("_s.b") - c("_s.a") + 1) / float(folds + 1)
    cut, end = c("_s.a") + c("fold") * width, c("_s.a") + (c("fold") + 1) * width
    tr, te = c("bucket") < cut, (c("bucket") >= cut) & (c("bucket") < end)
    pos = c("attack_state") == 1
    return x.groupBy("fold").agg(count_when(tr).alias("train_rows"), count_when(tr & pos).alias("train_attacks"), count_when(te).alias("test_rows"),
                                 count_when(te & pos).alias("test_attacks"))


# --- fitted models ------------------------------------------------------------------------------------
def fit_logistic(train: DataFrame, columns: Sequence[str], label: str, l2: float = 1e-3) -> Logistic | None:
    """Class-balanced logistic regression on standardised columns; None when only one class is present.

    A missing value counts as the mean of its column and sets an indicator that has a weight of its own, so no row is left out.
    """
    return newton_logistic(train, columns, label, l2)


def score(model: Logistic, df: DataFrame, name: str = "p") -> DataFrame:
    return df.withColumn(name, model.probability())


def logistic_forecast(train: DataFrame, test: DataFrame, columns: Sequence[str], horizons: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """One balanced logistic model per horizon, fitted in common passes; a horizon with a single class in training gives NULL."""
    models = newton_logistics(train, columns, [f"y{k}" for k in horizons])
    points = [F.struct(F.lit(k).alias("horizon"), c(f"y{k}").alias("target"), (m.probability() if m else F.lit(None).cast("double")).alias("p")) for k, m in zip(horizons, models)]
    return test.select("episode_id", "source_bucket", c("attack_state").alias("current"), F.inline(F.array(*points))).withColumn("model", F.lit("logistic"))


def platt(train: DataFrame, test: DataFrame) -> DataFrame:
    """Logistic on the logit of ``p``; refuses single-class validation data. Rows without ``p`` take no part and stay uncalibrated."""
    logit = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1.0 - p, F.lit(1e-6)))
    m = newton_logistic(train.filter("p IS NOT NULL").withColumn("_l", logit(c("p"))), ["_l"], "target", 0.0)
    if m is None:
        return test.withColumns({"p_calibrated": F.lit(None).cast("double"), "calibration_status": F.lit("CALIBRATION_UNSUPPORTED")})
    return test.withColumn("_l", logit(c("p"))).withColumns({
        "p_calibrated": F.when(c("p").isNotNull(), m.probability()),
        "calibration_status": F.when(c("p").isNull(), "NO_PROBABILITY").otherwise("CALIBRATED" if m.converged else "CALIBRATED_AT_STEP_LIMIT")}).drop("_l")


def candidate_search(train: DataFrame, test: DataFrame, views: dict[str, Sequence[str]], label: str = "y1") -> DataFrame:
    """Feature views x models on the same cases; one result row each, with an eligibility gate.

    Missing values are completed as in ``fit_logistic``, for the perceptron too.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    out = None
    for view, cols in views.items():
        first = fit_logistic(train, cols, label, 1e-3)
        scored = {"logistic": first and score(first, test), "ridge": first and score(fit_logistic(train, cols, label, 1e-1), test)}
        if first is not None:
            names = [f"_c{i}" for i in range(2 * len(cols))]
            full = lambda df: df.withColumns(dict(zip(names, complete(cols, first.fill))))  # noqa: E731, B023
            mlp = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
                                   MultilayerPerceptronClassifier(featuresCol="_scaled", labelCol="_y", layers=[len(names), 8, 2], seed=7, maxIter=30)])
            fitted = mlp.fit(full(train.filter(c(label).isNotNull())).withColumn("_y", c(label).cast("double")))
            scored["mlp"] = fitted.transform(full(test)).withColumn("p", vector_to_array("probability")[1])
        for name, s in scored.items():
            if s is None:
                row = test.agg(F.count("*").alias("n")).select(F.lit(view).alias("view"), F.lit(name).alias("model"), F.lit("TRAINING_CLASS_DIVERSITY_UNSUPPORTED").alias("status"),
                                                               "n", F.lit(None).cast("double").alias("f1"), F.lit(None).cast("double").alias("brier"))
            else:
                row = confusion(s.withColumn("target", c(label))).select(F.lit(view).alias("view"), F.lit(name).alias("model"), F.lit("EVALUATED").alias("status"), "n", "f1", "brier")
            out = row if out is None else out.unionByName(row)
    return out
