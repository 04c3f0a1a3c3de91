"""Quality classifier: document evidence combined with empirical-Bayes priors of its host and path."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.llm.common import as_bytes, join_lookup, numbered, query, slices, staged, table, unboxed

FEATURES = ["symbols", "upper", "digits", "bars", "distinct", "again", "word_bytes", "stops", "same_lines", "log_words"]
SYMBOLS, UPPER, DIGITS = b"#$%&*@^~|<>{}[]=+_\\/!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
#: Priors and evidence stay inside these bounds of the log-odds.
EDGE = 12.0


def features(text: bytes) -> list[float]:
    """Shares of symbols, capitals and digits; bars, stops and bytes per word; how varied, repeated and many its words and lines are."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    share = lambda kind: (size - len(text.translate(None, kind))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    stops = sum(text.count(x) for x in (b".", b"!", b"?"))
    return [share(SYMBOLS), share(UPPER), share(DIGITS), text.count(b"|") / n, np.log1p(len(set(words))) / np.log1p(n), sum(map(operator.eq, words, words[1:])) / n, size / n / 10,
            stops / n, 1 - len(set(lines)) / len(lines), np.log1p(n) / 10]


def featured(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, row_col: str | None = None) -> DataFrame:
    """``row, doc_id, host, path, blank, x`` per input row."""
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                       F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                x = [features(t) for t in as_bytes(part.column("text"))]
                blank = [not any(r) for r in x]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "host", "path")), pa.array(blank, pa.bool_()), pa.array(x, pa.list_(pa.float64()))],
                                                 ["row", "doc_id", "host", "path", "blank", "x"])

    return rows.mapInArrow(run, "row long, doc_id long, host string, path string, blank boolean, x array<double>")


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x**2], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression on the features and their squares by Newton steps; weights apply to the unscaled features."""
    z = _expanded(x)
    mean, scale = z.mean(axis=0), z.std(axis=0)
    mean[0], scale[0] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z = (z - mean) / scale
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty * len(y))
    ridge[0] = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = w / scale
    out[0] -= (out * mean)[1:].sum()
    return out


def train(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and the share of good documents in the training sample, of at most ``sample`` labelled rows chosen by a hash of the id (about 95 % of it, where there are more).

    Labels that repeat an id count by their majority; ties and null labels are left out. Without both classes the weights are 0.
    """
    voted = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    voted = voted.groupBy("doc_id").agg(F.avg("y").alias("y")).filter("y <> 0.5").withColumn("y", F.round("y"))
    share = min(1.0, 0.95 * sample / max(1, voted.count()))  # by hash, so only about the sample itself comes to the driver
    picked = voted.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000_007)) < share * 1_000_000_007)
    got = rows.filter(~F.col("blank")).join(picked, "doc_id").select("doc_id", "x", "y").toPandas()
    got = got.assign(x=got["x"].map(tuple)).sort_values(["doc_id", "y", "x"]).head(sample)
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        return np.zeros(1 + 2 * len(FEATURES)), 0.5
    return fit_logistic(np.array(got["x"].to_list(), float), y), float(y.mean())


def _logit(p: Column) -> Column:
    return F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.log(p / (1 - p))))


def _strength(groups: DataFrame, n: str, s: str, centre: Column) -> float:
    """How many documents the prior of a group is worth: method of moments over all groups, from sums alone."""
    rate = F.col(s) / F.col(n)
    noise = centre * (1 - centre) / F.col(n)
    between, mid, count = groups.agg(F.avg((rate - centre) * (rate - centre) - noise), F.avg(centre * (1 - centre)), F.count("*")).first()
    if not count or not mid:
        return 1e6
    return float(min(1e6, max(1.0, mid / max(between, mid * 1e-6) - 1)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
                  label_col: str = "quality", threshold: float = 0.5, sample: int = 20_000, seed: int = 3, row_col: str | None = None) -> DataFrame:
    """``row, doc_id, evidence, host_prior, path_prior, quality, kept`` per input row.

    ``evidence`` is the log-likelihood ratio of a logistic classifier trained on at most ``sample`` labelled documents. Its
    probabilities are summed over all documents by host and by path; a host's rate is shrunk to the global rate, a path's to
    its host's, by strengths estimated from the spread of the groups, so a sparse site counts little. A document's own
    evidence is taken out of its site's sums, then added to the path's log-odds: ``quality`` is the posterior, ``kept`` says
    that it reaches ``threshold``.

    Null or blank texts have quality 0 and are not kept. Null hosts and paths are groups of their own. Null or repeated ids are
    separate rows. Without labels of both classes every text is kept. ``row`` numbers the input rows; with ``row_col`` it is
    that column. Other columns play no part.
    """
    rows = staged(featured(docs, id_col, text_col, host_col, path_col, row_col), "features")
    w, share = train(rows, labels, id_col, label_col, sample, seed)
    k = len(FEATURES)
    terms = [F.lit(float(w[0]))] + [F.col("x")[i] * float(w[1 + i]) + F.col("x")[i] * F.col("x")[i] * float(w[1 + k + i]) for i in range(k)]
    logit = F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), sum(terms[1:], terms[0])))
    rows = rows.withColumn("logit", logit).withColumn("evidence", F.col("logit") - float(np.log(share / (1 - share)))).withColumn("p", F.when(F.col("blank"), 0.0).otherwise(1 / (1 + F.exp(-F.col("logit")))))
    paths = staged(rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n_path"), F.sum("p").alias("s_path")), "paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host")), "hosts")
    n, s = hosts.agg(F.sum("n_host"), F.sum("s_host")).first()
    centre = min(1 - 1e-6, max(1e-6, s / n)) if n else 0.5
    k_host = _strength(hosts, "n_host", "s_host", F.lit(centre))
    of_host = (F.col("s_host") + k_host * centre) / (F.col("n_host") + k_host)
    k_path = _strength(join_lookup(paths, hosts, ["host"]), "n_path", "s_path", of_host)
    out = join_lookup(join_lookup(rows, paths, ["host", "path"]), hosts, ["host"])
    host = (F.col("s_host") - F.col("p") + k_host * centre) / (F.col("n_host") - 1 + k_host)
    out = out.withColumn("host_prior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), host)))
    path = (F.col("s_path") - F.col("p") + k_path * F.col("host_prior")) / (F.col("n_path") - 1 + k_path)
    out = out.withColumn("path_prior", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), path)))
    quality = F.when(F.col("blank"), 0.0).when(F.lit(not w.any()), 1.0).otherwise(1 / (1 + F.exp(-F.col("evidence") - _logit(F.col("path_prior")))))
    return out.withColumn("quality", quality).select("row", "doc_id", "evidence", "host_prior", "path_prior", "quality", (F.col("quality") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps, unchanged. Rows keep their numbers on every read (see ``numbered``).

    Null, empty and blank texts go; an empty table gives an empty one.
    """
    held = numbered(docs, "quality")
    narrow = held.select("_row", *[F.col("_d").getField(c).alias(n) for n, c in ((id_col, id_col), ("_text", text_col), ("_host", host_col), ("_path", path_col))])
    kept = score_quality(narrow, labels, id_col, "_text", "_host", "_path", row_col="_row", **options).filter("kept").select(F.col("row").alias("_row"))
    return unboxed(held.join(kept, "_row", "left_semi"))


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return score_quality(table(spark, d, "documents"), table(spark, d, "labels")).drop("row")
