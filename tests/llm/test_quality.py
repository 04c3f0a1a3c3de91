import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import quality as ql

SCHEMA = "doc_id long, text string, source string, lang string, row long, p double"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.filter("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("truth"))
    got = ql.score_quality(docs, labels.filter("doc_id % 3 <> 0")).join(held, "doc_id").toPandas()
    right = got["kept"].astype(int) == got["truth"]
    assert len(got) > 80 and right.mean() >= 0.97


def plain(rows, evidence, p, blank, threshold=0.5):
    """The same posteriors, one document at a time."""
    sums = {}
    for (i, t, h, l, *_), q in zip(rows, p):
        for key in ((h,), (h, l)):
            n, s = sums.get(key, (0, 0.0))
            sums[key] = (n + 1, s + q)
    hosts = [k for k in sums if len(k) == 1]
    n, s = sum(sums[k][0] for k in hosts), sum(sums[k][1] for k in hosts)
    c = s / n

    def strength(groups):
        between = np.mean([(sums[k][1] / sums[k][0] - m)**2 - m * (1 - m) / sums[k][0] for k, m in groups])
        mid = np.mean([m * (1 - m) for _, m in groups])
        return min(1e6, max(1.0, mid / max(between, mid * 1e-6) - 1))

    kh = strength([(k, c) for k in hosts])
    kp = strength([(k, (sums[k[:1]][1] + kh * c) / (sums[k[:1]][0] + kh)) for k in sums if len(k) == 2])
    out = []
    for (i, t, h, l, *_), e, q, b in zip(rows, evidence, p, blank):
        host = (sums[(h,)][1] - q + kh * c) / (sums[(h,)][0] - 1 + kh)
        path = (sums[(h, l)][1] - q + kp * host) / (sums[(h, l)][0] - 1 + kp)
        out.append(0.0 if b else 1 / (1 + np.exp(-e - np.log(path / (1 - path)))))
    return out


def test_posteriors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    good = lambda: " ".join("".join(rng.choice(list("etaoin"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(5, 60)))) + "."
    bad = lambda: "### ".join(rng.choice(["buy", "now"], int(rng.integers(5, 60))))
    rows = []
    for i in range(400):
        host = [None, "a", "b", "c", "rare"][min(4, int(rng.exponential(1.3)))]
        rows.append((i, good() if rng.random() < {"b": 0.2}.get(host, 0.8) else bad(), host, ["en", None][int(rng.integers(0, 2))], 1, 2.0))
    rows += [(400, None, "a", "en", 1, 2.0), (401, " \n", "a", "en", 1, 2.0), (None, good(), "solo", "x", 1, 2.0), (5, rows[5][1], rows[5][2], rows[5][3], 1, 2.0), (402, "word " * 100_000, "a", "en", 1, 2.0)]
    labels = [(i, int("#" not in t), None) for i, t, *_ in rows[:400] if i % 2] + [(1, None, 0), (None, 1, 0), (2, 0, 0), (2, 1, 0)]
    df, lb = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, x int")
    got = ql.score_quality(df, lb).collect()
    assert len(got) == len(rows)
    model, share = ql.train(ql.featured(df, "doc_id", "text", "source", "lang"), lb, "doc_id", "quality", 20_000, 3)
    x = np.array([ql.features((t or "").encode()) for _, t, *_ in rows])
    blank = ~x.any(axis=1)
    logit = np.clip(ql._expanded(x) @ model, -ql.EDGE, ql.EDGE)
    want = plain(rows, logit - np.log(share / (1 - share)), np.where(blank, 0, 1 / (1 + np.exp(-logit))), blank)
    assert sorted(r.quality for r in got) == pytest.approx(sorted(want), abs=1e-9)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[400] and not kept[401]
    assert np.mean([kept[i] == ("#" not in t) for i, t, *_ in rows[:400]]) > 0.97


def test_without_labels_and_empty(spark, tmp_path):
    spark.createDataFrame([(1, "some text", "a", "en", 0, 0.0), (2, "", None, None, 0, 0.0)], SCHEMA).write.parquet(str(tmp_path / "d"))
    df, none = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([], "doc_id long, quality int")
    assert [r.doc_id for r in ql.keep_good(df, none).collect()] == [1]
    assert ql.keep_good(df, none).columns == df.columns
    assert ql.score_quality(df.filter(F.lit(False)), none).count() == 0
