import numpy as np
import pytest

from packetloom.llm import minhash_dedup as md
from packetloom.llm.components import components

SCHEMA = "doc_id long, text string, key long, component long, items string"


def brute(rows, n, percent):
    """Components by full comparison; rows of one id are one node."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, copies):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = list(rng.choice(words, int(rng.integers(1, 150))))
        for _ in range(int(rng.integers(1, 6))):
            t = list(base)
            for _ in range(int(rng.integers(0, 5))):
                t[int(rng.integers(0, len(t)))] = str(rng.choice(words))
            texts.append(" ".join(t))
    base = list(rng.choice(words, 120))  # a large group around the threshold
    for _ in range(copies):
        t = list(base)
        for _ in range(int(rng.integers(0, 7))):
            t[int(rng.integers(0, len(t)))] = str(rng.choice(words))
        texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "cell"), [(1, 1024), (2, 32)])
def test_equals_brute_force(spark, monkeypatch, seed, cell):
    monkeypatch.setattr(md, "CELL", cell)
    rows = list(enumerate(corpus(seed, 150)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "Two Words"), (904, "two words"), (905, "two"), (906, rows[3][1].upper()), (3, rows[5][1]), (907, "É a b"), (908, "é a b"),
             (909, "long text " * 50_000), (910, "long text " * 50_001)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(6)
    got = md.minhash_components(df, words=3, similarity=0.85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 3, 85)


def test_dropping_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (9, "other words in here now"), (7, None), (8, "")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    out = md.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in out.collect() if r.text) == [(-1, rows[3][1]), (2, rows[0][1]), (9, rows[4][1])]
    assert {r.doc_id for r in out.collect() if not r.text} == {7, 8}
    assert md.minhash_components(df.filter("false")).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(70)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3), (2000, 1999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(71)}, **{1000 + i: 1000 for i in range(300)}, 1999: 1999, 2000: 1999}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_unrelated_rows_of_one_id_stay(spark, tmp_path):
    texts = ["a b c d e f g", "quite other words stand in here now", "a b c d e f g", "x y z u v w q", "x y z u v w q", "rows of text that nobody repeats at all"]
    rows = [(i, t, 1, 2, "x") for i, t in zip([3, 3, 3, 3, 1, 1], texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    out = md.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, texts[5]), (1, texts[3]), (3, texts[0]), (3, texts[1])]
