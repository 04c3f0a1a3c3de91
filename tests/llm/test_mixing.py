import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from packetloom.llm.mixing import fit_budget, mix_sources, mixed_documents

SCHEMA = "doc_id long, text string, source string, size long, row long"


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 80))
def test_small_budgets_fit_as_well_as_brute_force(shape, budget):
    lengths, counts = np.array(list(shape)), np.array(list(shape.values()))
    taken = fit_budget(lengths, counts, budget, 3)
    assert (taken >= 0).all() and (taken <= counts).all()
    got = int((taken * lengths).sum())
    base = np.array([int(c) * min(budget, int((lengths * counts).sum())) // int((lengths * counts).sum()) for c in counts])
    free = [range(int(b), int(c) + 1) for b, c in zip(base, counts)]
    best = max(s for s in (sum(k * n for k, n in zip(pick, lengths)) for pick in itertools.product(*free)) if s <= budget)
    assert got == min(best, budget)


def brute_targets(size, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted([s for s in size if s is not None]) + [None] * (None in size)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {}, {s for s in names if size[s] == 0}
    while True:
        left = share * sum(size.values()) - sum(most * size[s] for s in full)
        over = {s for s in names if s not in full and left * w[s] / sum(w[x] for x in names if x not in full) > most * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        target[s] = most * size[s] if s in full else left * w[s] / sum(w[x] for x in names if x not in full)
    return target


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 400)), [None, "a", "é", "b", "Z"][min(4, int(rng.exponential(1)))], 1, 2) for i in range(1500)]
    rows += [(7, "same words", "a", 1, 2)] * 3 + [(None, None, "b", 1, 2), (1501, "w " * 90000, "Z", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = mix_sources(df).toPandas()
    assert len(got) == len(rows)
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    size = {}
    for _, text, source, *_ in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    want = brute_targets(size)
    for source, t in want.items():
        own = got[got["source"].isna()] if source is None else got[got["source"] == source]
        assert set(own["source_size"]) == {size[source]}
        assert own["target"].to_numpy() == pytest.approx(t)
        assert abs(own["taken"].sum() - t) <= 1, (source, own["taken"].sum(), t)
    assert (got["taken"] <= 2 * got["size"]).all()
    assert sum(want.values()) == pytest.approx(1.5 * sum(size.values()))


def test_reruns_agree_and_decisions_take_effect(spark, tmp_path):
    rows = [(i, "w " * (i % 50), "ab"[i % 2], 1, 2) for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    one, two = (sorted((r.doc_id, r.taken) for r in mix_sources(x).collect()) for x in (df, df.repartition(3)))
    assert one == two
    out = mixed_documents(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: t for i, t in one if t} | {i: 0 for i in words if not words[i]}


def test_empty_and_wordless_tables(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mix_sources(spark.createDataFrame([(1, None, None, 0, 0), (2, " ", "a", 0, 0)], SCHEMA)).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
