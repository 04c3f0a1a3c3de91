import numpy as np
import pytest

from packetloom.llm.projection_dedup import embedding_components

SCHEMA = "vec_id long, embedding array<float>, label int, grp string, unit double"


def planted(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        base = rng.standard_normal(32)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.integers(1, 9)) if c else 700):  # one large group
            rows.append((base + rng.standard_normal(32) * rng.uniform(0, 0.022)).astype(np.float32))
    return np.array(rows), rng.integers(0, 3, len(rows))


def brute(x, label):
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = (y @ y.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(hit, comp[None, :], len(x)).min(axis=1))
        new = new[new]
        if (new == comp).all():
            return hit.sum(axis=1), comp
        comp = new


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    x, label = planted(150, seed)
    df = spark.createDataFrame([(i, v.tolist(), int(g), "clash", 1.0) for i, (v, g) in enumerate(zip(x, label))], SCHEMA).repartition(5)
    got = embedding_components(df).toPandas().sort_values("vec_id")
    links, comp = brute(x, label)
    assert links.max() > 100 and (links == 0).any()
    assert (got["n_links"].to_numpy() == links).all()
    assert (got["component_id"].to_numpy() == comp).all()
    assert (got["kept"].to_numpy() == (comp == np.arange(len(x)))).all()


def test_odd_vectors_link_with_nothing(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(1, a, 0), (2, a, 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 3.0], 0), (6, [float("nan"), 1.0, 1.0], 0), (7, [float("inf"), 1.0, 1.0], 0),
            (8, a, None), (9, [], 0), (10, [1.0, 2.0], 0), (11, a, 1), (None, a, 0), (12, [3e38, 6e38, 9e38], 0), (2, a, 0)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "vec_id long, embedding array<double>, label int, grp string, unit double")
    got = sorted(embedding_components(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {
        (1, 2, 1, True), (2, 2, 1, False), (12, 2, 1, False), (None, 0, None, True), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))}
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert embedding_components(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("background", [0.90, 0.95, 0.965])
def test_links_in_a_dense_background(spark, background):
    """Vectors around one centre, mostly not linked, and partners just above the threshold."""
    rng = np.random.default_rng(int(1000 * background))
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)

    def beside(x, cosine):
        other = rng.standard_normal(x.shape)
        other = unit(other - (other * x).sum(axis=1, keepdims=True) * x)
        return cosine * x + np.sqrt(1 - cosine**2) * other

    centre = np.repeat(unit(rng.standard_normal((1, 64))), 4000, axis=0)
    cloud = beside(centre, np.sqrt(background))
    x = np.concatenate([cloud, beside(cloud[:400], 0.982), np.repeat(cloud[1000:1001], 60, axis=0)]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    links, comp = brute(x, np.zeros(len(x), int))
    df = spark.createDataFrame([(i, v.tolist(), 0, "clash", 1.0) for i, v in enumerate(x)], SCHEMA).repartition(5)
    got = embedding_components(df).toPandas().sort_values("vec_id")
    lost, wrong = (links - got["n_links"].to_numpy()), got["component_id"].to_numpy() != comp
    print(f"background {background}: {int(lost.sum()) // 2} of {int(links.sum()) // 2} links lost, {int(wrong.sum())} of {len(x)} components differ")
    assert (lost >= 0).all() and lost.sum() <= 0.002 * links.sum() and wrong.sum() <= 0.002 * len(x)
