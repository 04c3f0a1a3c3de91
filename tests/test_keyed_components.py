"""Components per key: small keys as one group each, large ones by star rounds; both give the same rows."""

import random

import pytest

from packetloom.operators import graph as gr

SCHEMA = "bucket long, src_ip string, dst_ip string"


def edges(spark):
    rng = random.Random(5)
    rows = [(k, f"s{rng.randrange(40 * k)}", f"n{rng.randrange(9 * k)}") for k in (1, 2, 3) for _ in range(50)]
    rows += [(4, f"c{i}", f"c{i + 1}") for i in range(300)]  # a chain
    rows += [(5, f"z{i:03}", "zz") for i in range(80)] + [(5, "\u00e9", "\U0001F600"), (5, "\uffff", "\U0001F600")]  # a star, code points beyond 16 bits
    rows += [(6, "a", "a"), (6, "b", "c"), (6, "b", "c"), (7, None, "a"), (7, "a", None), (7, "b", "a"), (None, "a", "b")]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(repr, df.select("bucket", "node", "component").collect()))


@pytest.mark.parametrize("limit", [0, 60, 1 << 18])
def test_groups_and_stars_agree(spark, limit):
    e = edges(spark)
    assert rows(gr.connected_components(e, ["bucket"], group_edges=limit)) == rows(gr.star_components(e, ["bucket"]))


def test_small_keys_write_nothing(spark, monkeypatch):
    monkeypatch.setattr(gr, "durable", lambda df: pytest.fail("written"))
    e = edges(spark).filter("bucket IS NOT NULL")
    got = {(r.bucket, r.node): r.component for r in gr.connected_components(e, ["bucket"]).collect()}
    assert got[4, "c299"] == "c0" and got[5, "z079"] == "z000" and got[6, "c"] == "b" and got[6, "a"] == "a"
