import hashlib
import re

import numpy as np
import pytest

from packetloom.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, form string, output string, h1 int"


def plain_python(i, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (i, len(units), "plain", None, None, text)
    if h4 % 100 < 80:
        return (i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(seed, n=500):
    rng = np.random.default_rng(seed)
    parts = ["a", "word", " ", "  ", "\n", "\t", "\x0b\x0c\r", "é😀", " ", " ", "<", "P>", "<P", "<S>", "S>", "x" * 300, ".", "\x00", "\x1c"]
    return ["".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(n)]


def test_outputs_equal_plain_python_and_round_trip(spark):
    long = " ".join(f"w{i}" * (1 + i % 7) for i in range(120_000))
    lone = "y" * 400_000 + " end  "
    rows = [(i, t) for i, t in enumerate(texts(1))] + [(None, "null id text here"), (7, None), (7, ""), (7, "same id again"), (7, "same id again"), (9001, long), (9002, lone), (9003, " "), (-3, "a b c d e")]
    df = spark.createDataFrame([(i, t, 1, "f", "o", 2) for i, t in rows], SCHEMA).repartition(5)
    made = fim.fill_in_middle(df)
    got = [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted((plain_python(i, t) for i, t in rows), key=key)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restored().alias("t")).collect()
    assert sorted((str(r.doc_id), r.t) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert fim.fill_in_middle(df.filter("false")).count() == 0


@pytest.mark.parametrize("error", [0, 1, 5, 127, 1000])
def test_index_is_exact_and_error_bounded(error):
    rng = np.random.default_rng(error)
    many = [*texts(2, 60), "", " ", " ".join("z" * int(k) for k in rng.integers(1, 2000, 3000)), ("q " * 40 + "r" * 5000 + " ") * 30]
    offsets, begins = fim.boundaries(many)
    index = fim.RankIndex(offsets, begins, error)
    every = np.arange(len(offsets))
    assert (index.offset(every) == offsets).all()
    assert np.abs(index.predict(every) - offsets).max() <= error
    for t, a, b in zip(many, begins[:-1], begins[1:], strict=True):
        ends = [0, *(m.end() for m in UNIT.finditer(t))]
        assert offsets[a:b].tolist() == ends
    assert set(begins[:-1].tolist()) <= set(index.first.tolist())


def test_even_text_needs_few_lines():
    offsets, begins = fim.boundaries(["abcd " * 100_000, " ".join(["abcde", "xy"] * 50_000)])
    index = fim.RankIndex(offsets, begins, 127)
    assert len(index.first) <= 4 and index.residual.itemsize == 1


def test_index_table_serves_ranks(spark):
    rows = [(i, t, 1, "f", "o", 2) for i, t in enumerate([*texts(3, 40), None, "", "k " * 5000])]
    got = {r.doc_id: r for r in fim.rank_index(spark.createDataFrame(rows, SCHEMA), error=300).collect()}
    for i, t, *_ in rows:
        ends = [0, *(m.end() for m in UNIT.finditer(t or ""))]
        r = got[i]
        left = np.frombuffer(r.residuals, "<i2").astype(int)
        k = np.searchsorted(r.first, np.arange(r.n + 1), "right") - 1
        line = np.array(r.base)[k] + np.array(r.rise)[k] * (np.arange(r.n + 1) - np.array(r.first)[k]) // np.array(r.run)[k]
        assert (line + left).tolist() == ends
