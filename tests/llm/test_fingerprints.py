import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from packetloom.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, range int, edge string, fingerprint string"


def plain_entries(sketch, text):
    """The definition, one k-mer at a time."""
    k, n = sketch.k, len(text)
    if not n:
        return [()] * sketch.count
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h, x = sketch.kmers(points)
    grams = [text] if n < k else [text[i:i + k] for i in range(n - k + 1)]
    assert len(grams) == len(h)
    assert len(set(grams)) == len(set(h.tolist()))
    seen, names = {}, []
    for g in grams:
        seen[g] = seen.get(g, -1) + 1
        names.append((g, seen[g]))
    assert len(set(zip(names, x.tolist()))) == len(names)
    by_name = dict(zip(names, x.tolist()))
    out = []
    for a, b in zip(sketch.a[:, 0].tolist(), sketch.b[:, 0].tolist()):
        ranked = sorted(range(len(names)), key=lambda i: ((a * by_name[names[i]] + b) % 2**32, i))[:sketch.least]
        out.append(tuple(grams[i] for i in sorted(ranked)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.text("abé中 ", max_size=60), st.text("abé中 ", max_size=60))
def test_entries_agree_exactly_where_the_definition_does(one, two):
    sketch = fp.OrderMinHash(k=4, least=2, count=8)
    same = sketch.entries(one) == sketch.entries(two)
    assert same.tolist() == [p == q for p, q in zip(plain_entries(sketch, one), plain_entries(sketch, two))]


def test_blocks_do_not_change_the_result(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(5000))
    whole = fp.OrderMinHash().entries(text)
    monkeypatch.setattr(fp, "BLOCK", 100)
    assert (fp.OrderMinHash().entries(text) == whole).all()


def test_order_matters():
    words = [f"word{i}" for i in range(400)]
    sketch = fp.OrderMinHash()
    a, moved = " ".join(words), " ".join(words[200:] + words[:200])
    edited = " ".join(words[:100] + ["x"] + words[101:])
    assert fp.likeness(sketch.entries(a), sketch.entries(edited)) > 0.9 > fp.likeness(sketch.entries(a), sketch.entries(moved))


def test_edits_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(chr(int(c)) for c in rng.choice([97, 98, 0xE9, 0x4E2D, 0x1F600, 32], int(rng.integers(0, 60)))) for _ in range(200)]
    rows = [(int(i) * 3 - 50, t) for i, t in enumerate(texts)] + [(None, "null id text"), (1000, None), (1001, ""), (1002, "x" * 200_000), (4, texts[0]), (4, texts[0]), (4, "b")]
    df = spark.createDataFrame([(*r, 1, "e", "f") for r in rows], SCHEMA).repartition(7)
    got = fp.edited_likeness(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    sketch, want = fp.OrderMinHash(), []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        e = t[:len(t) - cut] + nxt[:cut]
        x, y, z = sketch.entries(t), sketch.entries(e), sketch.entries(nxt)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.hexed(x), fp.hexed(y), float((x == y).mean()), float((x == z).mean())))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_small_tables(spark):
    assert fp.edited_likeness(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fp.edited_likeness(spark.createDataFrame([(1, "abcdefgh", 1, "", "")], SCHEMA)).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(1, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    assert [tuple(r) for r in fp.fingerprints(spark.createDataFrame([(1, None, 1, "", ""), (2, "", 1, "", "")], SCHEMA)).select("fingerprint").distinct().collect()] == [("0" * 256,)]


def test_kmers_that_share_high_bits_are_counted_apart():
    sketch = fp.OrderMinHash()
    points = np.random.default_rng(6).integers(97, 123, 5_000_000).astype(np.uint32)
    h, _ = sketch.kmers(points)
    order = np.argsort(h, kind="stable")
    s = h[order]
    at = np.flatnonzero((s[1:] >> np.uint64(24) == s[:-1] >> np.uint64(24)) & (s[1:] != s[:-1]))
    assert len(at)
    i, j = order[at[0]], order[at[0] + 1]
    h, numbered = sketch.kmers(np.concatenate([points[i:i + 8], points[j:j + 8]]))
    assert numbered[0] == h[0].astype(np.uint32) and numbered[-1] == h[-1].astype(np.uint32)  # the first occurrence of each


def test_one_id_with_all_rows(spark):
    """Rows of one id go in the order of their texts, over several ranges."""
    texts = [None, "", *(("shared beginning " * 5 if i % 2 else "") + f"text {i * 7919 % 400:04d}" for i in range(400))]
    got = fp.edited_likeness(spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string").repartition(6)).collect()
    ring = sorted(t or "" for t in texts)
    want = []
    for one, two in zip(ring, ring[1:] + ring[:1]):
        n, take = len(one), len(one) // 4
        want.append((n, hashlib.sha256((one[:n - take] + two[:take]).encode()).hexdigest()))
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
