import re
import time

import numpy as np

from packetloom.llm import pii

SCHEMA = "doc_id long, text string, row long, base string, spans string, kind int"
PLAIN = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def passes(kind, part):
    digits = [int(c) for c in part if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in part.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    out = [(m.start(), pii.KINDS.index(k), m.end()) for k, p in PLAIN.items() for m in p.finditer(text) if passes(k, m[0])]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def texts(seed, n=700):
    rng = np.random.default_rng(seed)
    parts = ["a", "b.c", "@", "@x", "x.yz", "_", "%", "+", "é😀", " ", "  ", "-", ".", "1", "12", "255", "256", "0300", "0007", "+1", "+49 (30) 1234", "555-0199", "4111 1111 1111 1111", "4111-1111-1111-1112", "192.168.0.1", "1.2.3",
             "(", ")", "\n", "mail me@ex.org", "378282246310005", "६", "x@y.z_d@e.f"]
    return ["".join(rng.choice(parts, int(rng.integers(0, 12)))) for _ in range(n)]


def test_base_spans_equal_plain_patterns(spark):
    rows = [*enumerate(texts(1)), (None, "a@b.cd"), (7, None), (7, ""), (7, "a@b.cd"), (7, "a@b.cd"), (9001, "é" * 70_000 + " +1 (555) 123-4567")]
    df = spark.createDataFrame([(i, t, 1, "b", "s", 0) for i, t in rows], SCHEMA).repartition(5)
    got = sorted((str(r.doc_id), r.b) for r in pii.find_personal(df).select("doc_id", pii.listed("base").alias("b")).collect())
    assert got == sorted((str(i), base_spans(t or "")) for i, t in rows)
    assert pii.find_personal(df.filter("false")).count() == 0
    assert {r.b.split(":")[0] for r in pii.find_personal(df).select(pii.listed("base").alias("b")).collect()} >= {"email", "ip", "card", "phone"}


def test_long_runs_take_no_square_of_their_length(spark):
    shapes = ["a" * 1_000_000, "1" * 1_000_000, "1 " * 500_000, "+1" + "." * 1_000_000, "a." * 500_000, "x@y" + ".z" * 400_000, "Ab " * 300_000, "10.0.0.1 " * 60_000]
    df = spark.createDataFrame([(i, t, 1, "b", "s", 0) for i, t in enumerate(shapes)], SCHEMA).repartition(8)
    began = time.time()
    got = {r.doc_id: r.n for r in pii.find_personal(df).selectExpr("doc_id", "size(base) as n").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 60_000}
    assert time.time() - began < 120


def test_positions_are_in_code_points(spark):
    text = "😀é me@ex.org, 10.0.0.1 and\n+49 30 123 4567 89"
    df = spark.createDataFrame([(1, text, 1, "b", "s", 0)], SCHEMA)
    base = pii.find_personal(df).first().base
    assert [text[s.start:s.end] for s in base] == ["me@ex.org", "10.0.0.1", "+49 30 123 4567 89"]


def votes_of(rng, truth, hit, fault, speak):
    said = rng.random((len(truth), len(hit))) < np.where(truth[:, None], hit, fault)
    return np.where(rng.random(said.shape) < speak, said.astype(int), -1)


def test_expectation_maximisation_recovers_reliabilities():
    rng = np.random.default_rng(4)
    hit, fault, speak = np.array([0.9, 0.85, 0.7, 0.95, 0.8]), np.array([0.05, 0.1, 0.3, 0.02, 0.15]), np.array([0.9, 0.6, 0.8, 0.5, 0.9])
    kind = rng.choice([4, 5], 60_000)
    truth = rng.random(len(kind)) < np.where(kind == 4, 0.2, 0.05)
    prior, got_hit, got_fault, q = pii.reliabilities(kind, votes_of(rng, truth, hit, fault, speak), np.full(len(kind), -1), np.ones(len(kind)))
    assert np.allclose(got_hit, hit, atol=0.03) and np.allclose(got_fault, fault, atol=0.02)
    assert abs(prior[4] - 0.2) < 0.02 and abs(prior[5] - 0.05) < 0.02
    assert ((q > 0.5) == truth).mean() > 0.97


def test_one_round_of_expectation_equals_plain_python():
    kind, ballots, count = np.array([4, 4, 5]), np.array([[1, -1, 0, -1, 1], [-1, -1, -1, -1, -1], [0, 1, 1, -1, -1]]), np.array([3.0, 10.0, 2.0])
    *_, q = pii.reliabilities(kind, ballots, np.array([-1, -1, 1]), count, rounds=1)
    odds = 0.1 / 0.9 * (0.8 / 0.2) * (0.2 / 0.8) * (0.8 / 0.2)
    assert np.allclose(q, [odds / (1 + odds), 0.1, 1.0])


def test_classifier_weights_are_the_optimum():
    rng = np.random.default_rng(6)
    x = np.column_stack([np.ones(50), rng.random((50, 4)) > 0.5]).astype(float)
    target, count = rng.random(50), rng.integers(1, 40, 50).astype(float)
    w = pii.weights(x, target, count, 0.7)
    p = 1 / (1 + np.exp(-x @ w))
    gradient = x.T @ (count * (target - p)) - np.r_[1e-6, np.full(4, 0.7)] * w
    assert np.abs(gradient).max() < 1e-6


def personal(rng):
    given, family = rng.choice(pii.GIVEN), rng.choice(["Kowalski", "Brandt", "Okafor", "Lindqvist", "Moreau", "Tanaka"])
    d = lambda n: "".join(rng.choice(list("123456789"), n))
    iban = lambda: (lambda body: f"DE{98 - int(body + '131400') % 97:02d}{body}")(d(18))
    return [("name", f"{given} {family}", "Dear {} , thank you"), ("name", f"{given} {family}", "the patient {} said no"), ("number", f"{d(3)}-{d(2)}-{d(4)}", "her SSN: {} was"), ("number", f"({d(3)}) {d(3)}-{d(4)}", "phone {} today"),
            ("address", f"{d(2)} {family} Street", "who lives at {} since"), ("iban", iban(), "to my account IBAN {} please")][rng.integers(6)]


def plain(rng):
    d = lambda n: "".join(rng.choice(list("123456789"), n))
    return [("", f"20{d(2)}-0{d(1)}-1{d(1)}", "version of {} shipped"), ("", f"{d(3)}.{d(2)}.{d(3)}", "see section {} below"), ("", "The United Kingdom", "in {} there"), ("", f"{d(4)} {d(4)}", "invoice {} pages"), ("", "New South Wales", "from {} north"),
            ("", f"19{d(2)} - 20{d(2)}", "the years {} were"), ("", "Oure Oure", "an {} of")][rng.integers(7)]


def test_added_spans_on_held_out_sentences(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for i in range(1500):
        kind, part, frame = personal(rng) if rng.random() < 0.3 else plain(rng)
        text = f"some words é {frame} and more".replace("{}", part)
        at = text.index(part)
        want[i] = (kind, at, at + len(part))
        rows.append((i, text, 1, "b", "s", 0))
    got = {r.doc_id: [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] for r in pii.find_personal(spark.createDataFrame(rows, SCHEMA)).collect()}
    hits = [i for i, w in want.items() if w[0] and w in got[i]]
    false = [i for i, w in want.items() if not w[0] and got[i]]
    assert len(hits) >= 0.9 * sum(1 for w in want.values() if w[0]), len(hits)
    assert len(false) <= 0.01 * sum(1 for w in want.values() if not w[0])
