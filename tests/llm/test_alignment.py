import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from packetloom.llm import alignment as al
from packetloom.llm.bpe import _byte_names

SCHEMA = "doc_id long, text string, block long, pairs string, a_ids int"


def brute(rows):
    """Tokens by the libraries, groups and links by plain sets and loops."""
    ta = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names, out, pairs = _byte_names(), [], Counter()
    for i, t in rows:
        e = ta.encode(" " + (t or ""), add_special_tokens=False)
        a = [(x, bytes(names[c] for c in w)) for x, w in zip(e.ids, e.tokens, strict=True)]
        b = [(x, bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode()) for x, p in zip(sp.encode(t or ""), sp.encode(t or "", out_type=str), strict=True)]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x[1] for x in a) != whole or b"".join(x[1] for x in b) != whole:
            a = b = []
        ea, eb = np.cumsum([len(x[1]) for x in a]).tolist(), np.cumsum([len(x[1]) for x in b]).tolist()
        groups = []
        low = 0
        for c in sorted(set(ea) & set(eb)):
            groups.append(",".join(str(x[0]) for x, e in zip(a, ea, strict=True) if low < e <= c) + "|" + ",".join(str(x[0]) for x, e in zip(b, eb, strict=True) if low < e <= c))
            low = c
        hits = [(x[0], y[0]) for x, p, q in zip(a, [0, *ea], ea, strict=False) for y, r, s in zip(b, [0, *eb], eb, strict=False) if max(p, r) < min(q, s)]
        pairs.update(hits)
        out.append((i, len(a), len(b), len(groups), hits, ";".join(groups)))
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return [(i, na, nb, ng, len(h), sum(pairs[p] == top[p[1]] for p in h), sum(pairs[p] for p in h), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, na, nb, ng, h, g in out]


def texts(seed, n):
    rng = np.random.default_rng(seed)
    parts = ["the", "ing", " ", "  ", "\n", "tion", "é", "日本語", "😀", "<|endoftext|>", "</s>", "<unk>", "▁", "͸", " ", "1234", "don't", "Zx", "\t", "ﬁ", "qwrtz", "\x00"]
    return ["".join(rng.choice(parts, int(rng.integers(0, 25)))) for _ in range(n)]


def test_counts_equal_brute_force(spark, monkeypatch):
    rows = [*enumerate(texts(1, 150)), (None, "no id"), (7, None), (7, ""), (7, "twice the same"), (7, "twice the same"), (9001, "the " * 300 + "日本" * 150), (9002, "▁ is rewritten")]
    df = spark.createDataFrame([(i, t, 0, "p", 1) for i, t in rows], SCHEMA).repartition(6)
    got = [tuple(r) for r in al.alignment_counts(df).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert al.alignment_counts(df.filter("false")).count() == 0
    assert any(r[1] == 0 for r in got) and max(r[1] for r in got) > 300


def test_cuts_equal_the_intersection_of_ends():
    rng = np.random.default_rng(5)
    for trial in range(200):
        a_all, b_all, a_n, b_n, want_a, want_b, base = [], [], [], [], [], [], 0
        for _ in range(int(rng.integers(1, 6))):
            size = int(rng.integers(0, 60)) * (trial % 7 + 1)
            if not size:
                a_n.append(0), b_n.append(0)
                continue
            share = rng.random(2) * rng.choice([0.05, 0.3, 1])
            a, b = (sorted({size, *np.flatnonzero(rng.random(size) < s).tolist()} - {0}) for s in share)
            for i, e in enumerate(a):
                if e in set(b):
                    want_a.append(len(a_all) + i + 1), want_b.append(len(b_all) + b.index(e) + 1)
            a_all += [base + e for e in a]
            b_all += [base + e for e in b]
            a_n.append(len(a)), b_n.append(len(b))
            base += size
        got = al.shared_cuts(np.array(a_all, np.int64), np.array(b_all, np.int64), np.array(a_n), np.array(b_n))
        assert got[0].tolist() == want_a and got[1].tolist() == want_b


def test_long_cutless_interval_is_one_group():
    a, b = np.arange(2, 2_000_001, 2), np.append(np.arange(1, 1_999_999, 2), 2_000_000)
    got = al.shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))
    assert [g.tolist() for g in got] == [[len(a)], [len(b)]]


def test_arrays_of_the_alignment(spark):
    rows = [(i, t, 0, "p", 1) for i, t in enumerate([*texts(2, 40), None, ""])]
    got = {r.doc_id: r for r in al.align(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, *want in brute([(i, t) for i, t, *_ in rows]):
        r = got[i]
        parts = zip([0, *r.a_ends[:-1]], r.a_ends, [0, *r.b_ends[:-1]], r.b_ends, strict=True) if r.a_ends else []
        shown = ";".join(",".join(map(str, r.a_ids[p:q])) + "|" + ",".join(map(str, r.b_ids[s:t])) for p, q, s, t in parts)
        assert (len(r.a_ids), len(r.b_ids), len(r.a_ends)) == tuple(want[:3])
        assert (hashlib.sha256(shown.encode()).hexdigest() if shown else "") == want[-1]
