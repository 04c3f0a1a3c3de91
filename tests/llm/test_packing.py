import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packetloom.llm.bpe import Bpe
from packetloom.llm.packing import END_ID, pack, tokenizer_path

PARTS = ["'s", "'t", "'re", "'ll", " ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "ß", "1", "23", "½", "!", "?", "'", '"', "$", "<|endoftext|>", " ", "中文", "😀", "​",
         "\x00", "\x1c", "͸", "it's", " 's", "_", "　", "x'"]


@pytest.fixture(scope="module")
def bpe():
    return Bpe(tokenizer_path(), END_ID)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=8))
def test_ids_equal_those_of_the_library(bpe, texts):
    ids, counts = bpe.encode(texts)
    want = [bpe.library.encode(t, add_special_tokens=False).ids + [END_ID] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, source string, extra string")


DATA = [(i, ("word%d " % i) * (i * 37 % 900), "a" if i % 3 else "b", "x") for i in range(60)] + [
    (60, None, "a", None), (61, "", None, "y"), (None, "no id", "b", "z"), (5, "again", "a", "x"), (5, "again", "a", "x"), (62, "long " * 30000, "c", None)]


def test_pieces_hold_each_id_once_without_gaps(spark, bpe):
    got = pack(rows(spark, DATA), window=256, chunk=64).toPandas()
    by_seq = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    ends = []
    for seq, g in by_seq:
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all()
        ends.append(g["length"].sum())
    assert sorted(got["sequence_id"].unique()) == list(range(len(ends)))
    assert all(n == 256 for n in ends[:-1]) and 0 < ends[-1] <= 256
    want = {}
    for i, text, source, _ in DATA:
        want.setdefault((i if i is not None else -1, source or "-"), []).append(tuple(bpe.library.encode(text or "", add_special_tokens=False).ids) + (END_ID,))
    total = sum(len(x) for v in want.values() for x in v)
    assert got["length"].sum() == total
    got["key"] = list(zip(got["doc_id"].fillna(-1).astype(int), got["source"].fillna("-")))
    for key, g in got.groupby("key"):
        if len(want[key]) == 1:
            ids = b"".join(g.sort_values("start")["ids"])
            assert tuple(np.frombuffer(ids, "<u4")) == want[key][0]
            assert set(g["doc_tokens"]) == {len(want[key][0])}


def test_windows_follow_the_target_shares(spark):
    data = [(i, "one two three four five " * 40, "abc"[i % 3], "x") for i in range(300)]
    targets = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0)], "source string, weight double")
    got = pack(rows(spark, data), window=1024, chunk=64, weights=targets).toPandas()
    share = got.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0)
    total = {s: got.loc[got["source"] == s, "length"].sum() for s in "abc"}
    backlogged = int(total["a"] / 512)  # source a sends half of each window until it is drained
    run = share.cumsum().head(backlogged - 1)
    for s, p in (("a", 0.5), ("b", 0.25), ("c", 0.25)):  # deficits stay below one chunk of each source
        assert (abs(run[s] - p * 1024 * np.arange(1, len(run) + 1)) <= 3 * 64 + 64).all()


def test_query_digests(spark):
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.001"
    q = e.queries()["op6_mixture_packing"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"]
    lib = Bpe(tokenizer_path(), END_ID).library
    for i, g in q.groupby("doc_id"):
        ids = np.array(lib.encode(docs[i], add_special_tokens=False).ids + [END_ID], "<u4")
        assert g["length"].sum() == len(ids)
        for r in g.itertuples():
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32


def test_empty_table(spark):
    assert pack(rows(spark, DATA).filter(F.lit(False))).count() == 0
