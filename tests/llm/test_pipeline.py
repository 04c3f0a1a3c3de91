import numpy as np
import pytest

import corpus_pipeline as cp
from packetloom.llm.bpe import Bpe
from packetloom.llm.packing import END_ID, tokenizer_path
from tests.llm.test_mixing import brute_targets
from tests.llm.test_secrets import base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.toPandas())
    for k, (_, stage) in enumerate(cp.STAGES):
        made = stage(spark, docs, SF)
        if k < 4:
            assert made.dtypes == out_types(spark)
        made.write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs.toPandas())
    return out


def out_types(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").dtypes


def test_quality_keeps_good_documents(spark, outputs):
    before, after = outputs[0], outputs[1]
    truth = spark.read.parquet(f"{SF}/labels.parquet").toPandas().groupby("doc_id")["quality"].mean()
    kept = set(after["doc_id"])
    assert kept < set(before["doc_id"])
    assert np.mean([(i in kept) == (q > 0.5) for i, q in truth.items()]) > 0.95
    merged = after.merge(before, on="doc_id")
    assert (merged["text_x"] == merged["text_y"]).all()


def test_one_of_each_group_stays(outputs):
    before, after = outputs[1], outputs[2]
    sets = {}
    for i, t in zip(before["doc_id"], before["text"]):
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    assert sorted(after["doc_id"]) == [i for i in ids if find(i) == i]


def test_no_base_secret_is_left(outputs):
    before, after = outputs[2].set_index("doc_id"), outputs[3].set_index("doc_id")
    assert set(before.index) == set(after.index)
    for i in before.index:
        assert not base_spans(after.loc[i, "text"])
        if not base_spans(before.loc[i, "text"]) and "[SECRET]" not in after.loc[i, "text"]:
            assert after.loc[i, "text"] == before.loc[i, "text"]
        assert after.loc[i, "n_chars"] == len(after.loc[i, "text"])


def test_mix_and_packs(outputs):
    before, after, packed = outputs[3], outputs[4], outputs[5]
    count = lambda df: df.assign(w=[len(t.encode().split()) for t in df["text"]]).groupby("source")["w"].sum()
    target = brute_targets(count(before).to_dict())
    got = count(after)
    for source, t in target.items():  # few documents each: the best sum of any subset that the target allows
        sizes = [len(x.encode().split()) for x in before.loc[before["source"] == source, "text"]]
        whole, total = int(t // sum(sizes)), sum(sizes)
        sums = {0}
        for n in sizes:
            sums |= {x + n for x in sums}
        assert got.get(source, 0) == whole * total + max(x for x in sums if x <= round(t - whole * total))
    assert after.groupby("doc_id").size().max() == 2
    lib = Bpe(tokenizer_path(), END_ID).library
    want = sorted(tuple(lib.encode(t, add_special_tokens=False).ids) for t in after["text"])
    assert packed["length"].sum() == sum(len(x) + 1 for x in want)
    sums = packed.groupby("sequence_id")["length"].sum()
    assert (sums.iloc[:-1] == 2048).all()
    single = set(after.groupby("doc_id").size().loc[lambda n: n == 1].index)
    for i, g in packed[packed["doc_id"].isin(single)].groupby("doc_id"):
        ids = np.frombuffer(b"".join(g.sort_values("start")["ids"]), "<u4")[:-1]
        assert tuple(ids) == tuple(lib.encode(after.set_index("doc_id").loc[i, "text"], add_special_tokens=False).ids)
