import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from packetloom.llm.bpe import Bpe
from packetloom.llm.ordering import Feistel, read_shards, write_shards
from packetloom.llm.packing import END_ID, tokenizer_path

SCHEMA = "doc_id long, text string, slot int, shard string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**64))
def test_permutation(size, key):
    f = Feistel(size, key)
    slots = f.slot(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))
    assert (f.index(slots) == np.arange(size)).all()


def test_permutation_of_large_domains_and_keys():
    size = 10**12 + 7
    x = np.arange(0, size, size // 1000)
    f, g = Feistel(size, 1), Feistel(size, 2)
    assert (f.index(f.slot(x)) == x).all() and f.slot(x).max() < size
    assert (f.slot(x) != g.slot(x)).mean() > 0.99
    assert abs(np.corrcoef(x.astype(float), f.slot(x).astype(float))[0, 1]) < 0.15


@pytest.mark.parametrize("per_shard", [4, 1000])
def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path, per_shard):
    rows = [(i, f"text {i} " * (i % 40), 1, "x") for i in range(200)] + [(None, None, 1, "x"), (7, "", 1, "x"), (7, "", 1, "x"), (300, "long " * 20000, 1, "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    folder = tmp_path / "shards"
    man = write_shards(docs, str(folder), length=64, per_shard=per_shard, key=5).toPandas()
    n = len(man)
    assert sorted(man["slot"]) == sorted(man["sequence_id"]) == list(range(n))
    assert (Feistel(n, 5).slot(man["sequence_id"].to_numpy()) == man["slot"].to_numpy()).all()
    files = sorted(p for p in Path(folder).iterdir())
    assert [p.name for p in files] == [f"shard-{k:08d}.bin" for k in range(-(-n // per_shard))]
    assert all(p.stat().st_size == per_shard * 128 for p in files[:-1])
    for r in man.itertuples():
        data = files[r.shard].read_bytes()[r.byte_offset:r.byte_offset + r.stride]
        assert r.stride == 128 and zlib.crc32(data) == r.ids_crc32
    # in order of sequence_id, the ids of each partition are those of its documents end to end
    stream = np.frombuffer(b"".join(files[r.shard].read_bytes()[r.byte_offset:r.byte_offset + 128] for r in man.sort_values("sequence_id").itertuples()), "<u2").reshape(n, 64)
    kept = [row[:k].tolist() for row, k in zip(stream, man.sort_values("sequence_id")["n_tokens"])]
    lib = Bpe(tokenizer_path(), END_ID).library
    want = sorted(tuple(lib.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows)
    got, now = [], []
    for x in [i for k in kept for i in k]:
        if x == END_ID:
            got.append(tuple(now))
            now = []
        else:
            now.append(x)
    assert sorted(got) == want and not now
    again = write_shards(docs, str(tmp_path / "again"), length=64, per_shard=per_shard, key=5)
    assert {(r.slot, r.ids_crc32) for r in read_shards(spark, again.cache(), str(tmp_path / "again")).collect()} == set(zip(man["slot"], man["ids_crc32"]))


def test_empty_table(spark, tmp_path):
    assert write_shards(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).count() == 0


def test_more_executors_between_the_passes_move_no_border(spark, tmp_path, monkeypatch):
    from packetloom.llm import ordering
    rows = [(i, f"text {i} " * (i % 40), 1, "x") for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "d"))
    settings_ = {"spark.sql.files.openCostInBytes": "1", "spark.sql.leafNodeDefaultParallelism": "2"}
    [spark.conf.set(k, v) for k, v in settings_.items()]
    whole = write_shards(spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "a"), length=64, key=5).toPandas()
    plain = ordering._ranged

    def grown(*args):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16")
        return plain(*args)

    monkeypatch.setattr(ordering, "_ranged", grown)
    again = write_shards(spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "b"), length=64, key=5).toPandas()
    [spark.conf.unset(k) for k in settings_]
    key = ["slot", "sequence_id", "ids_crc32"]
    assert whole[key].sort_values("slot").to_numpy().tolist() == again[key].sort_values("slot").to_numpy().tolist()
