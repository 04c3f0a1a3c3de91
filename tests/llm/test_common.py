import pyarrow as pa
import pytest

from packetloom.llm.common import join_lookup, running_sum, slices


@pytest.mark.parametrize("limit", [0, 100])
def test_lookup_joins_null_keys_and_hot_keys(spark, limit):
    rows = [(i, None if i % 3 == 0 else "a" if i % 3 == 1 else f"k{i}") for i in range(300)]
    lookup = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    got = join_lookup(spark.createDataFrame(rows, "i long, k string"), lookup, ["k"], limit)
    assert got.columns == ["i", "k", "v"]
    assert {r.i: r.v for r in got.collect()} == {i: 1 if k is None else 2 if k == "a" else None for i, k in rows} and got.count() == len(rows)


def test_running_sum_over_a_total_order(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    got = running_sum(spark.createDataFrame(rows, "o long, n long").repartition(9), ["o"], ["n"])[0].collect()
    total, want = 0, {}
    for o, n in sorted(rows):
        want[o], total = total, total + n
    assert {r.o: r.before_n for r in got} == want


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = list(slices(batch, size=11))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist() and len(parts) == 3
    assert list(slices(batch.slice(0, 0))) == []
