import pytest

from packetloom.llm import common, minhash_dedup, mixing, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
WORDS = "the quick brown fox jumps over a lazy dog and runs far away from here".split()


def text(i):
    body = " ".join(WORDS[(i * 7 + k * (i % 5 + 1)) % len(WORDS)] + str(i) for k in range(30))
    return "" if i % 50 == 0 else "token = secretvalue" + str(i % 10) + " " + body if i % 11 == 0 else "!!! ### $$$ %%%" if i % 13 == 0 else text(i - 1) if i % 17 == 0 else body


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("identity") / "d")
    rows = [(i, text(i), "en", f"s{i % 3}", len(text(i))) for i in range(600)] + [(None, None, None, None, None), (3, text(3), "en", "s1", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.option("parquet.block.size", 2048).parquet(path)
    return path


STAGES = {
    "quality": lambda docs, labels: quality.keep_good(docs, labels),
    "near-duplicates": lambda docs, labels: minhash_dedup.drop_near_duplicates(docs),
    "secrets": lambda docs, labels: secrets.redact_secrets(docs, length_col="n_chars"),
    "mixing": lambda docs, labels: mixing.mixed_documents(docs),
}


@pytest.mark.parametrize("name", STAGES)
def test_other_splits_on_later_reads_change_no_row(spark, folder, monkeypatch, name):
    """Every table that a stage writes lets the next read split the input otherwise, as executors that come or go do."""
    labels = spark.createDataFrame([(i, int(not text(i).startswith("!"))) for i in range(300)], "doc_id long, quality int")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    widths = iter([2, 8, 3, 12, 5] * 40)

    def run():
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        return sorted((tuple(r) for r in STAGES[name](spark.read.parquet(folder), labels).collect()), key=str)

    steady = run()

    def restless(write):
        def wrapped(*args, **kwargs):
            out = write(*args, **kwargs)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(next(widths)))
            return out
        return wrapped

    for module in (quality, minhash_dedup, secrets, mixing):
        for write in ("staged", "numbered"):
            monkeypatch.setattr(module, write, restless(getattr(common, write)))
    moved = run()
    [spark.conf.unset(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism")]
    assert moved == steady and len(steady) > 300


@pytest.mark.parametrize("name", STAGES)
def test_an_empty_table_gives_an_empty_one(spark, folder, name):
    docs = spark.read.parquet(folder)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    made = STAGES[name](docs.filter("false"), labels)
    assert made.dtypes == docs.dtypes and made.count() == 0


def test_numbers_are_unique_with_and_without_a_copy(spark, folder):
    docs = spark.read.parquet(folder)
    doubled = docs.crossJoin(spark.range(2).withColumnRenamed("id", "extra"))
    for df, n in ((docs, 602), (docs.filter("doc_id < 100").select("doc_id", "text"), 101), (doubled, 1204), (docs.unionByName(docs), 1204), (spark.createDataFrame([(1, "a")], "doc_id long, text string"), 1)):
        held = common.numbered(df, "test")
        assert held.count() == n == held.select("_row").distinct().count()
        assert common.unboxed(held).dtypes == df.dtypes
