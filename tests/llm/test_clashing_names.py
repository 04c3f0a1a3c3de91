"""Columns that bear the operators' own names, in every operator that gives back its input's rows."""

from packetloom.llm import minhash_dedup, mixing, quality, secrets

NAMES = ["_d", "_row", "_kept", "_text", "_nth", "_copies", "_spans", "_old", "_new", "row", "doc_id_a", "key", "component", "kept", "spans", "a.b"]


def test_rows_come_back_with_their_columns(spark, tmp_path):
    kinds = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(i, f"plain text number {i} with token = abcdef{i}", "s", "en", 40, *[f"{n}{i}" for n in NAMES]) for i in range(12)]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    want = {r[0]: r for r in rows}
    for made in (quality.keep_good(df, labels), minhash_dedup.drop_near_duplicates(df), secrets.redact_secrets(df, length_col="n_chars"), mixing.mixed_documents(df)):
        assert made.dtypes == df.dtypes
        got = made.collect()
        assert got and all(tuple(r)[5:] == want[r.doc_id][5:] for r in got)
