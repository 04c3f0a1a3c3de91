from packetloom.sources import corpora, logs


def small_splits(spark, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    return old


def test_lines_take_the_latest_header_above_in_any_split(spark, tmp_path):
    many = ["lost\tline"]
    want = [("A", "1"), ("B", "2"), ("C", None), ("one", "7")]
    for i in range(60):
        many += ["#separator \\x09", "#fields\tts\tuid" if i % 2 else "#fields\tuid\tts\textra", *(f"{i}{j}\tu{i}-{j}" if i % 2 else f"u{i}-{j}\t{i}{j}\tx" for j in range(i % 5)), "#close"]
        want += [(f"u{i}-{j}", f"{i}{j}") for j in range(i % 5)]
    (tmp_path / "many.log").write_text("\n".join(many))
    (tmp_path / "two.log").write_text("#fields ts uid\n1\tA\n#fields uid ts\nB\t2\n#fields uid\nC\n")
    (tmp_path / "one.log").write_text("#fields\tuid\tts\none\t7\n")
    for size in (128 << 20, 400, 90):
        old = small_splits(spark, size)
        got = [(r.uid, r.ts) for r in logs.zeek_logs(spark, str(tmp_path), ["uid", "ts"]).collect()]
        [spark.conf.set(k, v) for k, v in old.items()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_count_from_the_top_of_their_own_file(spark, tmp_path):
    want = []
    for f in range(3):
        lines = [" Label, Flow Bytes/s"]
        for i in range(40 * f + 3):
            lines.append("BENIGN" if i % 7 == 3 else f"DoS  x,{f}" if i % 2 else f"benign ,{f}")
            if i % 7 != 3:
                want.append((round(i * 0.1, 3), i % 2, float(f)))
        (tmp_path / f"{f}.csv").write_text("\n".join(lines) + "\n")
    for size in (128 << 20, 150):
        old = small_splits(spark, size)
        got = [(round(r.ts - 1499414400.0, 3), r.label, r.flow_bytes_s) for r in corpora.read_labelled_csv(spark, str(tmp_path)).collect()]
        [spark.conf.set(k, v) for k, v in old.items()]
        assert sorted(got) == sorted(want)
