import random

from pyspark.sql import functions as F

from packetloom.operators import knowledge as kg, patterns as pt

FP = "incident string, actor_count long, target_count long, protocols string, failure_ratio double, attack_state string, dominant_category string, first_window long, last_window long"


def fingerprint(i, targets=1, protocols="TCP"):
    return (i, 1, targets, protocols, 0.9, "RECONNAISSANCE", "NETWORK_RECONNAISSANCE", 0, 1)


def test_links_and_pairs_have_the_same_clusters(spark):
    rng = random.Random(3)
    names = [f"i{k:03d}" for k in range(80)]
    rows = sorted({(n, rng.choice(["ACTOR", "TARGET"]), f"x{rng.randrange(70)}") for n in names for _ in range(rng.randrange(0, 3))} | {(n, "PORT", str(rng.randrange(4))) for n in names})
    members = spark.createDataFrame(rows, "incident string, kind string, item string")
    fp = spark.createDataFrame([fingerprint(n, rng.randrange(1, 5), rng.choice(["TCP", "UDP", "TCP,UDP"])) for n in names], FP)
    pairs, links = pt.incident_correlate(fp, members, "incident"), pt.incident_links(fp, members, "incident")
    cluster = lambda x: sorted(tuple(r) for r in pt.campaign_clusters(x, fp, "incident").collect())
    assert cluster(pairs) == cluster(links) and len(cluster(links)) > 1
    every = {(r.incident_a, r.incident_b): r for r in pairs.collect()}
    star = {(r.incident_a, r.incident_b): r for r in links.collect()}
    assert set(star) <= set(every) and len(star) <= len([r for r in rows if r[1] != "PORT"])
    named = spark.createDataFrame([("i003",), ("i010",)], "incident string")
    got = {(r.incident_a, r.incident_b): tuple(r) for r in pt.incident_correlate(fp, members, "incident", named).collect()}
    assert got == {k: tuple(v) for k, v in every.items() if {"i003", "i010"} & set(k)}


def test_a_gateway_of_many_incidents_is_a_star(spark):
    n = 30_000
    ids = spark.range(n).select(F.format_string("i%06d", "id").alias("incident"))
    members = ids.select("incident", F.lit("ACTOR").alias("kind"), F.lit("10.0.0.1").alias("item"))
    fp = ids.select("incident", *[F.lit(v).alias(f.split()[0]) for f, v in zip(FP.split(", ")[1:], fingerprint("x")[1:], strict=True)])
    links = pt.incident_links(fp, members, "incident")
    assert links.count() == n - 1
    assert links.select("incident_a").distinct().collect()[0][0] == "i000000"
    assert [r.members for r in pt.campaign_clusters(links, fp, "incident").collect()] == [n]


def test_traces_end_at_roots_and_know_cycles(spark):
    chain = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(700)]
    cycle = [("c3", "c1"), ("c1", "c2"), ("c2", "c3"), ("t1", "t2"), ("t2", "c2"), ("s", "s")]
    parents = spark.createDataFrame(chain + cycle, "id string, parent string")
    starts = spark.createDataFrame([("n0000",), ("n0000",), ("n0699",), ("n0700",), ("c2",), ("t1",), ("s",), ("alone",)], "id string")
    got = {r.start: (r.root, r.depth, r.cyclic) for r in kg.trace_roots(parents, starts).collect()}
    assert got == {"n0000": ("n0700", 700, False), "n0699": ("n0700", 1, False), "n0700": ("n0700", 0, False), "c2": ("c1", None, True), "t1": ("c1", None, True), "s": ("s", None, True), "alone": ("alone", 0, False)}
    path = kg.trace_path(parents, starts.filter("id <> 'n0000'")).collect()
    of = lambda s: [r.id for r in sorted(path, key=lambda r: r.depth) if r.start == s]
    assert of("t1") == ["t1", "t2", "c2", "c3", "c1"] and of("c2") == ["c2", "c3", "c1"] and of("s") == ["s"] and of("n0699") == ["n0699", "n0700"] and of("alone") == ["alone"]
    long = kg.trace_path(parents, spark.createDataFrame([("n0000",)], "id string")).orderBy("depth").collect()
    assert [r.id for r in long] == [f"n{k:04d}" for k in range(701)] and [r.depth for r in long] == list(range(701))


def test_own_edge_goes_before_an_indicating_one(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("a", "aa", "X"), ("z", "b", "INDICATES"), ("y", "b", "INDICATES"), ("q", "k", "X")], "source_id string, target_id string, edge_type string")
    assert {(r.id, r.parent) for r in kg.parent_pointers(edges).collect()} == {("a", "aa"), ("b", "y"), ("z", "b"), ("y", "b"), ("q", "k")}


def test_sessions_of_colliding_addresses_stay_apart(spark):
    s = spark.createDataFrame([("::1:2", "3::", 80), ("::1", "2:3::", 80), ("::1", None, 80), ("::1", "\\N", 80)], "src_ip string, dst_ip string, dst_port int")
    ids = [r[0] for r in s.select(kg._id("TCP_SESSION", (F.col("src_ip"), F.col("dst_ip"), F.col("dst_port")))).collect()]
    assert len(set(ids)) == 4
