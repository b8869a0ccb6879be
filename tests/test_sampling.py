import pytest
from pyspark.sql import functions as F
from spindrift.functions.ordering import hash_order
from spindrift.operators import sampling as S


def flows(spark, sizes):
    rows = [(i, c, s, 5000, 10) for i, (c, s) in enumerate((c, s) for (c, s), n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "flow_id long, class string, source_tag string, bytes long, pkts long")


def counts(df, *by):
    return {tuple(r[c] for c in by) if len(by) > 1 else r[by[0]]: r["count"] for r in df.groupBy(*by).count().collect()}


@pytest.mark.parametrize(("n", "sizes"), [(10, (8, 1, 1)), (15, (12, 2, 1)), (25, (20, 2, 3)), (35, (28, 4, 3)), (45, (36, 4, 5)), (500, (400, 50, 50))])
def test_split_sizes_round_half_to_even(spark, n, sizes):
    got = counts(S.stratified_split(flows(spark, {("a", "s"): n})), "split")
    assert tuple(got.get(k, 0) for k in ("train", "valid", "test")) == sizes


def test_fair_sample_fills_small_sources_first(spark):
    x = flows(spark, {("c", "A"): 5, ("c", "B"): 2, ("c", "C"): 1})
    assert counts(S.fair_sample(x, 6), "source_tag") == {"A": 3, "B": 2, "C": 1}
    assert S.fair_sample(x, 100).count() == 8


def test_overflow_and_expansion(spark):
    x = flows(spark, {("a", "s"): 30, ("a", "t"): 5, ("b", "s"): 25, ("c", "s"): 4})
    kept, rest = S.capped_sample(x, 10, 20)
    assert counts(kept, "class") == {"a": 20, "b": 20} and counts(rest, "class") == {"a": 15, "b": 5}
    split = S.stratified_split(kept).select("flow_id", "class", "split")
    grown = S.expand_test(split, rest.select("flow_id", "class"), 20)
    assert counts(grown, "class", "split")["a", "test"] == counts(split, "class", "split")["a", "test"] + 5
    assert S.expand_test(split, rest.select("flow_id", "class"), 21).count() == 40
    assert S.expand_test(split, rest.select("flow_id", "class"), 19, exact=True).count() == 40


@pytest.mark.parametrize(("p", "target"), [((800, 100, 90), 900), ((80, 9, 11), 0), ((8000, 1000, 1000), 5000), ((5, 0, 5), 0)])
def test_packet_target(spark, p, target):
    df = spark.createDataFrame([("a", *p)], "class string, train long, valid long, test long")
    assert S.packet_target(df).first()["target"] == target


def test_short_class_is_dropped_whole(spark):
    rows = [("a", s, f"a{s}{i}") for s, n in (("train", 90), ("valid", 12), ("test", 12)) for i in range(n)] + [("b", "train", f"b{i}") for i in range(200)]
    p = spark.createDataFrame(rows, "class string, split string, packet_id string")
    t = spark.createDataFrame([("a", 100), ("b", 100)], "class string, target long")
    assert counts(S.sample_to_target(p, t), "class", "split") == {("a", "train"): 80, ("a", "valid"): 10, ("a", "test"): 10}


@pytest.mark.parametrize(("n", "pct", "want"), [(3, 1, 1), (30, 5, 2), (50, 5, 2), (70, 5, 4), (10, 75, 8)])
def test_subset_sizes(spark, n, pct, want):
    assert S.low_label_subsets(flows(spark, {("a", "s"): n}), (pct,)).count() == want


@pytest.mark.parametrize(("n", "total", "want"), [({"a": 50, "b": 30, "c": 20}, 7, {"a": 4, "b": 2, "c": 1}), ({"a": 1000, "b": 1}, 5, {"a": 4, "b": 1}), ({"a": 5, "b": 0}, 3, {"a": 3, "b": 0})])
def test_quotas(spark, n, total, want):
    df = spark.createDataFrame(list(n.items()), "class string, n long")
    assert {r["class"]: r["quota"] for r in S.quotas(df, total).collect()} == want


def test_take_until_covers_the_target(spark):
    x = flows(spark, {("a", "s"): 30}).withColumn("pkts", F.col("flow_id") % 4)
    got = S.take_until(x, spark.createDataFrame([("a", 17)], "class string, target long")).orderBy("rank").collect()
    assert all(r["pkts"] > 0 and r["before"] < 17 for r in got) and got[-1]["before"] + got[-1]["pkts"] >= 17
    assert sum(r["written"] for r in S.merge_to_quota(x, 17).collect()) == 17


def test_hash_order_is_one_ranking_per_class(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None, i) for i in range(500)], "k long, c string, v long")
    rows = hash_order(df, ["c"], 7, ["k"], "v").collect()
    for c in ("a", None):
        mine = sorted((r for r in rows if r["c"] == c), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and {r["n"] for r in mine} == {len(mine)}
        total = 0
        for r in mine:
            assert r["before"] == total
            total += r["v"]


def test_safe_names_and_cycles(spark):
    df = spark.createDataFrame([("c", "x.pcap", "p1"), ("c", "x.pcap", "p2"), ("d", "x.pcap", "p3"), ("c", "noext", "p4"), ("c", "noext", "p5")], "class string, name string, path string")
    names = {r["path"]: r["out_name"] for r in S.safe_names(df).collect()}
    assert names["p1"] == names["p3"] == "x.pcap" and names["p2"].startswith("x_h") and names["p2"].endswith(".pcap") and names["p5"].startswith("noext_h")
    assert S.exact_k(spark.range(3), 7, "id").count() == 7 and S.exact_k(spark.range(0), 7, "id").count() == 0
