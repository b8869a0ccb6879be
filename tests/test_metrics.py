import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from spindrift.operators import metrics as M


def frame(spark, real, gen, kind="string"):
    return spark.createDataFrame([("real", v) for v in real] + [("gen", v) for v in gen], f"side string, f {kind}")


@pytest.mark.parametrize(("p", "q", "jsd", "tvd"), [((1, 0), (0, 1), 0.693147, 1.0), ((1, 1), (2, 0), 0.215762, 0.5), ((3, 1), (6, 2), 0.0, 0.0)])
def test_divergence(spark, p, q, jsd, tvd):
    df = spark.createDataFrame([("f", i, a, b) for i, (a, b) in enumerate(zip(p, q, strict=True))], "feature string, bin int, real long, gen long")
    r = M.divergence(df).first()
    assert abs(r["jsd"] - jsd) < 1e-6 and abs(r["tvd"] - tvd) < 1e-9


def test_histogram_edges(spark):
    x = M.long_form(frame(spark, [0.0, 98.5, 99.0, 1.0, 50.0], [0.0, 99.0, 97.999, None, float("nan")], "double"), "side", ["f"], "double")
    bins = {r["bin"]: (r["real"], r["gen"]) for r in M.histogram(x).collect()}
    assert bins == {1: (1, 1), 2: (1, 0), 51: (1, 0), 98: (0, 1), 99: (2, 1)}


def test_histogram_of_a_constant(spark):
    x = M.long_form(frame(spark, [5.0] * 6, [5.0] * 6, "double"), "side", ["f"], "double")
    assert [(r["bin"], r["real"], r["gen"]) for r in M.histogram(x).collect()] == [(1, 6, 6)]


def test_short_features_are_skipped(spark):
    df = frame(spark, ["a"] * 4 + [None], ["a"] * 9)
    assert M.categorical_fidelity(df, "side", ["f"]).count() == 0
    row = M.fidelity_report(df, "side", [], ["f"]).where("feature = 'f'").first()
    assert row["jsd"] is None and row["tvd"] is None


def test_entropy_and_overlap(spark):
    df = frame(spark, ["a", "a", "b", "c"], ["a", "z", "z", "y"])
    e = M.entropy(df, "side", ["f"]).first()
    assert abs(e["entropy_real"] - 1.039721) < 1e-6
    o = M.overlap(df, "side", ["f"]).first()
    assert abs(o["coverage"] - 1 / 3) < 1e-12 and abs(o["novelty"] - 2 / 3) < 1e-12


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=6))
def test_bounds(spark, counts):
    counts = [*counts, (1, 1)]
    df = spark.createDataFrame([("f", i, a, b) for i, (a, b) in enumerate(counts)], "feature string, bin int, real long, gen long")
    r = M.divergence(df).first()
    assert -1e-12 <= r["jsd"] <= math.log(2) + 1e-12 and -1e-12 <= r["tvd"] <= 1 + 1e-12


def test_a_side_without_counts_is_uniform(spark):
    """As if its counts were one in each cell, cells without a row among them."""
    import numpy as np
    from spindrift.operators import metrics as M

    rows = [("a", b, n, 0) for b, n in ((1, 4), (2, 6), (7, 10))] + [("b", 1, 0, 3), ("b", 2, 0, 1), ("c", 1, 5, 1), ("c", 3, 0, 4)]
    df = spark.createDataFrame(rows, "feature string, bin long, real long, gen long")

    def want(p, q):
        m = (p + q) / 2
        kl = lambda x: float(np.sum(np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / m), 0.0)))
        return 0.5 * kl(p) + 0.5 * kl(q), 0.5 * float(np.abs(p - q).sum())

    uniform = np.full(10, 0.1)
    a = np.zeros(10)
    a[[0, 1, 6]] = 0.2, 0.3, 0.5
    b = np.zeros(10)
    b[:2] = 0.75, 0.25
    expected = {"a": want(a, uniform), "b": want(uniform, b), "c": want(np.array([1.0, 0.0]), np.array([0.2, 0.8]))}
    got = {r["feature"]: (r["jsd"], r["tvd"]) for r in M.divergence(df, 10).collect()}
    assert {k: tuple(round(x, 12) for x in v) for k, v in got.items()} == {k: tuple(round(x, 12) for x in v) for k, v in expected.items()}
