"""Mixing: marginals, convergence, many cells, columns of any name."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.llm import mixing

CELLS = "source string, lang string, topic string, tokens double"


def cells(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = {(f"s{rng.integers(40)}", f"g{rng.integers(4)}", f"t{rng.integers(5)}"): float(rng.integers(1, 500)) for _ in range(n)}
    return spark.createDataFrame([(*k, v) for k, v in rows.items()], CELLS)


def brute(rows, targets, sweeps):
    """Plain iterative fitting over dictionaries."""
    total, w = sum(v for *_, v in rows), {r[:3]: r[3] for r in rows}
    for _ in range(sweeps):
        for k, d in enumerate(mixing.DIMS):
            sums = {}
            for key, x in w.items():
                sums[key[k]] = sums.get(key[k], 0) + x
            share = {c: targets[d].get(c, 0.0) for c in sums}
            for key in w:
                w[key] *= total * share[key[k]] / sum(share.values()) / sums[key[k]] if sums[key[k]] else 0
    return w


@pytest.mark.parametrize("one_task", [True, False])
def test_marginals_are_met(spark, one_task, monkeypatch):
    x = cells(spark)
    rows = [tuple(r) for r in x.collect()]
    want = {d: {c: float(1 + i % 3) for i, c in enumerate(sorted({r[k] for r in rows}))} for k, d in enumerate(mixing.DIMS)}
    r = mixing.rake(x, want, one_task=one_task, tolerance=mixing.TOLERANCE)
    assert mixing.marginal_error(r) <= mixing.TOLERANCE
    plain = brute(rows, want, 200)
    assert all(abs(v["w"] - plain[v["source"], v["lang"], v["topic"]]) < 1e-4 * (1 + v["w"]) for v in r.collect())


def test_raking_goes_on_until_it_fits(spark):
    """Cells close to a diagonal converge slowly: five sweeps aren't enough."""
    rows = [("a", "x", "t", 1000.0), ("a", "y", "t", 1.0), ("b", "x", "t", 1.0), ("b", "y", "t", 1000.0)]
    want = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.7, "y": 0.3}, "topic": {"t": 1.0}}
    with pytest.warns(UserWarning, match="marginals are off"):
        few = mixing.rake(spark.createDataFrame(rows, CELLS), want, 5)
    assert mixing.marginal_error(few) > mixing.WARN
    assert mixing.marginal_error(mixing.rake(spark.createDataFrame(rows, CELLS), want, 5, tolerance=1e-4)) <= 1e-4


def test_one_topic_of_many_cells_has_no_window(spark):
    r = mixing.rake(cells(spark), one_task=False, sweeps=2)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and r.count() > 100


NAMES = ["row", "r_source", "r_lang", "r_topic", "topic", "tokens", "weight", "probability", "sampled", "one", "w", "total", "__source", "__lang", "__topic", "__tokens", "__weight", "__probability", "__sampled"]


def test_the_stage_carries_columns_of_any_name(spark, docs001):
    df = docs001.withColumns({c: F.lit(f"own {c}") for c in NAMES})
    out = mixing.sample_to_targets(spark, df, "")
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = out.collect()
    assert all(r[c] == f"own {c}" for r in got for c in NAMES)
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in mixing.mixed(docs001).where("__sampled").collect()} and 0 < len(got) < docs001.count()
    assert mixing.sample_to_targets(spark, df.limit(0), "").count() == 0
