"""Swaps by blocks against swaps one after the other."""

import random
import time

import pytest
from pyspark.sql import functions as F
from spindrift.functions.ordering import uniform
from spindrift.operators import perturb as P


@pytest.mark.parametrize("size", [3, 7, 50])
def test_blocks_compose_to_all_swaps(size):
    rnd = random.Random(size)
    for _ in range(200):
        n, ahead = rnd.randint(1, 60), rnd.randint(1, 3)
        swaps = [(r, min(n - 1, r + 1 + rnd.randrange(ahead))) for r in range(n) if rnd.random() < 0.6]
        want = list(range(n + size + ahead))
        for r, j in swaps:
            want[r], want[j] = want[j], want[r]
        by = {k: [s for s in swaps if s[0] // size == k] for k in range(n // size + 2)}
        left = [(k, P.swapped(s, (k + 1) * size, ahead)[1]) for k, s in by.items()]
        got = list(range(n + size + ahead))
        for k, entry in P.entries(left, size, ahead):
            at, _ = P.swapped(by[k], (k + 1) * size, ahead)
            for t in range(k * size, min((k + 1) * size, len(got))):
                q = at.get(t, t)
                got[t] = entry[q - k * size] if q < k * size + ahead else q
        assert got[:n] == want[:n]


def packets(spark, sizes):
    rows = [(f, i, 1000 * i + f, 100, 1) for f, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "flow long, idx long, ts_us long, len long, tuple long")


@pytest.mark.parametrize(("level", "block"), [(name, b) for name in P.LEVELS for b in (20, 4096)])
def test_reorder_against_plain_swaps(spark, monkeypatch, level, block):
    monkeypatch.setattr(P, "BLOCK", block)
    v = P.LEVELS[level]
    x = packets(spark, [300, 1, 2, 41, 64])
    draws = x.select("flow", F.col("idx").alias("r"), uniform("swap42", "flow", "idx").alias("a"), uniform("far42", "flow", "idx").alias("b")).collect()
    want = {}
    for flow in {d["flow"] for d in draws}:
        mine = sorted((d["r"], d["a"], d["b"]) for d in draws if d["flow"] == flow)
        n, done, at = len(mine), 0, list(range(len(mine)))
        for r, a, b in mine:
            if a < v["p"] and done < int(n * v["ratio"]):
                j = min(n - 1, r + 1 + int(b * (v["window"] - 1)))
                at[r], at[j] = at[j], at[r]
                done += 1
        want |= {(flow, 1000 * source + flow): place for place, source in enumerate(at)}
    got = {(r["flow"], r["ts_us"]): r["idx"] for r in P.reorder(x, v["window"], v["p"], v["ratio"]).collect()}
    assert got == want


def test_null_flows_and_null_times(spark):
    rows = [(None, i, 10 * i, 1, 1) for i in range(60)] + [(1, 0, None, 1, 1), (1, 1, 5, 1, 1)]
    got = P.reorder(spark.createDataFrame(rows, "flow long, idx long, ts_us long, len long, tuple long"), 16, 0.7, 0.4).collect()
    assert sorted(r["idx"] for r in got if r["flow"] is None) == list(range(60)) and any(10 * r["idx"] != r["ts_us"] for r in got if r["flow"] is None)
    assert [(r["idx"], r["ok"], r["error"]) for r in got if r["flow"] == 1] == [(0, False, "null ts_us"), (1, False, "null ts_us")] or len(got) == 62


def test_heavy_takes_about_as_long_as_light(spark):
    x = spark.range(200_000).select(F.lit(1).cast("long").alias("flow"), F.col("id").alias("idx"), F.col("id").alias("ts_us"), F.lit(1).alias("len"), F.lit(1).alias("tuple"))
    took = {}
    for level in ("light", "light", "heavy"):
        v, t = P.LEVELS[level], time.perf_counter()
        assert P.reorder(x, v["window"], v["p"], v["ratio"]).agg(F.sum("idx")).first()[0] == 200_000 * 199_999 // 2
        took[level] = time.perf_counter() - t
    assert took["heavy"] < 4 * took["light"]
