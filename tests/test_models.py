"""Gradients against finite differences, vocabularies and padded ids against a plain count."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from spindrift.functions.ordering import global_rank
from spindrift.operators import gradients as N
from spindrift.operators import vocabulary as V


def networks(rng):
    w = lambda *s: rng.normal(size=s)
    yield N.Network([N.Embedding(w(20, 6)), N.Dense(w(6, 5), w(5), True), N.MeanPool(), N.Dense(w(5, 3), w(3))], 7)
    yield N.Network([N.Embedding(w(20, 6)), N.MeanPool(), N.Dense(w(6, 5), w(5), True), N.Dense(w(5, 4), w(4), True), N.Dense(w(4, 3), w(3))], 7)
    yield N.Network([N.Dense(w(7, 5), w(5), True), N.Dense(w(5, 4), w(4), True), N.Dense(w(4, 3), w(3))], 7, 2.0)


@pytest.mark.parametrize("which", range(3))
def test_finite_differences(which):
    rng = np.random.default_rng(which)
    net = list(networks(rng))[which]
    mask = np.array([[1] * 7, [1] * 3 + [0] * 4, [0] * 7], float)
    x = rng.integers(0, 20, (3, 7)).astype(float) if net.tokens else rng.normal(size=(3, 7))
    scores, target, step = net.scores(x, mask), np.array([0, 2, 1]), 1e-6
    got, most = net.gradient(target), net.importance(target)
    inputs = net.layers[0].forward(x, mask) if net.tokens else x
    rest = net.layers[1:] if net.tokens else net.layers
    for at in np.ndindex(*inputs.shape):
        values = []
        for sign in (1, -1):
            y = inputs.copy()
            y[at] += sign * step
            for layer in rest:
                y = layer.forward(y, mask)
            values.append(y[at[0], target[at[0]]])
        assert got[at] == pytest.approx((values[0] - values[1]) / (2 * step), abs=1e-6)
    want = np.sqrt((got**2).sum(-1)) if net.tokens else 2 * np.abs(got)
    assert np.allclose(most, want) and scores.shape == (3, 3)
    if net.tokens:
        assert not most[1, 3:].any() and not most[2].any()  # what the mask leaves out changes nothing


def test_rows_of_any_length(spark):
    net = list(networks(np.random.default_rng(5)))[2]
    rows = [(1, [0.5] * 7, 2), (2, [0.5] * 9, 2), (3, [0.5] * 3, None), (4, [], 0), (5, None, 99), (6, [None, float("nan"), 1.0], -1)]
    df = spark.createDataFrame(rows, "id long, x array<double>, gold long").withColumn("saliency", F.lit("clash")).withColumn("pred", F.lit("clash"))
    got = {r["id"]: r for r in N.gradient_saliency(df, net, "x", "id", "gold").collect()}
    assert [len(got[i]["saliency"]) for i in range(1, 7)] == [7, 7, 3, 0, 0, 3] and got[1]["saliency"] == pytest.approx(got[2]["saliency"])
    full = N.gradient_saliency(df, net, "x", "id").collect()
    assert {r["id"]: r["pred"] for r in full} == {i: r["pred"] for i, r in got.items()}
    for r in full:
        if r["id"] in (3, 5, 6):  # no class: the predicted one
            assert r["saliency"] == pytest.approx(got[r["id"]]["saliency"])
    assert N.gradient_saliency(df.limit(0), net, "x", "id").count() == 0


def test_vocabulary(spark):
    rnd = random.Random(3)
    words = [rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(500)] + ["[CLS]", "é", "é", None, None, ""]
    df = spark.createDataFrame([(w,) for w in words], "token string").repartition(5)
    n = Counter(w for w in words if w is not None and w != "[CLS]")
    want = [*V.SPECIAL, *sorted((w for w in n if n[w] >= 2), key=lambda w: (-n[w], w.encode()))]
    got = {r["id"]: (r["token"], r["n"]) for r in V.learn_vocabulary(df, least=2).collect()}
    assert [got[i][0] for i in range(len(want))] == want and len(got) == len(want) and all(got[i][1] == n[w] for i, w in enumerate(want) if i > 4)
    ids = {r["token"]: r["id"] for r in V.with_ids(df, V.learn_vocabulary(df, least=2)).collect()}
    assert ids["[CLS]"] == V.CLS and ids[None] == V.UNK and ids.get("") == V.UNK and ids["é"] == want.index("é")
    assert V.learn_vocabulary(df.limit(0)).count() == len(V.SPECIAL)


def test_padded_ids(spark):
    rows = [("a", i, 10 + i) for i in range(9)] + [("b", 0, 7), ("c", None, None)]
    got = {r["k"]: (r["ids"], r["segments"]) for r in V.padded_ids(spark.createDataFrame(rows, "k string, pos int, id long"), "k", 5).collect()}
    assert got == {"a": ([2, 10, 11, 12, 13], [1] * 5), "b": ([2, 7, 0, 0, 0], [1, 1, 0, 0, 0]), "c": ([2, 0, 0, 0, 0], [1, 0, 0, 0, 0])}


def test_global_rank(spark):
    rows = [(i * 7919 % 1000 // 3, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = global_rank(df, ["a", "b"], "place", 5).collect()
    assert sorted((r["a"], r["b"], r["place"]) for r in got) == [(*r, 5 + i) for i, r in enumerate(sorted(rows))]
    assert global_rank(df.limit(0), ["a"], "place").count() == 0
