import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from spindrift.llm import jaccard
from spindrift.llm.jaccard import bitmaps, boundary, enumerations, may_be_similar, partners, required, similar_documents


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(rows):
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in similar_documents(df, **more).collect())


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = list(rows[rng.integers(len(rows))][1].split(" "))
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(len(w))] = vocab[rng.integers(300)]
            if rng.random() < 0.3:
                w = w[: rng.integers(max(1, len(w) - 4), len(w) + 1)]
        else:
            w = [vocab[k] for k in rng.integers(0, 300, rng.integers(1, 120 if rng.random() < 0.5 else 14))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows, block=3) == brute(rows)


def test_edges(spark):
    rows = [(0, None), (1, ""), (2, " \t"), (3, "a b"), (4, "A  b"), (5, "a b c"), (6, "x " * 300), (7, "x " * 290), (8, None), (3, "a b"), (9, "\xa0q r s t u")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    odd = spark.createDataFrame([(None, "a b c d e f", "z"), (2, "a b c d e f", "z"), (2, None, "z")], "doc_id long, text string, cls string")
    assert sorted(similar_documents(odd).collect(), key=str) == sorted([(None, 2, 2), (2, 2, 2), (2, 0, 2)], key=str)


def test_hot_group_of_near_copies(spark):
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:58], f"t{i}", base[59]])) for i in range(150)] + [(i, " ".join(base[:20] + [f"u{i}_{k}" for k in range(40)])) for i in range(150, 200)]
    assert got(spark, rows, block=16) == brute(rows)


def test_light_rules():
    for n in range(1, 13):
        for m in partners(n):
            o = required(n, m)
            assert 180 * o >= 80 * (n + m) > 180 * (o - 1) and n in partners(m)
        assert enumerations(n) >= 1
    assert boundary({}, 0.0) == jaccard.LARGEST_LIGHT and boundary({10: 5}, 1.0) < 10 <= boundary({10: 5}, 1000.0)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=20))
def test_bitmaps_never_rule_out_similar_sets(a, extra):
    b = a | extra
    s = np.array(sorted(a) + sorted(b), np.uint64)
    of = np.array([0] * len(a) + [1] * len(b))
    n = np.array([len(a), len(b)])
    x, y = bitmaps(s, of, n)
    if 100 * len(a & b) >= 80 * len(a | b):
        assert may_be_similar([x], [y], n[:1], n[1:])[0]


def test_rows_of_one_id_with_different_texts(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(6):
        for part in (0, 1):
            w = [f"d{i}_{part}_{k}" for k in range(60)]
            rows.append((i, " ".join(w)))
            w[int(rng.integers(60))] = "changed"
            rows.append((100 + 10 * i + part, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"], r["component_id"]) for r in similar_documents(df).collect()}
    assert out == {(i, i) for i in range(6)} | {(100 + 10 * i + part, i) for i in range(6) for part in (0, 1)}


def test_null_ids_bridge(spark):
    base = [f"w{k}" for k in range(104)]
    near = lambda at: " ".join(f"x{k}" if k in at else w for k, w in enumerate(base))
    rows = [(5, near({10, 40})), (None, near({})), (6, near({60, 90})), (None, "other words of nobody at all"), (7, "nothing like it in here at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = sets_of([t for _, t in rows])
    assert 100 * len(sets[0] & sets[2]) < 80 * len(sets[0] | sets[2])
    got = sorted(((r["doc_id"], r["component_id"]) for r in similar_documents(df).collect()), key=str)
    assert got == sorted([(5, 5), (None, 5), (6, 5), (None, None), (7, 7)], key=str)


@pytest.mark.parametrize("size", [30, 470])
def test_bitmaps_on_postings_agree_with_brute_force(spark, size):
    rng = np.random.default_rng(size)
    base = [f"v{i}" for i in range(size)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, size, rng.integers(0, 2 + size // 25)):
            w[at] = f"t{i}_{at}"
        rows.append((i, " ".join(w[: size - int(rng.integers(0, size // 8))])))
    assert got(spark, rows, block=7) == brute(rows)
