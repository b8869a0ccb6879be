"""Line deduplication: arrays against plain loops, extension of matches, hot passages, clashing columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from spindrift.llm import line_dedup as L
from test_operators import WORD, brute_lines


def texts(rng, n, kinds, longest=12):
    pool = [" ".join(f"w{k}" for k in rng.integers(0, 9, rng.integers(1, 30))) for _ in range(kinds)] + ["", " \t"]
    return ["\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, longest))) for _ in range(n)] + [None, "", "\n", "x", "a\n\nb\n"]


def test_lines_of_many_texts():
    given = texts(np.random.default_rng(1), 40, 8)
    x = L.read_lines(pa.array(given))
    seen = {}
    for i, t in enumerate(given):
        want = [(k, len(w), tuple(w)) for k, line in enumerate((t or "").split("\n")) if (w := WORD.findall(line))]
        a, b = x.first[i], x.first[i + 1]
        assert list(zip(x.at[a:b].tolist(), x.count[a:b].tolist())) == [r[:2] for r in want]
        for m, (_, _, w) in zip(x.marks[a:b].tolist(), want):
            assert seen.setdefault(w, m) == m
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("least", [1, 7, 20, 50])
def test_windows_and_their_selection(least):
    x = L.read_lines(pa.array(texts(np.random.default_rng(2), 60, 5)))
    start, end = L.windows(x.count, x.first, least)
    want = set()
    for a, b in zip(x.first, x.first[1:]):
        for s in range(a, b):
            for e in range(s, b):
                n = x.count[s : e + 1].sum()
                if n >= least and (n - x.count[e] < least or n - x.count[s] < least):
                    want.add((s, e))
    assert set(zip(start.tolist(), end.tolist())) == want
    got = L.winnow(x.marks, start, end)
    assert got.tolist() == [min(range(s, e + 1), key=lambda k: (x.marks[k], k)) for s, e in zip(start, end)]
    if len(start):
        win = L._runs_of(x.marks, start, end + 1)
        bodies = {}
        for s, e, w in zip(start, end, win.tolist()):
            assert bodies.setdefault(tuple(x.marks[s : e + 1].tolist()), w) == w
        assert len(set(bodies.values())) == len(bodies)


def test_extension_finds_what_the_seed_alone_does_not():
    """One seed of a run of forty lines: all of them go only because the match is extended to both sides."""
    lines = [f"line {k} has exactly six words" for k in range(40)]
    one, two = (L.read_lines(pa.array(["\n".join([head, *lines, tail])])) for head, tail in (("one head", "one tail"), ("two heads", "two tails")))
    assert L.extend(two.marks, one.marks, 20, 20) == (1, 40)
    assert L.merged(L.repeated(two, one.marks, [(20, 20)], False, 50)) == [(1, 40)]
    assert L.repeated(two, one.marks, [(0, 0)], False, 50) == []


def test_a_run_has_one_seed(spark, monkeypatch):
    """Of many shared windows one seed a run is left, so without extension most repeated lines would stay."""
    lines = [f"line {k} has exactly six words" for k in range(60)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["other", *lines[:30], "something else", *lines[30:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    extended = L._extended
    monkeypatch.setattr(L, "_extended", lambda pairs, *a: seen.extend(pairs.collect()) or extended(pairs, *a))
    got = {r["row"]["doc_id"]: r["text"] for r in L.repeats_deleted(df).collect()}
    assert [len(r["seeds"]) for r in seen] == [2] and got == {1: rows[0][1], 2: "other\nsomething else"}
    monkeypatch.setattr(L, "_extended", extended)
    monkeypatch.setattr(L, "extend", None)
    with pytest.raises(TypeError):  # nothing is deleted without it
        L.repeated(L.read_lines(pa.array([rows[1][1]])), L.read_lines(pa.array([rows[0][1]])).marks, [(1, 0)], False, 50)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    """Few kinds of lines: texts that repeat themselves, overlap their own first occurrence and share much."""
    rng = np.random.default_rng(seed)
    rows = list(enumerate(texts(rng, 120, 3 + 2 * seed, 25)))
    got = L.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["text"], r["__deleted"]) for r in got} == brute_lines(rows)


def test_a_passage_that_many_share_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(L, "PART", 4096)
    body = "\n".join(f"shared line {k} of seven words here" for k in range(9))
    rows = [(i, f"own {i}\n{body}\nlast {i}") for i in range(600)]
    got = L.repeats_deleted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["row"]["doc_id"]: r["text"] for r in got} == {0: rows[0][1]} | {i: f"own {i}\nlast {i}" for i in range(1, 600)}


NAMES = ["row", "key", "rk", "runs", "every", "kept", "n_lines", "n_deleted", "__lines", "__deleted", "__key", "__rk", "__runs", "id", "fp", "k", "win", "start", "end", "marks", "count", "at", "a.b"]


def test_the_stage_carries_columns_of_any_name(spark):
    body = "\n".join(f"shared line {k} of seven words here" for k in range(9))
    rows = [(1, body, 5), (2, f"mine\n{body}", None), (None, body, 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumns({c: F.lit(f"own {c}") for c in NAMES if "." not in c}).withColumn("a.b", F.lit("own a.b"))
    out = L.delete_repeated_lines(spark, df, "")
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = out.collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in got) == [("1", "", 0), ("2", "mine", 4), ("None", "None", 1), ("None", body, 1)]
    assert all(r[c] == f"own {c}" for r in got for c in NAMES)
