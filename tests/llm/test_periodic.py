"""Periodic runs against a plain search."""

import hashlib
import random
import re
import zlib

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from spindrift.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(w):
    """(start, length, period) of every run, by start, then period."""
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            e = i + p
            if i > s and e - s >= max(6, 4 * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, digest("".join(f"{s},{k},{p}\n" for s, k, p in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_random_words():
    rnd = random.Random(7)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(0, 6)):
            k, w = rnd.choice([1, 2, 2, 3, 5]), []
            while len(w) < rnd.randint(0, 80):
                u = [rnd.randrange(k) for _ in range(rnd.randint(1, 7))]
                w += u * rnd.randint(1, 7) + u[: rnd.randint(0, len(u))]
            texts.append(w)
        h = np.array([x for w in texts for x in w], np.uint64)
        got = periodic.find_runs(h, np.array([len(w) for w in texts], np.int64))
        assert got == [(k, *r) for k, w in enumerate(texts) for r in brute(w)]


def test_long_runs_and_chunks(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", (2, 4))
    w = [5, 6, *([1, 2, 3] * 40), 1, 9, *([4] * 50), *([4, 7] * 30)]
    assert periodic.find_runs(np.array(w, np.uint64), np.array([len(w)])) == [(0, *r) for r in brute(w)]


def test_a_text_of_one_word_is_one_run():
    assert periodic.find_runs(np.zeros(200_000, np.uint64), np.array([200_000])) == [(0, 0, 200_000, 1)]


def odd_rows():
    planted = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    one = next(i for i in range(planted + 1, 200) if zlib.crc32(str(i).encode()) % 10 == 0)
    some = " ".join(f"w{i}" for i in range(120))
    return [
        (planted, some), (planted, some), (one, "single"), (one, ""), (one, None), (None, "a b " * 5), (None, None), (1, " \n\t"), (2, "x " * 5), (3, "x\n" * 6), (4, "é x \x0b é x\r\n" * 4),
        (5, "tick " * 30_000), (6, "a b a b a b a b a b c " * 5), (7, ("p q r " * 4) + ("q r p " * 4)),
    ]


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    clash = {c: F.lit("clash") for c in ("w", "h", "a", "p", "runs", "best", "n_words", "collapsed", "start", "length", "period")}
    spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    quick = {(5, "tick " * 30_000): (5, 1, 0, 30_000, 1, 30_000_000, digest("0,30000,1\n"), digest("tick"))}
    got = [tuple(r)[:8] for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(quick.get(r) or row(*r)) for r in rows)


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_given_table(spark):
    got = {r["doc_id"]: tuple(r)[:8] for r in periodic.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 20000").collect()
    for r in docs:
        assert got[r["doc_id"]] == row(r["doc_id"], r["text"])
    assert sum(v[1] for v in got.values()) > 20


def test_the_operator_returns_runs_and_texts(spark):
    (r,) = periodic.periodic_runs(spark.createDataFrame([(1, "so  one two\none two one two one two end")], "doc_id long, text string")).collect()
    assert r["n_words"] == 10 and r["collapsed"] == "so one two end" and [tuple(x) for x in r["runs"]] == [(1, 8, 2)]
