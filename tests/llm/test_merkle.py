"""Merkle manifests against a tree that is built in one piece."""

import hashlib
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F
from spindrift.llm import merkle, queries

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    for nodes in levels[:-1]:
        j = i ^ 1
        yield (nodes[j] if j < i else "", nodes[j] if i < j < len(nodes) else "")
        i //= 2


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for mine in by.values():
        mine.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {x: tree([leaf(r) for r in by[x]]) for x in langs}
    over = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            proof = [*path(trees[x], i), *path(over, k)]
            folded = leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)
            for a, b in proof:
                folded = digest(a + folded + b)
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], over[-1][0], digest("".join(a + b for a, b in proof)), folded, folded == over[-1][0]))
    return out


def told(rows):
    return sorted(map(repr, map(tuple, rows)))


def query(spark, rows, tmp_path):
    spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit("clash") for c in ("g", "k", "leaf", "rank", "part", "sub", "salt", "root", "proof", "n", "level")}).write.parquet(f"{tmp_path}/documents.parquet")
    return merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()


def test_given_table(spark):
    got = queries.queries()["op12_merkle_manifest"](spark, SF).collect()
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert told(got) == told(brute(rows))
    assert {r["verified"] for r in got} == {True, False}


ODD = [
    (1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (2, None, None, None, None), (None, "s", "en", 1, "x"), (None, "s", "en", 1, "x"), (None, None, None, None, None),
    (3, "s", "", 0, ""), (4, "s", "dé", 2, "é\n"), (5, "s", "en", None, "x " * 30_000), (18, "s", "fr", None, "n_chars stays null"), (18, "t", "fr", 7, "same id"), (-7, "s", "en", 1, "below zero"),
]


def test_odd_rows(spark, tmp_path):
    rows = [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in ODD]
    assert told(query(spark, ODD, tmp_path)) == told(brute(rows))


def test_empty_and_single(spark, tmp_path):
    assert query(spark, [], tmp_path / "a") == []
    (r,) = query(spark, [(9, "s", "en", 1, "x")], tmp_path / "b")
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == digest("")


@pytest.mark.parametrize("unit,step,rows_a_partition", [(3, 2, 40), (1, 1, 1000), (4, 12, 7)])
def test_every_boundary(spark, tmp_path, monkeypatch, unit, step, rows_a_partition):
    """Small units: trees that many partitions and units share, a group that fills nearly all, groups of one."""
    monkeypatch.setattr(merkle, "UNIT", unit)
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "ROWS_A_PARTITION", rows_a_partition)
    rows = [(i * 3 % 1009, "s", "hot" if i % 9 else f"l{i % 63}", i, f"text {i}") for i in range(600)] + [(None, "s", "hot", 0, "copy")] * 100
    want = brute([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows])
    assert told(query(spark, rows, tmp_path)) == told(want)


def test_nodes_are_built_where_they_are_complete():
    leaves = [digest(str(i)) for i in range(21)]
    levels = tree(leaves)
    assert [(lv, i) for lv, i, _ in merkle.frontier(8, leaves[8:16])] == [(3, 1)]
    for a in range(21):
        for b in range(a, 21):
            found = list(merkle.frontier(a, leaves[a:b]))
            assert sorted(x for lv, i, _ in found for x in range(i << lv, (i + 1) << lv)) == list(range(a, b))
            assert all(levels[lv][i] == d for lv, i, d in found) and len(found) <= 10
    assert merkle.grow({(0, i): d for i, d in enumerate(leaves)}, 21, 5, 0)[5, 0] == levels[-1][0]


def test_a_proof_holds_for_its_leaf_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    rows = merkle.merkle_manifest(docs).withColumn("good", merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).withColumn("bad", merkle.fold(F.sha2(F.col("leaf").cast("binary"), 256), F.col("proof")) == F.col("root"))
    assert {(r["good"], r["bad"]) for r in rows.collect()} == {(True, False)}
