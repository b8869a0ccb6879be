"""Operator 4: near-duplicate embeddings by a random-projection tree forest with spill."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, local_roots, materialize, table

THRESHOLD, TREES, LEAF, SPILL = 0.98, 6, 512, 0.015
#: A leaf's number among all trees' leaves: tree * LEAVES + leaf.
LEAVES = 1 << 20


class Forest:
    """Trees of random splits: a node sends a unit vector left or right of the sample's median along a random
    direction, and to both sides when it lies within SPILL of it."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(sample, depth, rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, depth: int, rng) -> tuple | None:
        if depth <= 0 or len(x) < 32:
            return None
        direction = rng.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        p = x @ direction
        cut = float(np.median(p))
        left, right = x[p <= cut + SPILL], x[p > cut - SPILL]
        if len(left) > 0.9 * len(x) and len(right) > 0.9 * len(x):  # nearly one point: no split parts it
            return None
        return direction, cut, self._grow(left, depth - 1, rng), self._grow(right, depth - 1, rng)

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """The leaves of every row of x, all trees in turn, ascending."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        for t, root in enumerate(self.trees):
            count = 0
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if node is None:
                    for r in rows.tolist():
                        out[r].append(t * LEAVES + count)
                    count += 1
                    continue
                p = x[rows] @ node[0]
                stack += [(node[3], rows[p > node[1] - SPILL]), (node[2], rows[p <= node[1] + SPILL])]
        return out


def _vectors(column, kind) -> np.ndarray:
    return np.stack([np.frombuffer(b, kind) for b in column.to_pylist()]).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_meetings(la: np.ndarray, lb: np.ndarray, leaf: int) -> np.ndarray:
    """Of pairs' padded leaf lists: whether ``leaf`` is the first that both lists hold."""
    same = (la[:, :, None] == lb[:, None, :]) & (la[:, :, None] >= 0)
    low = np.where(same.any(2), la, np.iinfo(np.int64).max).min(1)
    return low == leaf


def _compare(kind, threshold):
    """Within one leaf (or two blocks of it): (rep, links, root) of the vectors that have links here first."""
    import pyarrow as pa

    def run(t):
        rep, weight, block = (np.asarray(t.column(c), np.int64) for c in ("rep", "m", "block"))
        i, j, leaf = (t.column(c)[0].as_py() for c in ("i", "j", "leaf"))
        order = np.argsort(rep, kind="stable")
        rep, weight, block = rep[order], weight[order], block[order]
        x = _unit(_vectors(t.column("vec"), kind))[order]
        lists = [t.column("leaves")[k].as_py() for k in order.tolist()]
        pad = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for k, leaves in enumerate(lists):
            pad[k, : len(leaves)] = leaves
        good = np.triu(x @ x.T >= threshold, 1)
        if i != j:
            good &= block[:, None] != block[None, :]
        a, b = np.nonzero(good)
        step = max(1, 4_000_000 // pad.shape[1] ** 2)
        keep = np.concatenate([first_meetings(pad[a[k : k + step]], pad[b[k : k + step]], leaf) for k in range(0, len(a), step)]) if len(a) else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        links = np.bincount(a, weight[b], len(rep)) + np.bincount(b, weight[a], len(rep))
        root, some = local_roots(len(rep), a, b), np.flatnonzero(links)
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[root[some]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF, max_sample: int = 65_536) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite numbers, have no label or no id, are linked with
    nothing. Vectors of different lengths aren't compared. Exact copies are one class, known by a 64-bit hash of label
    and vector, and are counted, not paired; one id may have several vectors, each row being linked by its own. The
    forest is fitted on about ``max_sample`` vectors at most (a bound on what the driver gathers and broadcasts) and
    indexes every row; its depth follows the number of classes as far as the sample has 32 vectors for a node, beyond
    which leaves grow with the table. In a leaf all vectors of one label are
    compared exactly, larger leaves in blocks of ``leaf`` by ``leaf``, and a pair counts in the first leaf that both
    lie in, so pairs are never shuffled: a leaf returns sums and one link to its component's root per vector.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    wide = "double" if "double" in vectors.schema["embedding"].dataType.simpleString() else "float"
    kind = np.dtype("<f8" if wide == "double" else "<f4")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{wide}>").alias("e"), F.col("label").cast("string").alias("label"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    key = F.when(usable, F.struct(F.xxhash64("label", "e").alias("x")))
    # a class is known by a hash of label and vector, so that one vec_id may have several vectors
    keyed = materialize(rows.select("vec_id", key.alias("k")), "members")
    classes = keyed.where("k IS NOT NULL").groupBy("k").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    classes = materialize(classes.select(F.col("k.x").alias("rep"), "least", "m"), "class_sizes")
    one = rows.where(usable).withColumn("rep", F.xxhash64("label", "e")).join(classes.select(F.col("rep").alias("c_rep"), F.col("least"), "m"), (F.col("rep") == F.col("c_rep")) & (F.col("vec_id") == F.col("least")))
    unique = materialize(one.dropDuplicates(["rep"]).select("rep", "m", "label", F.size("e").alias("dim"), "e"), "classes")

    n = unique.count()
    share = int(1_000_000 * min(1.0, max_sample / max(n, 1)))
    depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    forests = {}
    if n:
        got = unique.where(F.pmod(F.xxhash64(F.lit("forest"), "rep"), F.lit(1_000_000)) < share).select("dim", "e").toArrow()
        sizes = np.asarray(got.column("dim"), np.int64)
        for d in np.unique(sizes).tolist():
            x = np.array(got.filter(pa.array(sizes == d)).column("e").to_pylist(), np.float64)
            forests[d] = Forest(_unit(x), depth)
    shared = spark.sparkContext.broadcast(forests)

    def assign(batches):
        for b in batches:
            dims = np.asarray(b.column(3), np.int64)
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                x = np.asarray(part.column(4).flatten()).astype(kind).reshape(-1, d)
                forest = shared.value.get(d)
                leaves = forest.leaves(_unit(x.astype(np.float64))) if forest else [[0]] * len(x)
                vec = pa.array([v.tobytes() for v in x], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), vec, pa.array(leaves, pa.list_(pa.int64()))], names=["rep", "m", "label", "dim", "vec", "leaves"])

    placed = materialize(unique.select("rep", "m", "label", "dim", "e").mapInArrow(assign, "rep long, m long, label string, dim int, vec binary, leaves array<long>"), "placed")
    at = ["label", "dim", "leaf"]
    large = placed.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy(*at).agg(F.count("*").alias("size")).where(f"size > {leaf}")
    large = materialize(large, "large_leaves")
    if large.count() <= 100_000:
        large = F.broadcast(large)
    spread = placed.withColumn("leaf", F.explode("leaves")).join(large, at, "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / leaf).cast("int"))
    spread = spread.withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select(*at, "i", "j", "block", "rep", "m", "vec", "leaves")
    found = materialize(spread.groupBy(*at, "i", "j").applyInArrow(_compare(kind, threshold), "rep long, links long, root long"), "leaf_links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    # a component is named by its smallest vec_id
    per_class = classes.select("rep", "least", "m").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("rep", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("grp"))
    per_class = materialize(per_class, "class_links")
    names = per_class.groupBy("grp").agg(F.min("least").alias("component"))
    per_class = materialize(per_class.join(names, "grp").select(F.col("rep").alias("r"), "n", "component"), "class_components")
    out = keyed.select("vec_id", F.col("k.x").alias("rep")).join(per_class, F.col("rep") == F.col("r"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
m AS (SELECT a, least(a, min(b)) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.b, v.vec_id) AS component_id, coalesce(m.b, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id
"""
