"""Scorers, accuracy and timing."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BenchConfig:
    """How a scorer is timed. ``warmup_passes`` are whole passes over the rows."""

    warmup_passes: int = 2
    repeat: int = 1
    runs: int = 3
    seed: int = 42
    target_samples: int | None = None

    def merged(self, *later: dict) -> BenchConfig:
        """Later dicts win; only None means that a value isn't given, so 0 and False count."""
        names = {f.name for f in fields(self)}
        out = self
        for d in later:
            out = replace(out, **{k: v for k, v in d.items() if k in names and v is not None})
        return out


@dataclass(frozen=True)
class LinearScorer:
    """A linear classifier over fixed-length feature arrays; its saliency is exact: |weight| of the target class.

    Any object with ``scores(x)`` and ``saliency(x, target)`` over numpy arrays can stand in for it.
    """

    weights: np.ndarray  # features x classes
    bias: np.ndarray

    @property
    def width(self) -> int:
        return len(self.weights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def saliency(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        return np.abs(self.weights.T[target] * np.ones_like(x))


def matrix_of(rows: list, width: int | None) -> np.ndarray:
    """Feature arrays as a matrix, cut or zero-padded to ``width``; null arrays and null values are zeros."""
    width = max((len(r) for r in rows if r), default=0) if width is None else width
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r:
            values = np.array(r[:width], np.float64)
            out[i, : len(values)] = np.where(np.isnan(values), 0.0, values)
    return out


def apply_scorer(df: DataFrame, scorer, features: str, key: str, target: str = "pred") -> DataFrame:
    """(key, scores, pred, saliency) of every row; ``target`` is 'pred' or a column with the class to explain. Rows are cut
    or zero-padded to the scorer's ``width``, where it has one."""
    out, _ = _scored(df, scorer, features, key, target, False)
    return out


def observed_scores(df: DataFrame, scorer, features: str, key: str, target: str = "pred"):
    """``apply_scorer`` and an Observation of the pass that evaluates it: flows, and read_s and score_s, the seconds that
    tasks waited for their rows and scored them. The times travel with the rows, so tasks that are repeated count once."""
    return _scored(df, scorer, features, key, target, True)


def _scored(df: DataFrame, scorer, features: str, key: str, target: str, timed: bool):
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(scorer)
    kind = df.schema[key].dataType.simpleString()
    names = [key, "scores", "pred", "saliency", *(["read_us", "score_us"] if timed else [])]

    def run(batches):
        width, read, began = getattr(shared.value, "width", None), 0.0, time.perf_counter()
        for b in batches:
            got = time.perf_counter()
            read += got - began
            n = b.num_rows
            if n:
                x = matrix_of(b.column(1).to_pylist(), width)
                s = shared.value.scores(x)
                pred = s.argmax(1)
                goal = pred if target == "pred" else np.asarray(b.column(2), np.int64)
                sal = shared.value.saliency(x, goal)
                arrays = [b.column(0), pa.array(s.tolist(), pa.list_(pa.float64())), pa.array(pred, pa.int64()), pa.array(sal.tolist(), pa.list_(pa.float64()))]
                if timed:  # the batch's first row carries its times
                    arrays += [pa.array([v, *[0.0] * (n - 1)]) for v in (read * 1e6, (time.perf_counter() - got) * 1e6)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                read = 0.0
            began = time.perf_counter()

    cols = [key, features, *([] if target == "pred" else [target])]
    fields = f"`{key}` {kind}, scores array<double>, pred long, saliency array<double>" + (", read_us double, score_us double" if timed else "")
    out = df.select(*cols).mapInArrow(run, fields)
    if not timed:
        return out, None
    seen = Observation()
    seconds = lambda c: F.coalesce(F.sum(c) / 1e6, F.lit(0.0))
    return out.observe(seen, F.count("*").alias("flows"), seconds("read_us").alias("read_s"), seconds("score_us").alias("score_s")).drop("read_us", "score_us"), seen


def observed_benchmark(df: DataFrame, scorer, features: str, key: str, config: BenchConfig) -> DataFrame:
    """One row a run, each of ``repeat`` passes that read and score at once: flows, wall seconds (total_s), and what tasks
    took for their rows (prep_s) and for scoring them (infer_s), after warm-up passes."""
    out = []
    for run in range(-config.warmup_passes, config.runs):
        began, told = time.perf_counter(), []
        for _ in range(config.repeat if run >= 0 else 1):
            scored, seen = observed_scores(df, scorer, features, key)
            scored.write.format("noop").mode("overwrite").save()
            told.append(seen.get)
        if run >= 0:
            out.append((run, sum(t["flows"] for t in told), time.perf_counter() - began, sum(t["read_s"] for t in told), sum(t["score_s"] for t in told)))
    return df.sparkSession.createDataFrame(out, "run int, flows long, total_s double, prep_s double, infer_s double")


def accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: rows, correct, accuracy (0 when empty)."""
    right = F.sum(F.when(F.col(gold) == F.col(pred), 1).otherwise(0))
    x = df.agg(F.count("*").alias("rows"), F.coalesce(right, F.lit(0)).alias("correct"))
    return x.withColumn("accuracy", F.when(F.col("rows") == 0, 0.0).otherwise(F.col("correct") / F.col("rows")))


def timing_summary(runs: DataFrame) -> DataFrame:
    """Means over runs (total_s, prep_s, infer_s, flows), milliseconds a flow and flows a second."""
    x = runs.agg(*[F.avg(c).alias(c) for c in ("total_s", "prep_s", "infer_s")], F.max("flows").alias("flows"))
    return x.withColumn("ms_per_flow", F.col("total_s") / F.col("flows") * 1000).withColumn("flows_per_sec", F.col("flows") / F.col("total_s"))


def benchmark(df: DataFrame, score: Callable[[DataFrame], DataFrame], config: BenchConfig) -> DataFrame:
    """One row per run: seconds to read the input and to score it, after warm-up passes."""
    spark = df.sparkSession
    for _ in range(config.warmup_passes):
        score(df).write.format("noop").mode("overwrite").save()
    n, out = df.count(), []
    for run in range(config.runs):
        a = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        b = time.perf_counter()
        for _ in range(config.repeat):
            score(df).write.format("noop").mode("overwrite").save()
        c = time.perf_counter()
        out.append((run, n * config.repeat, c - a, b - a, c - b))
    return spark.createDataFrame(out, "run int, flows long, total_s double, prep_s double, infer_s double")
