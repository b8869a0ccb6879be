"""Operator 11: periodic runs of words, found by probing a harmonic grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, small_parts, table, text_bytes, word_spans, words

#: A run has this many words at least, and this many periods.
LEAST_WORDS, PERIODS = 6, 4
#: Words compared at a time when a run is extended; the chunk doubles while words agree, up to the second figure.
CHUNK = (16, 1 << 16)
#: Words joined at a time when a text is put together again.
PIECE = 100_000


def _ahead(h: np.ndarray, at: int, p: int, end: int) -> int:
    """The first i >= at at which h[i] and h[i + p] differ (i + p < end), or end - p."""
    size, stop = CHUNK[0], end - p
    while at < stop:
        n = min(size, stop - at)
        off = np.flatnonzero(h[at : at + n] != h[at + p : at + p + n])
        if len(off):
            return at + int(off[0])
        at += n
        size = min(2 * size, CHUNK[1])
    return stop


def _back(h: np.ndarray, at: int, p: int, begin: int) -> int:
    """The least i such that h[j] and h[j + p] agree for all j from i to at - 1."""
    size = CHUNK[0]
    while at > begin:
        n = min(size, at - begin)
        off = np.flatnonzero(h[at - n : at] != h[at - n + p : at + p])
        if len(off):
            return at - n + int(off[-1]) + 1
        at -= n
        size = min(2 * size, CHUNK[1])
    return begin


def find_runs(h: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of every run of many texts' words; ``h`` are hashes, ``counts`` words a text.

    Longest texts come first, so period p looks at texts of 4p words or more only, which are a prefix. On them lies a
    grid of every p-th word. A run of four periods holds three grid steps in a row over which words agree; where
    they do, the run is extended both ways by comparing chunks p words apart. Grid points within runs of a period that
    divides p are struck out beforehand (there, period p is no smallest one), so a text that repeats one word costs no
    more than others. The grid has n/p points: n log n probes in all, all of one p at once.
    """
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    first = np.concatenate(([0], np.cumsum(counts)))
    total = int(counts.sum())
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    h = h[np.repeat(first[order] - bounds[:-1], sizes) + np.arange(total)]
    out: list[tuple[int, int, int, int]] = []
    ends: set[tuple[int, int]] = set()
    due: dict[int, list[tuple[int, int, int]]] = {}  # by period: runs of which it is the next multiple
    for p in range(1, int(sizes[0]) // PERIODS + 1 if len(sizes) else 0):
        stop = int(bounds[np.searchsorted(-sizes, -max(PERIODS * p, LEAST_WORDS), "right")])
        grid = h[:stop:p]
        same = grid[1:] == grid[:-1]
        hit = same[2:] & same[1:-1] & same[:-2]
        for s, e, d in due.pop(p, ()):
            hit[-(-s // p) : max((e - 3 * p - 1) // p + 1, 0)] = False
            if PERIODS * (p + d) <= e - s:
                due.setdefault(p + d, []).append((s, e, d))
        past = 0
        for j in np.flatnonzero(hit).tolist():
            x = j * p
            if x < past:
                continue
            k = int(np.searchsorted(bounds, x, "right")) - 1
            begin, end = int(bounds[k]), int(bounds[k + 1])
            if x + 3 * p >= end:  # these steps lead into the next text
                continue
            e = _ahead(h, x, p, end) + p
            s = _back(h, x, p, begin)
            past = e - p  # the pair at e - p differs, so no other run with these steps begins before it
            if e - s >= max(LEAST_WORDS, PERIODS * p) and (s, e) not in ends:
                ends.add((s, e))
                out.append((int(order[k]), s - begin, e - s, p))
                if 2 * PERIODS * p <= e - s:
                    due.setdefault(2 * p, []).append((s, e, p))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _joined(text: memoryview, start: np.ndarray, end: np.ndarray) -> str:
    """The words at these bytes, joined by one space."""
    parts = []
    for a in range(0, len(start), PIECE):
        parts.append(b" ".join([text[s:e] for s, e in zip(start[a : a + PIECE].tolist(), end[a : a + PIECE].tolist(), strict=True)]))
    return b" ".join(parts).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0 and told apart by 64-bit hashes. A run is a stretch of words with
    smallest period q, of max(6, 4q) words or more, that can't be extended; runs come by start, then period.
    ``collapsed`` is the text's words, joined by one space, without those that lie in a run after its first q words.
    Null, empty and blank texts have no words, no runs and an empty ``collapsed``; repeated rows and null ids are read
    like others; ties can't occur (runs of one start have different periods); an empty table gives none; other columns are not
    carried, so their names can't clash. Whole texts of any length are read, some megabytes at a time (a text is never cut),
    where they are, without a shuffle.
    """
    import pyarrow as pa

    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in small_parts(batches, "text"):
            data, offsets = text_bytes(b.column(1))
            h, counts, start, end = word_spans(data, offsets, lower=False)
            text = memoryview(data[offsets[0] : offsets[-1]])
            first = np.concatenate(([0], np.cumsum(counts)))
            found: list[list[dict]] = [[] for _ in counts]
            keep = np.ones(len(h), bool)
            for k, s, n, p in find_runs(h, counts):
                found[k].append({"start": s, "length": n, "period": p})
                keep[first[k] + s + p : first[k] + s + n] = False
            collapsed = []
            for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                k = keep[a:z]
                collapsed.append(_joined(text, start[a:z][k], end[a:z][k]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kinds), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def plant_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the contract's documents go over into a period: with h = crc32(decimal doc_id) and
    g = h // 10, where h % 10 = 0 each word from a = g % n on is word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    Others, and rows without an id, stay as they are."""
    w, n = F.col("w"), F.greatest(F.size("w"), F.lit(1)).cast("long")
    g = F.floor(F.col("h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    planted = F.array_join(F.transform(w, lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(w, (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("a", a).withColumn("p", p).select("doc_id", F.when(F.size("w") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(plant_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
