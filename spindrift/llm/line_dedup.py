"""Operator 8: line deduplication by winnowing over line hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, materialize, mix, modest_batches, small_parts, table, text_bytes, word_spans

MIN_WORDS = 50
#: Bytes of line hashes that one task extends matches in at a time.
PART = 8 << 20
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _runs_of(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end) of a sequence of hashes, by prefix sums."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_STEP, len(h)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(_BACK, len(h) + 1)[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Lines:
    """Lines with words of many texts, one after the other: hash, words, place among the text's lines, and each text's first."""

    marks: np.ndarray
    count: np.ndarray
    at: np.ndarray
    first: np.ndarray


def read_lines(column) -> Lines:
    """The lines of an Arrow string array; they compare by their words."""
    data, offsets = text_bytes(column)
    data = data[offsets[0] : offsets[-1]]
    h, counts, start, _ = word_spans(data, offsets, lower=False)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, start)  # a word's line, counted through all texts
    text = np.repeat(np.arange(len(counts)), counts)
    fresh = np.flatnonzero(np.diff(line, prepend=-1) | np.diff(text, prepend=-1)) if len(h) else np.zeros(0, np.int64)
    stop = np.append(fresh[1:], len(h)).astype(np.int64)
    before = np.searchsorted(breaks, offsets[:-1] - offsets[0])
    return Lines(_runs_of(h, fresh, stop), stop - fresh, line[fresh] - before[text[fresh]], np.searchsorted(text[fresh], np.arange(len(counts) + 1)))


def windows(count: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest runs of lines with ``min_words`` words or more, from their first line on or back from
    their last, within texts; sorted, each once."""
    n = len(count)
    c = np.concatenate(([0], np.cumsum(count)))
    text = np.searchsorted(first, np.arange(n), "right") - 1
    end = np.searchsorted(c, c[:-1] + min_words) - 1  # the least e with c[e + 1] - c[s] >= min_words
    ahead = np.flatnonzero((end < n) & (end < first[text + 1])) if n else np.zeros(0, np.int64)
    begin = np.searchsorted(c, c[1:] - min_words, "right") - 1  # the largest s with c[e + 1] - c[s] >= min_words
    back = np.flatnonzero((begin >= 0) & (begin >= first[text])) if n else np.zeros(0, np.int64)
    both = np.unique(np.concatenate((ahead * (n + 1) + end[ahead], begin[back] * (n + 1) + back)))
    return both // (n + 1), both % (n + 1)


def winnow(marks: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The line that each window [start, end] selects: that of its least hash, the first of equal ones."""
    rank = np.empty(len(marks), np.int64)
    order = np.argsort(marks, kind="stable")
    rank[order] = np.arange(len(marks))
    level, least = 0, [rank]
    while len(start) and (2 << level) <= int((end - start).max()) + 1:
        low = least[-1]
        least.append(np.minimum(low[: len(low) - (1 << level)], low[1 << level :]))
        level += 1
    out, size = np.zeros(len(start), np.int64), end - start + 1
    for k, low in enumerate(least):
        here = (size >> k) == 1
        out[here] = np.minimum(low[start[here]], low[end[here] - (1 << k) + 1])
    return order[out]


def places(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """What one text selects: (fingerprint, its line, the windows that selected it); a window is (start line, end line, hash)."""
    import pyarrow as pa

    x = read_lines(pa.array([text]))
    start, end = windows(x.count, x.first, min_words)
    win, out = _runs_of(x.marks, start, end + 1), {}
    for k, a, b, w in zip(winnow(x.marks, start, end).tolist(), start.tolist(), end.tolist(), win.tolist(), strict=True):
        out.setdefault(k, []).append((int(x.at[a]), int(x.at[b]), w))
    return [(int(x.marks[k]), int(x.at[k]), runs) for k, runs in out.items()]


_LINES = "rk long, id long, marks binary, count binary, at binary"


def _all_lines(rows: DataFrame) -> DataFrame:
    """(rk, id, marks, count, at) of every row with lines: its line hashes, their words and their places, packed."""
    import pyarrow as pa

    def run(batches):
        for b in small_parts(batches, "text"):
            x = read_lines(b.column(2))
            cut = x.first.tolist()
            kinds = ((x.marks, np.uint64), (x.count, np.int32), (x.at, np.int32))
            packed = [pa.array([a.astype(t)[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()) for a, t in kinds]
            some = pa.array(np.diff(x.first) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *packed], names=["rk", "id", "marks", "count", "at"]).filter(some)

    return rows.mapInArrow(run, _LINES)


def _unpacked(b, columns=(2, 3, 4)) -> Lines:
    """The lines of a batch of packed rows."""
    marks, count, at = (np.frombuffer(b"".join(b.column(k).to_pylist()), t) for k, t in zip(columns, (np.uint64, np.int32, np.int32), strict=True))
    sizes = [len(x) // 8 for x in b.column(columns[0]).to_pylist()]
    return Lines(marks, count.astype(np.int64), at.astype(np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))


def _fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """(fp, rk, id, k): every selected line, k being its number among the row's lines."""
    import pyarrow as pa

    def run(batches):
        for b in small_parts(batches, "marks"):
            x = _unpacked(b)
            k = np.unique(winnow(x.marks, *windows(x.count, x.first, min_words)))
            row = np.searchsorted(x.first, k, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.marks[k].view(np.int64)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array((k - x.first[row]).astype(np.int32))], names=["fp", "rk", "id", "k"]
            )

    return lines.mapInArrow(run, "fp long, rk long, id long, k int")


def _seeds(lines: DataFrame, min_words: int) -> DataFrame:
    """(win, rk, id, start, end, n) of the windows that select one of a row's lines ``ks``: their hash, first and last line,
    and the number of the row's lines."""
    import pyarrow as pa

    def run(batches):
        for b in small_parts(batches, "marks"):
            x = _unpacked(b)
            start, end = windows(x.count, x.first, min_words)
            asked = np.zeros(len(x.marks), bool)
            ks = b.column(5)
            asked[np.repeat(x.first[:-1], [len(v) for v in ks.to_pylist()]) + np.asarray(ks.flatten())] = True
            use = asked[winnow(x.marks, start, end)]
            start, end = start[use], end[use]
            row = np.searchsorted(x.first, start, "right") - 1
            win, base = _runs_of(x.marks, start, end + 1), x.first[row]
            numbers = [pa.array(v.astype(np.int32)) for v in (start - base, end - base, x.first[row + 1] - base)]
            yield pa.RecordBatch.from_arrays([pa.array(win.view(np.int64)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), *numbers], names=["win", "rk", "id", "start", "end", "n"])

    return lines.mapInArrow(run, "win long, rk long, id long, start int, end int, n int")


def extend(marks: np.ndarray, other: np.ndarray, s: int, o: int) -> tuple[int, int]:
    """The longest run [a, b] of ``marks`` around line s that equals the lines of ``other`` around line o."""
    back = min(s, o)
    off = np.flatnonzero(marks[s - back : s][::-1] != other[o - back : o][::-1])
    a = s - (int(off[0]) if len(off) else back)
    ahead = min(len(marks) - s, len(other) - o)
    off = np.flatnonzero(marks[s : s + ahead] != other[o : o + ahead])
    return a, s + (int(off[0]) if len(off) else ahead) - 1


def repeated(lines: Lines, other: np.ndarray, seeds: list[tuple[int, int]], same: bool, min_words: int) -> list[tuple[int, int]]:
    """Ranges of places to delete in a text (``lines``, one text) that repeats lines of ``other``. Each seed (line, line of
    the other) is extended both ways; all windows within the run that comes of it are repeats. In one and the same
    text (``same``) a window that overlaps its first occurrence loses only the lines beyond it."""
    start, end = windows(lines.count, np.array([0, len(lines.count)]), min_words)
    out, done = [], {}
    for s, o in sorted(seeds):
        if s <= done.get(s - o, -1):
            continue
        a, b = extend(lines.marks, other, s, o)
        done[s - o] = b
        use = (start >= a) & (end <= b)
        low, high = lines.at[start[use]], lines.at[end[use]]
        if same:
            low = np.maximum(low, lines.at[end[use] - (s - o)] + 1)
        out += [(x, y) for x, y in zip(low.tolist(), high.tolist(), strict=True) if x <= y]
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _extended(pairs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """(rk, a, b): ranges to delete, of pairs (rk, frk, n, seeds) of a later row and the row with the first occurrence.

    The later rows of one first row are dealt to tasks by the size of their line hashes, so that it may have any number
    of them; each task gets the first row's line hashes once.
    """
    import pyarrow as pa

    weight = pairs.groupBy(F.col("frk").alias("f2")).agg(F.ceil(F.sum("n") * 16 / PART).cast("int").alias("salts"))
    sized = pairs.join(weight, F.col("frk") == F.col("f2")).withColumn("salt", F.pmod(F.xxhash64("rk"), F.col("salts")).cast("int")).drop("f2", "salts")
    left = sized.join(lines.drop("id", "ks"), "rk").select("frk", "salt", "rk", "seeds", "marks", "count", "at")
    firsts = weight.select(F.col("f2").alias("rk"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(lines.select(F.col("rk"), F.col("marks").alias("fmarks")), "rk")
    right = firsts.select(F.col("rk").alias("frk"), F.col("salt").alias("fsalt"), "fmarks")

    def run(later, first):
        if not later.num_rows or not first.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=["rk", "a", "b"])
        other = np.frombuffer(first.column("fmarks")[0].as_py(), np.uint64)
        frk, rows = first.column("frk")[0].as_py(), []
        for rk, seeds, marks, count, at in zip(*(later.column(c).to_pylist() for c in ("rk", "seeds", "marks", "count", "at")), strict=True):
            own = Lines(np.frombuffer(marks, np.uint64), np.frombuffer(count, np.int32).astype(np.int64), np.frombuffer(at, np.int32), None)
            rows += [(rk, a, b) for a, b in merged(repeated(own, other, [(x["start"], x["fstart"]) for x in seeds], rk == frk, min_words))]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["rk", "a", "b"])

    return left.groupBy("frk", "salt").cogroup(right.groupBy("frk", "fsalt")).applyInArrow(run, "rk long, a int, b int")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rk, runs): the disjoint line ranges to delete of each row that has some; rk is xxhash64(doc_id, text).

    Windows select fingerprints (their least line hash), which are written as (hash, row, line) only. Those at two places
    or more bring the windows that selected them; equal windows are joined with their first place by (doc_id, line).
    Of the windows of one run that repeat one stretch, the first is kept as a seed, and the match is extended from
    there to both sides by comparing line hashes. What later rows repeat is deleted; a run that overlaps its own first
    occurrence loses only the lines beyond it. Groups by hash have partial minima, later rows meet the first one in
    parts of bounded size, so a passage that a third of all documents share costs rows, not pairs.
    """
    modest_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    every = materialize(_all_lines(rows), "lines")
    places = materialize(_fingerprints(every, min_words), "places")
    place = F.struct("id", "rk", "k")
    shared = places.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("fp")
    asked = places.join(shared, "fp").groupBy("rk").agg(F.collect_set("k").alias("ks"))
    lines = materialize(every.join(asked, "rk").dropDuplicates(["rk"]).select("rk", "id", "marks", "count", "at", "ks"), "shared_lines")  # rows equal in id and text are one
    near = materialize(_seeds(lines, min_words), "shared_windows")
    run = F.struct("id", "rk", "start", "end")
    first = near.groupBy("win").agg(F.min(run).alias("f"), F.max(run).alias("l")).where("f < l").drop("l")
    later = near.join(first, "win").where("struct(id, rk, start, end) > f").select("rk", "n", "start", "end", F.col("f.rk").alias("frk"), F.col("f.start").alias("fstart"))
    before = F.expr("max(end) OVER (PARTITION BY rk, frk, start - fstart ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    seeds = later.withColumn("before", before).where("before IS NULL OR start > before + 1")
    pairs = materialize(seeds.groupBy("rk", "frk").agg(F.max("n").alias("n"), F.collect_set(F.struct("start", "fstart")).alias("seeds")), "pairs")
    found = _extended(pairs, lines, min_words)
    runs = found.groupBy("rk").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))
    return runs.select("rk", F.expr(_MERGED).alias("runs"))


#: Sorted line ranges that touch or overlap, made into one.
_MERGED = """aggregate(runs, cast(array() AS array<struct<a: int, b: int>>), (m, r) ->
  CASE WHEN size(m) > 0 AND r.a <= element_at(m, -1).b + 1
  THEN concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, r.b))))
  ELSE concat(m, array(r)) END)"""


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted from text, all other columns as they were, plus __lines and __deleted (which
    replace columns of these names; ``repeats_deleted`` takes any)."""
    own = [c for c in docs.columns if c not in ("__lines", "__deleted")]
    out = repeats_deleted(docs, min_words)
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in own], F.col("n_lines").alias("__lines"), F.col("n_deleted").alias("__deleted"))


def repeats_deleted(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, n_lines, n_deleted): ``row`` has all columns of ``docs`` as they were, so none of their names can clash;
    ``text`` has no repeated runs.

    Null and empty texts stay as they are; a text whose lines are all repeated becomes empty but its row stays; a text
    of one line, however long, can only repeat as a whole. Texts of any length are read whole. Ties go to the smaller
    doc_id (null first), then line. Rows equal in doc_id and text are one document, so neither repeats the other. An
    empty table gives no rows.
    """
    runs = repeated_runs(docs.select("doc_id", "text"), min_words)
    lines = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1)
    gone = lambda i: F.exists("runs", lambda r: (r["a"] <= i) & (i <= r["b"]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    out = rows.join(runs, F.col("key") == F.col("rk"), "left").withColumn("every", lines)
    out = out.withColumn("kept", F.when(F.col("runs").isNull(), F.col("every")).otherwise(F.filter("every", lambda _, i: ~gone(i))))
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    return out.select("row", text.alias("text"), F.size("every").cast("long").alias("n_lines"), (F.size("every") - F.size("kept")).cast("long").alias("n_deleted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats_deleted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "text", "n_lines", "n_deleted")


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' texts without repeated runs; n_chars follows the text where it exists. All other
    columns are carried, whatever their names."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return repeats_deleted(docs).select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, ln - 1 AS ln, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)),
k AS MATERIALIZED (
  SELECT doc_id, ln, len(w) AS nw, array_to_string(w, ' ') AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS k,
         sum(len(w)) OVER (PARTITION BY doc_id ORDER BY ln) AS c FROM l WHERE len(w) > 0),
d AS MATERIALIZED (SELECT doc_id, list(norm ORDER BY k) AS norms FROM k GROUP BY doc_id),
win AS MATERIALIZED (
  SELECT a.doc_id, a.ln AS s, b.ln AS e, array_to_string(norms[a.k : b.k], chr(10)) AS body
  FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.c - a.c + a.nw >= 50 AND (b.c - b.nw - a.c + a.nw < 50 OR b.c - a.c < 50)
  JOIN d ON d.doc_id = a.doc_id),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(e) OVER o AS fe, row_number() OVER o AS r FROM win WINDOW o AS (PARTITION BY body ORDER BY doc_id, s, e)),
gone AS MATERIALIZED (
  SELECT DISTINCT f.doc_id, g.ln FROM f, unnest(range(CASE WHEN fd = f.doc_id THEN greatest(s, fe + 1) ELSE s END, e + 1)) g(ln) WHERE r > 1),
t AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.ln) AS n_deleted, string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (g.ln IS NULL) AS kept
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.ln = l.ln GROUP BY l.doc_id)
SELECT t.doc_id, CASE WHEN n_deleted = 0 THEN d.text ELSE coalesce(kept, '') END AS text, n_lines, n_deleted FROM t JOIN documents d USING (doc_id)
"""
