"""Operator 12: a Merkle manifest of a dataset, with a proof for each row.

Rows are range-sorted by (group, key). From the row counts of the sorted partitions follows each row's rank in its group,
so each task builds the complete aligned subtrees of its own rows; what is ragged at its ends goes, by coordinate
(group, level, index), to the tasks that finish the levels above. Nodes hold lowercase hex SHA-256 of their children.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, modest_batches, table

#: Rows that one task builds a subtree of at a time: 2 ** UNIT. Levels that are finished in one shuffle above them.
UNIT, STEP = 14, 12
#: Sorted partitions: one for so many rows, but MOST at most (the driver holds one row of each).
ROWS_A_PARTITION, MOST = 1 << 17, 20_000
#: Levels of the tree over the groups come after all levels of a group.
ABOVE = 1000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parents(nodes: list[str]) -> list[str]:
    """The next level of consecutive nodes of which the first has an even index; a last one alone is hashed alone."""
    return [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def frontier(a: int, leaves: list[str]):
    """(level, index, digest) of the complete aligned nodes of the leaves from rank ``a`` on that have no complete parent."""
    level, now = 0, leaves
    while now:
        if a % 2:
            yield level, a, now[0]
            a, now = a + 1, now[1:]
        if len(now) % 2:
            yield level, a + len(now) - 1, now[-1]
            now = now[:-1]
        level, a, now = level + 1, a // 2, parents(now)


def grow(nodes: dict[tuple[int, int], str], n: int, level: int, index: int) -> dict[tuple[int, int], str]:
    """The nodes under (level, index) that follow from ``nodes`` below it, in a group of ``n`` leaves; it's among them."""
    made: dict[tuple[int, int], str] = {}

    def of(lv: int, i: int) -> str:
        found = nodes.get((lv, i)) or made.get((lv, i))
        if found is None:
            right = (2 * i + 1) << (lv - 1) < n
            found = made[lv, i] = digest(of(lv - 1, 2 * i) + (of(lv - 1, 2 * i + 1) if right else ""))
        return found

    of(level, index)
    return made


def height(n: int) -> int:
    """Levels above the leaves of a group of n leaves."""
    return max(n - 1, 0).bit_length()


@dataclass
class Forest:
    """What is built of sorted leaves: ``ranked`` rows (part, sub, g, rank, k, leaf, ...), ``runs`` of ranks by unit
    (part, sub, g, a, b, n), the ``nodes`` that more than one task needs (g, level, idx, digest) and ``roots`` (g, root)."""

    ranked: DataFrame
    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame


def _numbered(leaves: DataFrame) -> DataFrame:
    """Sorted rows with their unit (part, sub) and their rank in their group.

    Rows that are equal in group, key and leaf are told apart by a number given when the leaves are written, so
    a third of all rows may be equal. The driver sees one row of a sorted partition: its first and last group and counts.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    spark = leaves.sparkSession
    base = materialize(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    parts = min(max(math.ceil(base.count() / ROWS_A_PARTITION), int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST)
    key = ("g", "k", "leaf", "salt")
    ranged = base.repartitionByRange(parts, *key).sortWithinPartitions(*key).drop("salt")

    def count(batches):
        pos, at, before, first = 0, 0, None, True
        part = TaskContext.get().partitionId()
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column(b.schema.get_field_index("g"))
            g = pc.fill_null(pc.binary_join_element_wise("+", g, ""), "-")  # null has a name of its own
            fresh = np.ones(n, bool)
            fresh[1:] = np.asarray(pc.not_equal(g[1:], g[:-1]))
            fresh[0] = pos == 0 or g[0].as_py() != before
            index = np.arange(n)
            start = np.maximum.accumulate(np.where(fresh, index, -1))
            ats = np.where(start >= 0, index - start, at + index)
            firsts = first & ~np.logical_or.accumulate(fresh & (index + pos > 0))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(pos + index), pa.array(ats), pa.array(firsts)], names=[*b.schema.names, "part", "pos", "at", "opens"]
            )
            pos, at, before, first = pos + n, int(ats[-1]) + 1, g[-1].as_py(), bool(firsts[-1])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    ordered = materialize(ranged.mapInArrow(count, f"{names}, part int, pos long, at long, opens boolean"), "sorted_leaves")
    mine = ordered.groupBy("part").agg(F.max("pos").alias("pos"), F.min_by("g", "pos").alias("first"), F.max_by("g", "pos").alias("last"), F.max_by("at", "pos").alias("at"))
    rows, group, seen, offsets = sorted(mine.collect(), key=lambda r: r["part"]), None, 0, []
    for i, r in enumerate(rows):
        offset = seen if i and r["first"] == group else 0
        offsets.append((r["part"], offset, offset % (1 << UNIT)))
        one_group = r["at"] == r["pos"]
        seen, group = r["at"] + 1 + (offset if one_group else 0), r["last"]
    ahead = F.broadcast(spark.createDataFrame(offsets, "part int, ahead long, shift long"))  # MOST rows at most
    ranked = ordered.join(ahead, "part").withColumn("rank", F.col("at") + F.when(F.col("opens"), F.col("ahead")).otherwise(0))
    return ranked.withColumn("sub", F.shiftright(F.col("pos") + F.col("shift"), UNIT)).drop("pos", "at", "opens", "ahead", "shift")


def _frontiers(ranked: DataFrame) -> DataFrame:
    """The complete aligned subtrees of each unit's rows. Rows that come in other pieces give more nodes, no other trees."""
    import pyarrow as pa

    def run(batches):
        unit, a, held = None, 0, []

        def nodes():
            found = list(frontier(a, held))
            lv, idx, d = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([unit[2]] * len(found), pa.string()), pa.array(lv, pa.int32()), pa.array(idx, pa.int64()), pa.array(d, pa.string())], names=["g", "level", "idx", "digest"])

        for b in batches:
            for part, sub, g, rank, leaf in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (part, sub, g) != unit or rank != a + len(held):
                    if held:
                        yield nodes()
                    unit, a, held = (part, sub, g), rank, []
                held.append(leaf)
        if held:
            yield nodes()

    return ranked.select("part", "sub", "g", "rank", "leaf").mapInArrow(run, "g string, level int, idx long, digest string")


def build(leaves: DataFrame) -> Forest:
    """The trees of all groups of (g, k, leaf, ...): sorted, built by unit, finished level by level."""
    import pyarrow as pa

    ranked = _numbered(leaves)
    totals = ranked.groupBy("g").agg((F.max("rank") + 1).alias("n"))
    runs = ranked.groupBy("part", "sub", "g").agg(F.min("rank").alias("a"), (F.max("rank") + 1).alias("b"))
    totals = materialize(totals, "totals")
    runs = materialize(_joined(runs, totals, "inner"), "runs")
    most = totals.agg(F.max("n")).first()[0] or 0
    schema = pa.schema({"g": pa.string(), "n": pa.int64(), "level": pa.int32(), "idx": pa.int64(), "digest": pa.string()})

    def finish(level):
        def run(t):
            g, n = t.column("g")[0].as_py(), t.column("n")[0].as_py()
            nodes = dict(zip(zip(t.column("level").to_pylist(), t.column("idx").to_pylist(), strict=True), t.column("digest").to_pylist(), strict=True))
            up = min(level, height(n))
            made = list(grow(nodes, n, up, t.column("idx")[0].as_py() >> (up - t.column("level")[0].as_py())).items())
            return pa.table([pa.array(c, f.type) for c, f in zip(([g] * len(made), [n] * len(made), [k[0] for k, _ in made], [k[1] for k, _ in made], [d for _, d in made]), schema, strict=True)], schema=schema)

        return run

    level = UNIT
    now = materialize(_joined(_frontiers(ranked), totals, "inner").select("g", "n", "level", "idx", "digest"), "frontier")
    found = [now]
    while True:
        above = F.expr(f"shiftright(idx, {level} - level)")
        made = now.groupBy("g", above.alias("above")).applyInArrow(finish(level), "g string, n long, level int, idx long, digest string")
        found.append(materialize(made, f"level_{level}"))
        if most <= 1 << level:
            break
        # a unit's whole block may be a frontier node already, so blocks come from both tables
        now = found[0].union(found[-1]).where(F.col("level") == level) if len(found) == 2 else found[-1].where(F.col("level") == level)
        level += STEP
    nodes = found[0]
    for x in found[1:]:
        nodes = nodes.union(x)
    high = F.expr("CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END")
    roots = nodes.where((F.col("level") == high) & (F.col("idx") == 0)).select("g", F.col("digest").alias("root"))
    return Forest(ranked, runs, nodes.drop("n"), materialize(roots, "roots"))


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A null-safe join on g."""
    r = right.withColumnRenamed("g", "g2")
    return left.join(r, F.col("g").eqNullSafe(F.col("g2")), how).drop("g2")


#: A proof: level by level, what stands left and right of the node ('' where nothing does).
PROOF = "array<struct<left: string, right: string>>"


def prove(forest: Forest, keep: str, above: DataFrame | None = None) -> DataFrame:
    """(k, leaf, the columns of ``keep`` (DDL), root, top, proof) of every leaf; ``above`` has (g, path, top) of each group.

    Each unit gets at most two nodes a level from outside, so its rows' proofs follow within its task.
    """
    import pyarrow as pa

    runs = forest.runs
    levels = F.expr("sequence(0, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END)")
    ends = runs.withColumn("level", F.explode(levels)).withColumn("lo", F.expr("shiftright(a, level)")).withColumn("hi", F.expr("shiftright(b - 1, level) + 1"))
    asked = ends.select("part", "sub", "g", "level", F.explode(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo") - 1), F.when(F.col("hi") % 2 == 1, F.col("hi")))).alias("idx")).where("idx IS NOT NULL")
    on = forest.nodes.select(F.col("g").alias("g2"), F.col("level").alias("l2"), F.col("idx").alias("i2"), "digest")
    outside = asked.join(on, F.col("g").eqNullSafe(F.col("g2")) & (F.col("level") == F.col("l2")) & (F.col("idx") == F.col("i2")))
    outside = outside.select("part", "sub", "g", F.col("level").cast("int").alias("level"), "idx", F.struct(F.col("digest").alias("left"), F.lit("").alias("right")).alias("at"))
    sizes = runs.select("part", "sub", "g", F.lit(-1).alias("level"), F.col("n").alias("idx"), F.struct(F.lit("").alias("left"), F.lit("").alias("right")).alias("at"))
    told = _joined(runs.select("part", "sub", "g"), forest.roots, "inner").select("part", "sub", "g", F.lit(-2).alias("level"), F.lit(0).cast("long").alias("idx"), F.struct(F.col("root").alias("left"), F.lit("").alias("right")).alias("at"))
    beside = outside.union(sizes).union(told)
    if above is not None:
        tops = above.select("g", F.expr("concat(array(struct(top AS left, '' AS right)), path)").alias("path"))
        tops = _joined(runs.select("part", "sub", "g"), tops, "inner").select("part", "sub", "g", F.posexplode("path").alias("level", "at"))
        beside = beside.union(tops.select("part", "sub", "g", (F.col("level") + ABOVE - 1).alias("level"), F.lit(0).cast("long"), "at"))
    names = [x.split(" ")[0] for x in keep.split(", ")] if keep else []
    rows = forest.ranked.select("part", "sub", "g", "rank", "k", "leaf", *names)

    def run(left, right):
        left = left.combine_chunks().sort_by("rank")
        own, given = left.column("g").to_pylist(), {}
        for g, level, idx, at in zip(*(right.column(c).to_pylist() for c in ("g", "level", "idx", "at")), strict=True):
            given.setdefault(g, []).append((level, idx, at))
        where: dict = {}
        for i, g in enumerate(own):
            where.setdefault(g, []).append(i)
        return pa.concat_tables([proofs(left.take(pa.array(at)), given[g]) for g, at in where.items()])

    def proofs(part, given):
        outer = {(lv, idx): at["left"] for lv, idx, at in given if 0 <= lv < ABOVE - 1}
        n = next(idx for lv, idx, _ in given if lv == -1)
        root = next(at["left"] for lv, _, at in given if lv == -2)
        top = next((at["left"] for lv, _, at in given if lv == ABOVE - 1), root)
        path = [at for lv, _, at in sorted(given, key=lambda x: x[0]) if lv >= ABOVE]
        now, size, tall = part.column("leaf").to_pylist(), n, height(n)
        rank = np.asarray(part.column("rank"))
        lo, rows = int(rank[0]), part.num_rows
        pool, picks = [""], np.zeros((rows, tall + len(path), 2), np.int32)
        for level in range(tall):
            if lo % 2:
                lo, now = lo - 1, [outer[level, lo - 1], *now]
            if len(now) % 2 and lo + len(now) < size:
                now = [*now, outer[level, lo + len(now)]]
            i, base = rank >> level, len(pool) - lo
            odd = i % 2 == 1
            picks[odd, level, 0] = base + i[odd] - 1
            even = ~odd & (i + 1 < size)
            picks[even, level, 1] = base + i[even] + 1
            pool += now
            lo, size, now = lo // 2, (size + 1) // 2, parents(now)
        for j, at in enumerate(path):
            for side, d in enumerate((at["left"], at["right"])):
                if d:
                    picks[:, tall + j, side] = len(pool)
                    pool.append(d)
        words = pa.array(pool, pa.string())
        sides = pa.StructArray.from_arrays([words.take(pa.array(picks[:, :, k].ravel())) for k in (0, 1)], names=["left", "right"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (tall + len(path))), sides)
        columns = [part.column("k"), part.column("leaf"), *(part.column(c) for c in names), pa.array([root] * rows), pa.array([top] * rows), lists]
        return pa.table(columns, names=["k", "leaf", *names, "root", "top", "proof"])

    kind = forest.ranked.schema["k"].dataType.simpleString()
    fields = f"k {kind}, leaf string, {keep + ', ' if keep else ''}root string, top string, proof {PROOF}"
    return rows.groupBy("part", "sub").cogroup(beside.groupBy("part", "sub")).applyInArrow(run, fields)


def fold(leaf, proof):
    """Native: the root that follows from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda d, at: F.sha2(F.concat(at["left"], d, at["right"]).cast("binary"), 256))


def manifest(leaves: DataFrame, keep: str = "") -> DataFrame:
    """(k, leaf, the columns of ``keep``, subroot, root, proof) of every row of ``leaves`` (g string, k, leaf, ...).

    One tree a group over its leaves by k (nulls first; equal keys by leaf), and one over the groups' roots by
    g (null first, then by UTF-8 bytes). ``proof`` leads from the leaf to the root of all: ``fold(leaf, proof) = root``.
    """
    modest_batches(leaves.sparkSession)
    trees = build(leaves)
    over = build(trees.roots.select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("root").alias("leaf")))
    above = prove(over, "").select(F.col("k").alias("g"), F.col("proof").alias("path"), "top")
    return prove(trees, keep, materialize(above, "above")).withColumnsRenamed({"root": "subroot", "top": "root"})


def document_leaf(doc_id, source, lang, n_chars, text):
    """Native: the leaf of a row of documents, of its five values as text."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (doc_id, source, lang, n_chars, text)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(g, k, leaf, tampered) of documents: tampered is the leaf with n_chars + 1, where 7 divides the crc32 of doc_id
    (null elsewhere, so also without an id; a null n_chars stays null)."""
    text = [F.col(c).cast("string") for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    chosen = F.crc32(text[0].cast("binary")) % 7 == 0
    changed = F.when(chosen, document_leaf(*text[:3], more, text[4]))
    return docs.select(text[2].alias("g"), F.col("doc_id").cast("long").alias("k"), document_leaf(*text).alias("leaf"), changed.alias("tampered"))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, leaf, tampered, subroot, root, proof.

    Null values have their own mark in a leaf, so null and empty texts differ; rows with null ids come first in their
    language; repeated rows are leaves of their own, next to each other. Texts of any length are hashed where they
    are; only ids and digests are shuffled. An empty table gives no rows. Columns beside the five aren't read, so
    their names can't clash.
    """
    return manifest(document_leaves(docs), "tampered string").withColumnRenamed("k", "doc_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_manifest(table(spark, sf_dir, "documents"))
    beside = F.array_join(F.transform("proof", lambda at: F.concat(at["left"], at["right"])), "")
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(beside.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
