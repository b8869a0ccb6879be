"""Perturbations of packet flows: (flow, idx, ts_us, ...) in, the same columns out.

All are windows, joins and expressions: choices that depend on earlier ones in a flow (swaps under a budget, merges of
neighbours) are settled by running sums over places, so no flow is gathered. Randomness comes from hashes of seed, flow
and place, so runs repeat whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import gaussian, hash_key, hash_order, uniform

#: Parameters by level.
LEVELS = {
    "light": {"window": 4, "p": 0.15, "ratio": 0.10, "dup": 0.02, "span": 3, "sigma_us": 3000.0, "drop": 0.01, "frag": 0.10, "merge": 0.10, "merge_max": 400, "min_frag": 32, "scale": 0.8, "noise": 0.01},
    "medium": {"window": 8, "p": 0.35, "ratio": 0.20, "dup": 0.06, "span": 5, "sigma_us": 10000.0, "drop": 0.03, "frag": 0.20, "merge": 0.20, "merge_max": 600, "min_frag": 24, "scale": 0.6, "noise": 0.05},
    "heavy": {"window": 16, "p": 0.70, "ratio": 0.40, "dup": 0.12, "span": 8, "sigma_us": 30000.0, "drop": 0.08, "frag": 0.35, "merge": 0.35, "merge_max": 800, "min_frag": 16, "scale": 0.4, "noise": 0.10},
}


def _order():
    return W.partitionBy("flow").orderBy("idx")


def inter_arrival(packets: DataFrame, clip: bool = False) -> DataFrame:
    """``iat_us``: time since the packet before in the flow; null first and maybe negative, or 0 and clipped."""
    iat = F.col("ts_us") - F.lag("ts_us").over(_order())
    return packets.withColumn("iat_us", F.greatest(F.lit(0), F.coalesce(iat, F.lit(0))) if clip else iat)


def retime(packets: DataFrame) -> DataFrame:
    """Times rebuilt from the flow's first time and the running sum of ``iat_us``."""
    first = F.first("ts_us").over(_order())
    return packets.withColumn("ts_us", first + F.sum("iat_us").over(_order().rowsBetween(W.unboundedPreceding, 0)))


def time_scale(packets: DataFrame, scale: float) -> DataFrame:
    """Gaps multiplied by ``scale``; ts_us becomes a double."""
    x = inter_arrival(packets, clip=True).withColumn("iat_us", F.col("iat_us") * scale)
    return retime(x).drop("iat_us")


def jitter_drop(packets: DataFrame, sigma_us: float, drop: float, seed: int = 42) -> DataFrame:
    """Packets dropped at random (a flow that would lose all keeps its first), then gaps shifted by N(0, sigma)."""
    kept = uniform(f"drop{seed}", "flow", "idx") >= drop
    x = packets.withColumn("__k", kept)
    some = F.max("__k").over(W.partitionBy("flow"))
    x = x.withColumn("__some", some).withColumn("__r", F.row_number().over(_order())).where("__k OR (NOT __some AND __r = 1)")
    x = inter_arrival(x.drop("__k", "__some", "__r"), clip=True)
    shaken = F.greatest(F.lit(0.0), F.col("iat_us") + sigma_us * gaussian(f"jitter{seed}", "flow", "idx"))
    x = x.withColumn("iat_us", F.when(F.row_number().over(_order()) == 1, 0.0).otherwise(shaken))
    return retime(x).drop("iat_us")


def tail_shift(packets: DataFrame, head: int, scale: float) -> DataFrame:
    """The first ``head`` packets of a flow are time-scaled, the tail is moved to follow them at the old gap."""
    x = packets.withColumn("r", F.row_number().over(_order()))
    scaled = time_scale(x.where(F.col("r") <= head), scale).withColumnRenamed("ts_us", "new_us").select("flow", "idx", "new_us")
    x = x.join(scaled, ["flow", "idx"], "left")
    ends = x.groupBy("flow").agg(
        F.max_by("new_us", F.when(F.col("r") <= head, F.col("r"))).alias("new_last"), F.max_by("ts_us", F.when(F.col("r") <= head, F.col("r"))).alias("old_last"),
        F.min(F.when(F.col("r") == head + 1, F.col("ts_us"))).alias("tail_first"),
    )
    shift = F.col("new_last") + F.greatest(F.lit(1.0), F.col("tail_first") - F.col("old_last")) - F.col("tail_first")
    x = x.join(ends, "flow").withColumn("ts_us", F.when(F.col("r") <= head, F.col("new_us")).otherwise(F.col("ts_us") + shift))
    return x.select(*packets.columns)


def label_noise(flows: DataFrame, eps: float, seed: int = 42) -> DataFrame:
    """round(eps * n) flows of each class move to another class; with fewer than two classes nothing moves."""
    labels = flows.select("class").distinct().coalesce(1)
    labels = labels.withColumn("__i", (F.row_number().over(W.orderBy("class")) - 1).cast("long"))
    labels = labels.withColumn("__k", F.count("*").over(W.partitionBy()).cast("long"))
    x = hash_order(flows, ["class"], f"noise{seed}", ["flow_id"]).join(labels, "class")
    step = F.conv(F.substring(hash_key(f"move{seed}", "flow_id"), 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1), F.col("__k") - 1)
    moved = (F.col("__k") > 1) & (F.col("rank") <= F.rint(F.col("n") * eps))
    target = labels.select(F.col("class").alias("__other"), F.col("__i").alias("__j"))
    x = x.withColumn("__t", F.when(moved, (F.col("__i") + 1 + step) % F.col("__k")))
    x = x.join(target, F.col("__t") == F.col("__j"), "left")
    return x.withColumn("new_class", F.coalesce("__other", "class")).select(*flows.columns, "new_class")


def _ranked(packets: DataFrame, needs: tuple[str, ...] = ()) -> DataFrame:
    """Packets with r (0-based place by time), n (packets of the flow) and bad: the first of ``needs`` and ts_us that is
    null somewhere in the flow, if any. Such flows are handed on as they are, with an error."""
    names = ("ts_us", *needs)
    holes = [F.when(F.max(F.col(c).isNull()), F.lit(f"null {c}")) for c in names]
    sizes = packets.groupBy(F.col("flow").alias("s_flow")).agg(F.count("*").alias("n"), F.coalesce(*holes).alias("bad"))
    x = packets.withColumn("r", (F.row_number().over(W.partitionBy("flow").orderBy("ts_us", "idx")) - 1).cast("long"))
    return x.join(sizes, F.col("flow").eqNullSafe(F.col("s_flow"))).drop("s_flow")


def _with_outcome(x: DataFrame, columns: list[str]) -> DataFrame:
    return x.select(*columns, F.col("bad").isNull().alias("ok"), F.col("bad").alias("error"))


def _renumbered(x: DataFrame, columns: list[str], *order: str) -> DataFrame:
    """Places anew by time, ties by ``order``; flows with an error keep theirs."""
    place = (F.row_number().over(W.partitionBy("flow").orderBy("ts_us", *order)) - 1).cast("long")
    return _with_outcome(x.withColumn("idx", F.when(F.col("bad").isNull(), place).otherwise(F.col("idx"))), columns)


#: Consecutive places of a flow whose swaps one row of ``reorder`` holds.
BLOCK = 4096


def swapped(swaps: list[tuple[int, int]], last: int, ahead: int) -> tuple[dict[int, int], list[int]]:
    """What swaps (r, j), in order, do to a block that ends before place ``last``: where the packet at each place that they
    touched comes from, and the same for the ``ahead`` places from ``last`` on. Places are those at the block's entry."""
    at: dict[int, int] = {}
    for r, j in swaps:
        at[r], at[j] = at.get(j, j), at.get(r, r)
    return {k: v for k, v in at.items() if k < last}, [at.get(last + i, last + i) for i in range(ahead)]


def entries(blocks: list[tuple[int, list[int]]], size: int, ahead: int) -> list[tuple[int, list[int]]]:
    """(block, what lies at its first ``ahead`` places when it is entered) of a flow's blocks (number, what they leave ahead of
    them), each composed with those before; blocks that were left out change nothing."""
    out, before, now = [], None, []
    for k, left in sorted(blocks):
        first = k * size
        if before is None or before + 1 < k:
            now = list(range(first, first + ahead))
        out.append((k, now))
        now = [now[p - first] if first <= p < first + ahead else p for p in left]
        before = k
    return out


def reorder(packets: DataFrame, window: int, p: float, ratio: float, seed: int = 42) -> DataFrame:
    """Packets swap places with one up to ``window`` - 1 later, with probability ``p`` and at most ratio * n times.

    ``idx`` is the place; times travel with their packets. A swap at place r reaches ``window`` - 1 places ahead, so a block
    of BLOCK places hands on no more than what lies at the next window - 1. Each block's swaps are worked out by
    themselves; then a flow's blocks are composed by these few places (a flow is one row of window - 1 numbers a block),
    and each block's packets get their places. The work is linear at any probability; packets are only joined.
    """
    import pyarrow as pa

    ahead, longs = window - 1, pa.list_(pa.int64())
    x = _ranked(packets).withColumn("block", F.floor(F.col("r") / BLOCK))
    far = F.least(F.col("n") - 1, F.col("r") + 1 + F.floor(uniform(f"far{seed}", "flow", "r") * (window - 1)).cast("long"))
    wish = x.where((uniform(f"swap{seed}", "flow", "r") < p) & F.col("bad").isNull()).select("flow", "block", "n", "r", far.alias("j"))
    hits = wish.groupBy("flow", "block").agg(F.max("n").alias("n"), F.count("*").alias("hits"), F.array_sort(F.collect_list(F.struct("r", "j"))).alias("swaps"))
    before = F.coalesce(F.sum("hits").over(W.partitionBy("flow").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.floor(F.col("n") * ratio) - before
    hits = hits.withColumn("swaps", F.slice("swaps", 1, F.greatest(left, F.lit(0)).cast("int"))).where(F.size("swaps") > 0).select("flow", "block", "swaps")
    flow = packets.schema["flow"].dataType.simpleString()
    pairs = lambda column: [[(v["r"], v["j"]) for v in row] for row in column.to_pylist()]

    def leave(batches):
        for b in batches:
            found = [swapped(s, (k + 1) * BLOCK, ahead)[1] for k, s in zip(b.column(1).to_pylist(), pairs(b.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, longs)], names=["flow", "block", "left"])

    def enter(batches):
        for b in batches:
            for i, blocks in enumerate(b.column(1).to_pylist()):
                found = entries([(v["block"], v["left"]) for v in blocks], BLOCK, ahead)
                arrays = [b.column(0).take(pa.array([i] * len(found))), pa.array([k for k, _ in found], pa.int64()), pa.array([e for _, e in found], longs)]
                yield pa.RecordBatch.from_arrays(arrays, names=["flow", "block", "entry"])

    def place(batches):
        for b in batches:
            rows: list[tuple[int, int, int]] = []
            for i, (k, swaps, entry) in enumerate(zip(b.column(1).to_pylist(), pairs(b.column(2)), b.column(3).to_pylist(), strict=True)):
                first = k * BLOCK
                at, over = swapped(swaps or [], first + BLOCK, ahead)
                lies = lambda q, first=first, entry=entry: entry[q - first] if q < first + ahead else q
                touched = dict.fromkeys([*at, *(range(first, first + ahead) if entry != list(range(first, first + ahead)) else ())])
                rows += [(i, lies(at.get(t, t)), t) for t in touched]
            which, source, target = (pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], [])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), source, target], names=["flow", "source", "place"])

    passed = hits.mapInArrow(leave, f"flow {flow}, block long, left array<long>")
    # the block after one with swaps is entered with what they left there, whether it has swaps or not
    following = passed.select("flow", (F.col("block") + 1).alias("block"))
    empty = following.join(passed.select(F.col("flow").alias("f2"), F.col("block").alias("b2")), F.col("flow").eqNullSafe(F.col("f2")) & (F.col("block") == F.col("b2")), "left_anti")
    empty = empty.withColumn("left", F.transform(F.sequence(F.lit(0), F.lit(ahead - 1)), lambda i: (F.col("block") + 1) * BLOCK + i))
    chains = passed.unionByName(empty).groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("block", "left"))).alias("blocks"))
    entered = chains.mapInArrow(enter, f"flow {flow}, block long, entry array<long>")
    h = hits.select(F.col("flow").alias("f2"), F.col("block").alias("b2"), "swaps")
    whole = entered.join(h, F.col("flow").eqNullSafe(F.col("f2")) & (F.col("block") == F.col("b2")), "left").select("flow", "block", "swaps", "entry")
    whole = whole.withColumn("swaps", F.coalesce("swaps", F.array().cast("array<struct<r: long, j: long>>")))
    moved = whole.mapInArrow(place, f"flow {flow}, source long, place long").where("source <> place")
    names = x.select(F.col("flow").alias("n_flow"), F.col("r").alias("n_r"), F.col("idx").alias("n_idx"))
    moved = moved.join(names, F.col("flow").eqNullSafe(F.col("n_flow")) & (F.col("place") == F.col("n_r"))).select(F.col("flow").alias("m_flow"), F.col("source").alias("m_r"), "n_idx")
    out = x.join(moved, F.col("flow").eqNullSafe(F.col("m_flow")) & (F.col("r") == F.col("m_r")), "left").withColumn("idx", F.coalesce("n_idx", "idx"))
    return _with_outcome(out, packets.columns)


def retransmit(packets: DataFrame, ratio: float, span: int, seed: int = 42) -> DataFrame:
    """round(ratio * n) packets appear again up to ``span`` places before or after, halfway between their new
    neighbours (a microsecond outside at the ends); places are counted in the flow as it came."""
    x = _ranked(packets)
    mean = F.expr("(ts_us + lag(ts_us) OVER (PARTITION BY flow ORDER BY r)) div 2")
    x = x.withColumn("between", F.when(F.col("r") == 0, F.col("ts_us") - 1).otherwise(mean))
    times = x.select(F.col("flow").alias("t_flow"), F.col("r").alias("t_r"), F.col("ts_us").alias("t_us"), "between")
    extra = x.where(f"r = 0 AND bad IS NULL AND rint(n * {ratio}D) >= 1").select("flow", "n", F.explode(F.expr(f"sequence(1L, cast(rint(n * {ratio}D) as bigint))")).alias("k"))
    extra = extra.withColumn("i", F.floor(uniform(f"which{seed}", "flow", "k") * F.col("n")).cast("long"))
    step = F.floor(uniform(f"where{seed}", "flow", "k") * (2 * span + 1)).cast("long") - span
    extra = extra.withColumn("at", F.least("n", F.greatest(F.lit(0), F.col("i") + step))).select(F.col("flow").alias("e_flow"), "k", "i", "at", "n")
    extra = extra.join(times, (F.col("e_flow") == F.col("t_flow")) & (F.least(F.col("at"), F.col("n") - 1) == F.col("t_r")))
    extra = extra.select("e_flow", "k", "i", F.when(F.col("at") == F.col("n"), F.col("t_us") + 1).otherwise(F.col("between")).alias("new_us"))
    copies = x.join(extra, (F.col("flow") == F.col("e_flow")) & (F.col("r") == F.col("i"))).withColumn("ts_us", F.col("new_us"))
    every = x.withColumn("k", F.lit(0).cast("long")).select(*packets.columns, "bad", "r", "k").unionByName(copies.select(*packets.columns, "bad", F.col("i").alias("r"), "k"))
    return _renumbered(every, packets.columns, "k", "r")


def frag_merge(packets: DataFrame, frag: float, merge: float, merge_max: int, min_frag: int, seed: int = 42) -> DataFrame:
    """Neighbours with equal ``tuple`` merge, at the mean of their times, or a packet is cut in two.

    ``len`` is the payload's length; a ``payload`` (binary) is joined or cut along, and the second part's ``seq`` is
    shifted by the first part's length, modulo 2 ** 32. Which packets merge is decided pair by pair from left to right:
    in a run of packets that would merge with their next, every second one does. All windows share one order, so payloads
    are sorted once for them and once for the new places.
    """
    names, by, flow = packets.columns, W.partitionBy("flow").orderBy("ts_us", "idx"), W.partitionBy("flow")
    x = packets.withColumn("r", (F.row_number().over(by) - 1).cast("long"))
    x = x.withColumn("bad", F.coalesce(*[F.when(F.max(F.col(c).isNull()).over(flow), F.lit(f"null {c}")) for c in ("ts_us", "len")]))
    after = {c: F.lead(c).over(by) for c in ("tuple", "len", "ts_us", *[c for c in ("payload",) if c in names])}
    x = x.withColumns({f"next_{c}": e for c, e in after.items()})
    wish = (uniform(f"merge{seed}", "flow", "r") < merge) & (F.col("tuple") == F.col("next_tuple")) & (F.col("len") + F.col("next_len") <= merge_max) & F.col("bad").isNull()
    x = x.withColumn("wish", F.coalesce(wish, F.lit(False)))
    ended = F.max(F.when(~F.col("wish"), F.col("r"))).over(by.rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("nth", F.col("r") - F.coalesce(ended, F.lit(-1))).withColumn("leads", F.col("wish") & (F.col("nth") % 2 == 1))
    x = x.withColumn("taken", F.coalesce(F.lag("leads").over(by), F.lit(False))).where("NOT taken")
    cuts = ~F.col("leads") & (F.col("len") >= 2 * min_frag) & (uniform(f"frag{seed}", "flow", "r") < frag) & F.col("bad").isNull()
    cut = min_frag + F.floor(uniform(f"cut{seed}", "flow", "r") * (F.col("len") - 2 * min_frag + 1)).cast("long")
    x = x.withColumn("cut", F.when(F.coalesce(cuts, F.lit(False)), cut))
    x = x.withColumn("part", F.explode(F.when(F.col("cut").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    new = {
        "len": F.when(F.col("leads"), F.col("len") + F.col("next_len")).when(F.col("cut").isNull(), F.col("len")).when(F.col("part") == 0, F.col("cut")).otherwise(F.col("len") - F.col("cut")),
        "ts_us": F.when(F.col("leads"), F.expr("(ts_us + next_ts_us) div 2")).otherwise(F.col("ts_us") + F.col("part")),
    }
    if "payload" in names:
        whole = F.when(F.col("leads"), F.concat("payload", "next_payload")).otherwise(F.col("payload"))
        new["payload"] = F.when(F.col("cut").isNull(), whole).when(F.col("part") == 0, F.expr("substring(payload, 1, int(cut))")).otherwise(F.expr("substring(payload, int(cut) + 1)"))
    if "seq" in names:
        new["seq"] = F.when((F.col("cut").isNotNull()) & (F.col("part") == 1), (F.col("seq") + F.col("cut")) % (1 << 32)).otherwise(F.col("seq"))
    return _renumbered(x.withColumns(new), names, "r", "part")


#: Code -> (name, how it is applied with a level's parameters).
CHAIN = {
    1: ("reorder", lambda d, q, s: reorder(d, q["window"], q["p"], q["ratio"], s).drop("ok", "error")),
    2: ("retransmit", lambda d, q, s: retransmit(d, q["dup"], q["span"], s).drop("ok", "error")),
    3: ("jitter_drop", lambda d, q, s: jitter_drop(d, q["sigma_us"], q["drop"], s).withColumn("ts_us", F.col("ts_us").cast("long"))),
    4: ("frag_merge", lambda d, q, s: frag_merge(d, q["frag"], q["merge"], q["merge_max"], q["min_frag"], s).drop("ok", "error")),
    5: ("time_scale", lambda d, q, s: time_scale(d, q["scale"]).withColumn("ts_us", F.col("ts_us").cast("long"))),
}


def split_by_scope(packets: DataFrame, target: str = "all", n: int = 0) -> DataFrame:
    """``in_scope``: whether a packet is perturbed: each, or with ``first_n`` its flow's first ``n``; n of 0 or less, or
    another target, means all."""
    if target.lower() != "first_n" or n <= 0:
        return packets.withColumn("in_scope", F.lit(True))
    return packets.withColumn("in_scope", F.row_number().over(_order()) <= n)


def chain(packets: DataFrame, codes: list[int], level: str = "medium", seed: int = 42, target: str = "all", n: int = 0) -> DataFrame:
    """Perturbations one after another; repeated codes count once. Code 6 (label noise over flows) comes last.

    With ``first_n`` only each flow's first ``n`` packets are perturbed; the others follow at the old gap (a microsecond
    at least) and are numbered after them. Flows that are no longer than ``n`` are perturbed whole.
    """
    codes = list(dict.fromkeys(codes))
    scoped = split_by_scope(packets, target, n)
    head, tail = scoped.where("in_scope").drop("in_scope"), scoped.where("NOT in_scope").drop("in_scope")
    new = head
    for code in codes:
        if code != 6:
            new = new.transform(CHAIN[code][1], LEVELS[level], seed + code)
    if target.lower() == "first_n" and n > 0:
        ends = new.groupBy("flow").agg(F.max("ts_us").alias("new_last"), F.count("*").alias("new_n"))
        ends = ends.join(head.groupBy("flow").agg(F.max_by("ts_us", "idx").alias("old_last")), "flow").join(tail.groupBy("flow").agg(F.min_by("ts_us", "idx").alias("tail_first")), "flow")
        shift = F.col("new_last") + F.greatest(F.lit(1), F.col("tail_first") - F.col("old_last")) - F.col("tail_first")
        place = (F.row_number().over(_order()) - 1).cast("long")
        moved = tail.withColumn("place", place).join(ends, "flow").withColumn("ts_us", F.col("ts_us") + shift).withColumn("idx", F.col("new_n") + F.col("place"))
        new = new.withColumn("idx", place).unionByName(moved.select(*packets.columns))
    if 6 in codes:
        flows = packets.groupBy(F.col("flow").alias("flow_id")).agg(F.min("class").alias("class"))
        noisy = label_noise(flows, LEVELS[level]["noise"], seed + 6).select(F.col("flow_id").alias("l_flow"), "new_class")
        new = new.join(noisy, F.col("flow").eqNullSafe(F.col("l_flow"))).withColumn("class", F.col("new_class")).select(*packets.columns)
    return new


def run_id(codes: list[int], level: str, target: str = "all", n: int = 0) -> str:
    names = "+".join(CHAIN[c][0] for c in dict.fromkeys(codes))
    return f"{names}_{level}_{target}{n or ''}"


def run_name(codes: Column, level: Column, target: Column, n: Column) -> Column:
    """``run_id`` as an expression: ``codes`` is an array, each perturbation of which counts once; unknown ones have no name."""
    known = F.create_map(*[F.lit(v) for k, name in ({k: name for k, (name, _) in CHAIN.items()} | {6: "label_noise"}).items() for v in (k, name)])
    names = F.array_join(F.transform(F.array_distinct(codes), lambda c: F.try_element_at(known, c)), "+")
    return F.concat(names, F.lit("_"), level, F.lit("_"), target, F.coalesce(n.cast("string"), F.lit("")))


def run_counts(result: DataFrame) -> DataFrame:
    """How many rows of a per-flow perturbation went well and how many kept their input because of an error."""
    return result.agg(F.sum(F.expr("if(ok, 1, 0)")).alias("ok"), F.sum(F.expr("if(ok, 0, 1)")).alias("failed"))
