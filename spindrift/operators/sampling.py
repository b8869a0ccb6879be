"""Caps, fair samples, splits, targets, subsets, quotas and merges over flow manifests.

Flows have flow_id, class, source_tag, bytes and pkts. All choices are made in hash order, so they don't depend on
partitions. Where only the first rows of a group are needed the rank is filtered right away, which lets Spark
drop all others before the shuffle; where every row needs its rank, ``hash_order`` spreads the class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import hash_key, hash_order

MIN_BYTES, MIN_PKTS, MIN_FLOWS, FLOW_CAP = 2048, 3, 10, 500
TCP_MIN_LEN, UDP_MIN_LEN = 144, 103
PACKET_MIN, PACKET_CAP = 100, 5000
RATIOS = {"train": 0.8, "valid": 0.1, "test": 0.1}
PERCENTS = (1, 5, 10, 20, 50, 75)


def valid_flows(flows: DataFrame, min_bytes: int = MIN_BYTES, min_pkts: int = MIN_PKTS) -> DataFrame:
    """Flows with enough bytes and packets."""
    return flows.where((F.col("bytes") >= min_bytes) & (F.col("pkts") >= min_pkts))


def class_min(flows: DataFrame, least: int = MIN_FLOWS, by: str = "class") -> DataFrame:
    """Flows of classes that have ``least`` flows or more."""
    enough = flows.groupBy(F.col(by).alias("__c")).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return flows.join(enough, flows[by].eqNullSafe(enough["__c"]), "left_semi")


def _first(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)


def soft_cap(flows: DataFrame, cap: int = FLOW_CAP, seed: int = 42) -> DataFrame:
    """At most twice ``cap`` flows of each class and source."""
    return _first(flows, ["class", "source_tag"], [hash_key(seed, "flow_id"), "flow_id"], 2 * cap).drop("__r")


def fair_sample(flows: DataFrame, cap: int = FLOW_CAP, seed: int = 42) -> DataFrame:
    """Max-min fair: sources of a class take turns, one flow each, until ``cap`` flows are taken."""
    turns = _first(flows, ["class", "source_tag"], [hash_key(seed, "flow_id"), "flow_id"], cap).withColumnRenamed("__r", "turn")
    return _first(turns, ["class"], ["turn", hash_key(seed, "source_tag"), "source_tag"], cap).drop("__r", "turn")


def capped_sample(flows: DataFrame, least: int, cap: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(kept, overflow): classes below ``least`` are dropped, larger ones fairly sampled to ``cap``."""
    enough = class_min(flows, least)
    kept = fair_sample(enough, cap, seed)
    return kept, enough.join(kept.select("flow_id"), "flow_id", "left_anti")


def stratified_split(flows: DataFrame, seed: int = 42, ratios: dict[str, float] | None = None) -> DataFrame:
    """A split for every flow; sizes are rounded half to even within each class, test takes what is left."""
    r = ratios or RATIOS
    x = hash_order(flows, ["class"], f"split{seed}", ["flow_id"])
    train, valid = F.rint(F.col("n") * F.lit(r["train"])), F.rint(F.col("n") * F.lit(r["valid"]))
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + valid, "valid").otherwise("test")
    return x.withColumn("split", split).drop("rank", "n")


def split_stats(split: DataFrame) -> DataFrame:
    """Counts by split and class, by split, by class and in total, in one pass."""
    out = split.groupingSets([["split", "class"], ["split"], ["class"], []], "split", "class").agg(F.count("*").alias("flows"))
    return out.select(F.coalesce("split", F.lit("ALL")).alias("split"), F.coalesce("class", F.lit("ALL")).alias("class"), "flows")


def expand_test(split: DataFrame, overflow: DataFrame, cap: int, seed: int = 42, exact: bool = False) -> DataFrame:
    """``split`` with test flows added from ``overflow`` when every class reached ``cap``.

    A class gets min(smallest non-empty overflow, 10 * train - test, its overflow). ``exact`` asks for classes of
    just ``cap`` (the packet rule) instead of at least ``cap``.
    """
    counts = split.groupBy("class").agg(F.count("*").alias("total"), F.sum(F.expr("if(split = 'train', 1, 0)")).alias("train"), F.sum(F.expr("if(split = 'test', 1, 0)")).alias("test"))
    pool = overflow.groupBy("class").agg(F.count("*").alias("pool"))
    reach = F.col("total") == cap if exact else F.col("total") >= cap
    gate = counts.agg(F.bool_and(reach).alias("all_full")).crossJoin(pool.agg(F.min("pool").alias("m")))  # one row each
    take = counts.join(pool, "class").crossJoin(F.broadcast(gate)).where("all_full")
    take = take.select("class", F.greatest(F.lit(0), F.least("m", 10 * F.col("train") - F.col("test"), "pool")).alias("take"))
    ranked = hash_order(overflow, ["class"], f"expand{seed}", ["flow_id"])
    more = ranked.join(take, "class").where("rank <= take").withColumn("split", F.lit("test"))
    return split.unionByName(more.select(*split.columns))


def packet_target(counts: DataFrame, least: int = PACKET_MIN, cap: int = PACKET_CAP) -> DataFrame:
    """Per class (train, valid, test packets): how many packets can be had in the ratios; 0 below ``least``."""
    can = F.floor(F.least(*(F.col(s) / F.lit(r) for s, r in RATIOS.items())))
    short = F.least(*(F.col(s) for s in RATIOS)) <= 0
    return counts.withColumn("target", F.when(short | (can < least), 0).otherwise(F.least(can, F.lit(cap))).cast("long"))


def sample_to_target(packets: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """round(target * ratio) packets of each split; a class short in any split is dropped whole."""
    want = F.element_at(F.create_map(*[F.lit(x) for kv in RATIOS.items() for x in kv]), F.col("split"))
    have = packets.groupBy("class", "split").agg(F.count("*").alias("have")).join(targets.where("target > 0").select("class", "target"), "class")
    have = have.withColumn("want", F.rint(F.col("target") * want).cast("long"))
    good = have.groupBy("class").agg(F.bool_and(F.col("have") >= F.col("want")).alias("ok"), F.count("*").alias("splits")).where(f"ok AND splits = {len(RATIOS)}")
    wants = have.join(good, "class", "left_semi").select("class", "split", "want")
    return hash_order(packets, ["class", "split"], f"packets{seed}", ["packet_id"]).join(wants, ["class", "split"]).where("rank <= want").select(*packets.columns)


def target_overflow(packets: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Test packets of sampled classes that their sample left out: what the test split can be widened by."""
    kept = sample_to_target(packets, targets, seed).where("split = 'test'")
    classes = kept.select("class").distinct()
    return packets.where("split = 'test'").join(classes, "class", "left_semi").join(kept.select("packet_id"), "packet_id", "left_anti").select(*packets.columns)


def low_label_subsets(flows: DataFrame, percents: tuple[int, ...] = PERCENTS, seed: int = 42) -> DataFrame:
    """max(1, round(n * p / 100)) flows of each class for every percentage; subsets of different p are independent."""
    each = flows.withColumn("pct", F.explode(F.array(*map(F.lit, percents))))
    x = hash_order(each.withColumn("__key", F.concat_ws("|", "pct", "flow_id")), ["class", "pct"], seed, ["__key"])
    return x.where(F.col("rank") <= F.greatest(F.lit(1.0), F.rint(F.col("n") * F.col("pct") / 100.0))).select(*flows.columns, "pct")


def quotas(classes: DataFrame, total: int, donors: bool = True) -> DataFrame:
    """Largest-remainder quotas of (class, n); with ``donors`` empty quotas of non-empty classes take one from
    the largest ones. Class tables are small: one row per class."""
    share = F.col("n") * F.lit(total) / F.sum("n").over(W.partitionBy())
    x = classes.coalesce(1).withColumn("share", share).withColumn("base", F.floor("share"))
    left = F.lit(total) - F.sum("base").over(W.partitionBy())
    r = F.row_number().over(W.orderBy((F.col("share") - F.col("base")).desc(), "class"))
    x = x.withColumn("quota", (F.col("base") + F.when(r <= left, 1).otherwise(0)).cast("long")).select("class", "n", "quota")
    if not donors:
        return x

    def give(t):
        import pyarrow as pa

        rows = t.drop_columns(["one"]).to_pylist()
        for row in sorted(rows, key=lambda r: r["class"]):
            if row["quota"] == 0 and row["n"] > 0:
                donor = max((r for r in rows if r["quota"] > 1), key=lambda r: (r["quota"], r["class"]), default=None)
                if donor is None:
                    break
                donor["quota"] -= 1
                row["quota"] = 1
        return pa.Table.from_pylist(rows, t.drop_columns(["one"]).schema)

    return x.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(give, x.schema)


def take_until(files: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Files in shuffle order while the packets before them are fewer than the class's target; empty files never."""
    x = hash_order(files.where("pkts > 0"), ["class"], f"take{seed}", ["flow_id"], "pkts")
    return x.join(targets, "class").where("before < target").drop("n")


def merge_to_quota(files: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """Files of each class to its quota of ``total`` packets, and how many packets of each are written."""
    sizes = files.groupBy("class").agg(F.sum("pkts").alias("n"))
    targets = quotas(sizes, total, donors=False).select("class", F.col("quota").alias("target"))
    x = take_until(files, targets, seed)
    return x.withColumn("written", F.least("pkts", F.col("target") - F.col("before")).cast("long")).select(*files.columns, "rank", "target", "written")


def merge_two(one: DataFrame, two: DataFrame, total_one: int, total_two: int, seed: int = 42) -> DataFrame:
    """Both folders merged to quotas of their own, over the classes that both have."""
    common = one.select("class").intersect(two.select("class"))
    parts = [merge_to_quota(d.join(common, "class", "left_semi"), t, seed).withColumn("folder", F.lit(k)) for k, d, t in ((1, one, total_one), (2, two, total_two))]
    return parts[0].unionByName(parts[1])


def safe_names(flows: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """A file name per class that clashes with no other: later ones get the first 8 digits of their path's sha1."""
    w = W.partitionBy("class", name).orderBy(path)
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    hashed = F.concat(stem, F.lit("_h"), F.substring(F.sha1(F.col(path).cast("binary")), 1, 8), ext)
    return flows.withColumn("out_name", F.when(F.row_number().over(w) > 1, hashed).otherwise(F.col(name)))


def exact_k(rows: DataFrame, k: int, key: str) -> DataFrame:
    """Exactly ``k`` rows: the table is cycled in key order as often as needed."""
    n = rows.count()
    if not n:
        return rows.withColumn("cycle", F.lit(0).cast("long"))
    cycles = rows.withColumn("cycle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-k // n) - 1).cast("long"))))
    return cycles.orderBy("cycle", key).limit(k)
