"""Datasets on disk and their indexes: partitioned writes, merged captures, joins with index rows, listings' joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ordering import hash_key, hash_order
from ..sources.pcap import write_captures
from .sampling import safe_names


def materialize_flows(split: DataFrame, path: str) -> None:
    """Flows (split, class, name, path, ...) written by split and class, under names that clash with no other's."""
    parts = split.withColumn("class", F.coalesce("class", F.lit("unknown")))
    safe_names(parts.withColumn("class", F.concat_ws("/", "split", "class"))).withColumn("class", F.substring_index("class", "/", -1)).write.partitionBy("split", "class").parquet(path)


def materialize_packets(packets: DataFrame, path: str) -> None:
    """Packets (split, class, packet_id, ...) written by split and class; their ids are unique."""
    packets.write.partitionBy("split", "class").parquet(path)


def write_subsets(subsets: DataFrame, path: str) -> None:
    """Subsets (pct, class, ...) written by percentage, so one of them is read without the others."""
    subsets.write.partitionBy("pct").parquet(path)


def merge_captures(packets: DataFrame, targets: DataFrame, path: str, seed: int = 42) -> None:
    """One capture per class of packets (class, flow, idx, ts_us, data), cut at the class's ``target`` packets.

    Flows come in shuffle order, their packets in order; a class without packets has no capture. A capture is written
    by one task, which streams at most ``target`` packets.
    """
    sizes = packets.groupBy("class", "flow").agg(F.count("*").alias("pkts"))
    files = hash_order(sizes, ["class"], f"merge{seed}", ["flow"], "pkts").join(targets, "class").where("before < target")
    place = F.row_number().over(W.partitionBy("class", "flow").orderBy("idx"))
    x = packets.withColumn("place", place).join(files.select("class", "flow", "before", "target"), ["class", "flow"]).where("before + place <= target")
    x = x.select(F.concat("class", F.lit(".pcap")).alias("file"), (F.col("before") + F.col("place")).alias("idx"), "ts_us", "data")
    write_captures(x, path)


def numbered(rows: DataFrame, order: str, pieces: int = 64) -> DataFrame:
    """``rows`` with their row number by the numeric column ``order``, from 0.

    Numbers come in two steps: rows are counted by ranges between quantiles, then numbered within each range, so no task
    sees all of them.
    """
    bounds = sorted(set(rows.approxQuantile(order, [k / pieces for k in range(1, pieces)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col(order))) if bounds else F.lit(0)
    parts = rows.withColumn("__part", part)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size")).coalesce(1)  # one row per range
    ahead = F.coalesce(F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__in", F.row_number().over(W.partitionBy("__part").orderBy(order)))
    parts = parts.join(F.broadcast(sizes.select("__part", ahead.alias("__ahead"))), "__part")
    return parts.withColumn("row", (F.col("__ahead") + F.col("__in") - 1).cast("long")).drop("__part", "__in", "__ahead")


def join_by_row(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides with equal row numbers; the longer side's rest is dropped."""
    return numbered(left, left_order).join(numbered(right, right_order), "row")


def join_by_name(left: DataFrame, index: DataFrame, name: str, order: str) -> DataFrame:
    """Rows of ``left`` with the last index row (by ``order``) of their name; rows without one are dropped."""
    rest = [c for c in index.columns if c != name]
    last = index.groupBy(name).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(name, "__last.*")
    return left.join(last, name)


def plain_path(path: Column) -> Column:
    """A path with / as the only separator."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def join_by_path(images: DataFrame, index: DataFrame, path: str = "path") -> DataFrame:
    """Images with the index row of their relative path, or of that path with plain separators; others are dropped."""
    rest = [c for c in index.columns if c != path]
    x = index.select(F.col(path).alias("__p"), *rest)
    exact = images.join(x, images[path] == x["__p"]).drop("__p")
    plain = x.groupBy(plain_path(F.col("__p")).alias("__p")).agg(F.max_by(F.struct(*rest), "__p").alias("__r")).select("__p", "__r.*")
    others = images.join(x.select(F.col("__p").alias("__e")), images[path] == F.col("__e"), "left_anti")
    return exact.unionByName(others.join(plain, plain_path(F.col(path)) == F.col("__p")).drop("__p"))


def source_capture(images: DataFrame, captures: DataFrame) -> DataFrame:
    """Images (stem) with the capture (stem, ending, capture) that they come from: .pcap rather than .pcapng; null
    where there is none."""
    best = captures.groupBy("stem").agg(F.min_by("capture", F.when(F.lower("ending") == ".pcap", 0).otherwise(1)).alias("capture"))
    return images.join(best, "stem", "left")


def dataset_roots(spark: SparkSession, roots: dict[str, DataFrame]) -> DataFrame:
    """Several roots as one table, told apart by ``dataset``."""
    parts = [d.withColumn("dataset", F.lit(k)) for k, d in roots.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def common_columns(one: DataFrame, two: DataFrame) -> list[str]:
    """Columns that both have, in the first one's order; none is an error."""
    both = [c for c in one.columns if c in set(two.columns)]
    if not both:
        raise ValueError("the tables have no column in common")
    return both


def random_packets(packets: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` random packets of each flow, ``draw`` being their place in the sample."""
    draw = F.row_number().over(W.partitionBy("flow").orderBy(hash_key(f"random{seed}", "flow", "idx"), "idx"))
    return packets.withColumn("draw", draw.cast("long")).where(F.col("draw") <= n)


def random_ids(ids: DataFrame, column: str, count: int | None = None, ratio: float = 0.0, seed: int = 42) -> DataFrame:
    """``count`` random ids, or ceil(ratio * all) of them."""
    x = hash_order(ids.select(column).withColumn("whole", F.lit(1)), ["whole"], f"ids{seed}", [column])
    return x.where(F.col("rank") <= (F.lit(count) if count is not None else F.ceil(F.col("n") * ratio))).select(column)
