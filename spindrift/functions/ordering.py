"""Stateless randomness and order statistics that don't put a whole class into one task.

A shuffle order is the order of ``md5(seed|key)``. Ranks and prefix sums in that order are taken in two steps:
rows are grouped into buckets by the hash's first digits, the buckets' sums give each bucket its offset, and only
rows of one bucket are sorted together. A class that holds most rows is so spread over all its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 3  # 4096 buckets a class


def hash_key(seed: object, *cols: str | Column) -> Column:
    """md5 of the seed and the columns, joined by '|': the same in any engine and for any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def uniform(seed: object, *cols: str | Column) -> Column:
    """A uniform number in [0, 1) from the first 8 hex digits of ``hash_key``."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("double") / 4294967296.0


def gaussian(seed: object, *cols: str | Column) -> Column:
    """A standard normal number (Box-Muller over two uniforms)."""
    u1, u2 = uniform(f"{seed}a", *cols), uniform(f"{seed}b", *cols)
    return F.sqrt(-2 * F.log(1 - u1)) * F.cos(6.283185307179586 * u2)


def hash_order(df: DataFrame, by: list[str], seed: object, key: list[str], value: str | None = None) -> DataFrame:
    """``df`` with rank (1-based, in shuffle order within ``by``), n (rows of the class) and, for a ``value``
    column, before (the sum of the values ahead of the row)."""
    bucket = F.substring("__h", 1, DIGITS)
    amount = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    base = df.withColumn("__h", hash_key(seed, *key)).withColumn("__b", bucket).withColumn("__v", amount)
    sums = base.groupBy(*by, "__b").agg(F.count("*").alias("__n"), F.sum("__v").alias("__s"))
    ahead = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__n0", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).withColumn("__s0", F.coalesce(F.sum("__s").over(ahead), F.lit(0)))
    sums = sums.withColumn("__all", F.sum("__n").over(W.partitionBy(*by))).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__b").alias("__kb"), "__n0", "__s0", "__all")
    on = base["__b"] == sums["__kb"]
    for i, c in enumerate(by):
        on = on & base[c].eqNullSafe(sums[f"__k{i}"])
    inside = W.partitionBy(*by, "__b").orderBy("__h", *key)
    out = base.join(sums, on)
    out = out.withColumn("rank", (F.col("__n0") + F.row_number().over(inside)).cast("long")).withColumn("n", F.col("__all").cast("long"))
    if value:
        out = out.withColumn("before", F.col("__s0") + F.coalesce(F.sum("__v").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return out.select(*df.columns, "rank", "n", *(["before"] if value else []))


def global_rank(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with the rank of each row by the columns ``order`` over the whole table, from ``start``; equal rows in any order.

    Rows are range-sorted and written once; a rank is the rows of the partitions before (of which the driver sees one
    count each) and the place within the partition. No task sees more than a partition.
    """
    from .paths import work_path

    spark = df.sparkSession
    path = work_path(spark, "ranked")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("__part", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND((1 << 33) - 1))
    ahead, at = [], start
    for r in sorted(rows.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        ahead.append((r["__part"], at))
        at += r["n"]
    offsets = F.broadcast(spark.createDataFrame(ahead, "__part long, __ahead long"))  # one row a partition
    return rows.join(offsets, "__part").withColumn(name, F.col("__ahead") + F.col("__in")).select(*df.columns, name)
