"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import work_path


def exact_quantile(df: DataFrame, by: list[str], value: str, q: float, name: str = "quantile", bins: int = 1024, few: int = 4096) -> DataFrame:
    """(by, name): the interpolated ``q`` quantile of each group's values; nulls and NaN don't count, groups without values are left out.

    A quantile lies between two order statistics. For each, the range that holds it is counted in ``bins`` equal parts, all
    groups at once and with partial sums in every task, and narrowed to the part that has its rank (to that part's
    least and greatest value), until ``few`` values are left, or all are equal; only these are gathered. Small groups
    are gathered at once, and a group with a third of all rows takes a few passes over them in many tasks.
    """
    spark = df.sparkSession

    def kept(x: DataFrame) -> DataFrame:
        path = work_path(spark, "quantile")
        x.write.parquet(path)
        return spark.read.schema(x.schema).parquet(path)

    rows = kept(df.select(*by, F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"))
    at = F.col("p").cast("double")
    goals = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("p", F.lit(q) * (F.col("n") - 1))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor(at).alias("k")), F.struct(F.lit(1).alias("which"), F.ceil(at).alias("k"))))
    goals = goals.withColumn("e", ends).select(*by, "p", "e.which", "e.k", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("held"))
    goals = kept(goals)
    done = F.expr(f"held <= {few} OR lo = hi")

    def near(x: DataFrame) -> DataFrame:
        """The rows within each goal's range."""
        g = x.select(*[F.col(c).alias(f"g_{c}") for c in by], "p", "which", "k", "lo", "hi", "before")
        on = F.lit(True)
        for c in by:
            on = on & rows[c].eqNullSafe(g[f"g_{c}"])
        return rows.join(g, on).where("v BETWEEN lo AND hi").drop(*(f"g_{c}" for c in by))

    while not (rest := goals.where(~done)).isEmpty():
        part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counted = near(rest).groupBy(*by, "p", "which", "k", "before", part.alias("part")).agg(F.count("*").alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        keys = ", ".join(f"`{c}`" for c in [*by, "which"])
        ahead = F.expr(f"before + coalesce(sum(held) OVER (PARTITION BY {keys} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
        found = counted.withColumn("start", ahead).where("k >= start AND k < start + held").select(*by, "p", "which", "k", "lo", "hi", F.col("start").alias("before"), "held")
        goals = kept(goals.where(done).unionByName(found))
    equal = goals.where("lo = hi").select(*by, "p", "which", F.col("lo").alias("x"))
    gathered = near(goals.where("lo < hi")).groupBy(*by, "p", "which", "k", "before").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    found = equal.unionByName(gathered.select(*by, "p", "which", F.expr("vs[int(k - before)]").alias("x")))
    both = found.groupBy(*by, "p").agg(F.max(F.expr("if(which = 0, x, NULL)")).alias("a"), F.max(F.expr("if(which = 1, x, NULL)")).alias("b"))
    return both.select(*by, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") - F.floor("p"))).alias(name))
