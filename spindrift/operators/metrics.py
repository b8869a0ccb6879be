"""Distribution fidelity and diversity of generated against real rows.

Tables come in long form (side, feature, value), side 'real' or 'gen', so all features share one shuffle and
hot features are summed before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS, LEAST_SIMILARITY, LEAST_ENTROPY = 99, 5, 2


def long_form(df: DataFrame, side: str, features: list[str], kind: str) -> DataFrame:
    """(side, feature, value): one row per feature and row, nulls and NaNs dropped."""
    if not features:
        return df.sparkSession.createDataFrame([], f"side string, feature string, value {kind}")
    cols = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("value")) for f in features])
    out = df.select(F.col(side).alias("side"), F.explode(cols).alias("x")).select("side", "x.feature", "x.value").where("value IS NOT NULL")
    return out.where(~F.isnan("value")) if kind == "double" else out


def _sides(value: Column | str) -> tuple[Column, Column]:
    return tuple(F.sum(F.when(F.col("side") == s, value).otherwise(0)) for s in ("real", "gen"))


def eligible(long: DataFrame, least_real: int, least_gen: int) -> DataFrame:
    """Features with enough values on both sides."""
    r, g = _sides(F.lit(1))
    return long.groupBy("feature").agg(r.alias("n_real"), g.alias("n_gen")).where(f"n_real >= {least_real} AND n_gen >= {least_gen}")


def histogram(long: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, bin, real, gen): equal-width bins over both sides' range, 1-based, the last one closed."""
    span = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("hi") + 1e-6).otherwise(F.col("hi")))
    step = (F.col("hi") - F.col("lo")) / bins
    guess = F.floor((F.col("value") - F.col("lo")) / step).cast("long")
    edge = lambda k: F.col("lo") + k * step
    # the quotient can miss an edge by rounding; compare with the edges themselves
    fixed = F.when(F.col("value") < edge(guess), guess - 1).when(F.col("value") >= edge(guess + 1), guess + 1).otherwise(guess)
    r, g = _sides(F.lit(1))
    x = long.join(F.broadcast(span), "feature").withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), fixed)) + 1)
    return x.groupBy("feature", "bin").agg(r.alias("real"), g.alias("gen"))


def frequencies(long: DataFrame) -> DataFrame:
    """(feature, value, real, gen): the full outer join of both sides' value counts, as one conditional sum."""
    r, g = _sides(F.lit(1))
    return long.groupBy("feature", "value").agg(r.alias("real"), g.alias("gen"))


def divergence(counts: DataFrame, cells: int | None = None) -> DataFrame:
    """(feature, jsd, tvd) of (feature, ..., real, gen) counts: Jensen-Shannon (nats) and total variation.

    A side without any count is uniform over all ``cells`` of the feature (as many as have rows, where not given); cells
    without a row count for that.
    """
    total = counts.groupBy("feature").agg(F.sum("real").alias("r"), F.sum("gen").alias("g"), F.count("*").alias("rows"))
    total = total.withColumn("cells", F.greatest("rows", F.lit(cells)) if cells else F.col("rows"))
    share = lambda n, t: F.when(F.col(t) == 0, 1.0 / F.col("cells")).otherwise(F.try_divide(n, F.col(t).cast("double")))
    x = counts.join(F.broadcast(total), "feature").withColumn("p", share(F.col("real"), "r")).withColumn("q", share(F.col("gen"), "g"))
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda a: F.sum(F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / m)).otherwise(0.0))
    # what lies in cells without rows: all of it on the uniform side, if just one side is
    away = F.max(F.when((F.col("r") == 0) != (F.col("g") == 0), (F.col("cells") - F.col("rows")) / F.col("cells")).otherwise(0.0))
    return x.groupBy("feature").agg((0.5 * kl("p") + 0.5 * kl("q") + 0.5 * away * F.log(F.lit(2.0))).alias("jsd"), (0.5 * F.sum(F.abs(F.col("p") - F.col("q"))) + 0.5 * away).alias("tvd"))


def numeric_fidelity(df: DataFrame, side: str, features: list[str]) -> DataFrame:
    long = long_form(df, side, features, "double")
    ok = eligible(long, LEAST_SIMILARITY, LEAST_SIMILARITY)
    return divergence(histogram(long.join(F.broadcast(ok.select("feature")), "feature", "left_semi")), BINS)


def categorical_fidelity(df: DataFrame, side: str, features: list[str]) -> DataFrame:
    long = long_form(df, side, features, "string")
    ok = eligible(long, LEAST_SIMILARITY, LEAST_SIMILARITY)
    return divergence(frequencies(long.join(F.broadcast(ok.select("feature")), "feature", "left_semi")))


def fidelity_report(df: DataFrame, side: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Every feature's divergence and, as feature '*', the mean of each family; skipped features have nulls."""
    parts = [numeric_fidelity(df, side, numeric).withColumn("family", F.lit("numeric")), categorical_fidelity(df, side, categorical).withColumn("family", F.lit("categorical"))]
    each = parts[0].unionByName(parts[1])
    asked = df.sparkSession.createDataFrame([("numeric", f) for f in numeric] + [("categorical", f) for f in categorical], "family string, feature string")
    each = F.broadcast(asked).join(each, ["family", "feature"], "left").select("family", "feature", "jsd", "tvd")
    return each.unionByName(each.groupBy("family").agg(F.lit("*").alias("feature"), F.avg("jsd").alias("jsd"), F.avg("tvd").alias("tvd")))


def entropy(df: DataFrame, side: str, features: list[str]) -> DataFrame:
    """(feature, entropy_real, entropy_gen) in nats, of features with two values or more on both sides."""
    long = long_form(df, side, features, "string")
    ok = eligible(long, LEAST_ENTROPY, LEAST_ENTROPY)
    x = frequencies(long).join(F.broadcast(ok), "feature")
    h = lambda c, n: -F.sum(F.when(F.col(c) > 0, F.col(c) / F.col(n) * F.log(F.col(c) / F.col(n))).otherwise(0.0))
    return x.groupBy("feature").agg(h("real", "n_real").alias("entropy_real"), h("gen", "n_gen").alias("entropy_gen"))


def overlap(df: DataFrame, side: str, features: list[str]) -> DataFrame:
    """(feature, coverage, novelty): shared distinct values per real one, new distinct values per generated one."""
    x = frequencies(long_form(df, side, features, "string"))
    n = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0))
    return x.groupBy("feature").agg(
        F.when((n("real > 0") > 0) & (n("gen > 0") > 0), n("real > 0 AND gen > 0") / n("real > 0")).alias("coverage"),
        F.when(n("gen > 0") > 0, n("gen > 0 AND real = 0") / n("gen > 0")).alias("novelty"),
    )


def coverage(df: DataFrame, side: str, features: list[str]) -> DataFrame:
    return overlap(df, side, features).where("coverage IS NOT NULL").select("feature", "coverage")


def novelty(df: DataFrame, side: str, features: list[str]) -> DataFrame:
    return overlap(df, side, features).where("novelty IS NOT NULL").select("feature", "novelty")


def per_class_share(df: DataFrame, by: str) -> DataFrame:
    """Rows of each class and their share of all."""
    n = F.count("*")
    return df.groupBy(by).agg(n.alias("rows")).withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy()))


def diversity_means(df: DataFrame, side: str, features: list[str]) -> DataFrame:
    """One row: the means of entropies, coverage and novelty over the features that have them."""
    e, o = entropy(df, side, features), overlap(df, side, features)
    means = e.agg(F.avg("entropy_real").alias("entropy_real"), F.avg("entropy_gen").alias("entropy_gen"))
    return means.crossJoin(o.agg(F.avg("coverage").alias("coverage"), F.avg("novelty").alias("novelty")))  # one row each


def percent_strings(shares: DataFrame) -> DataFrame:
    """``percent``: a share as text with two decimals."""
    return shares.withColumn("percent", F.format_string("%.2f%%", F.round(100.0 * F.col("share"), 6)))
