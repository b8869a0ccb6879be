"""Saliency scores of tokens and pixels, summed onto packet bytes. Long form: (sample, class, packet, byte, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantile


def token_offsets(packets: DataFrame, first: int = 0) -> DataFrame:
    """``offset``: tokens of the flow ahead of the packet (flow, idx, token_count), plus ``first``."""
    w = W.partitionBy("flow").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return packets.withColumn("offset", (F.coalesce(F.sum("token_count").over(w), F.lit(0)) + first).cast("long"))


def token_scores(index: DataFrame, scores: DataFrame, first: int = 1) -> DataFrame:
    """Index rows (sample, g, ...) with the score at position ``first`` + g of the sample's score array."""
    s = scores.select("sample", F.posexplode("scores").alias("g", "score")).withColumn("g", (F.col("g") - first).cast("long")).where("g >= 0")
    return index.join(s, ["sample", "g"])


def byte_scores(tokens: DataFrame, how: str = "sum") -> DataFrame:
    """(sample, class, packet, byte, score): each token's score on every byte it covers, summed or maximal."""
    x = tokens.where("byte_end > byte_start").withColumn("byte", F.explode(F.sequence("byte_start", F.col("byte_end") - 1)))
    return x.groupBy("sample", "class", "packet", "byte").agg((F.max if how == "max" else F.sum)("score").alias("score"))


def pixel_scores(pixels: DataFrame, header: int = 80, payload: int = 240) -> DataFrame:
    """Pixel scores (sample, class, g, score) as byte scores: payload bytes follow the header's."""
    inner = F.col("g") % (header + payload)
    return pixels.withColumn("packet", F.floor(F.col("g") / (header + payload)).cast("long")).withColumn("byte", inner.cast("long")).groupBy("sample", "class", "packet", "byte").agg(F.sum("score").alias("score"))


def sample_bytes(scores: DataFrame) -> DataFrame:
    """Scores summed over a sample's packets."""
    return scores.groupBy("sample", "class", "byte").agg(F.sum("score").alias("score"))


def mean_saliency(scores: DataFrame, samples: DataFrame) -> DataFrame:
    """(class or ALL, byte, mean): sums divided by the number of samples (sample, class), not of rows."""
    sums = scores.groupingSets([["class", "byte"], ["byte"]], "class", "byte").agg(F.sum("score").alias("total"), F.grouping("class").alias("all"))
    n = samples.groupingSets([["class"], []], "class").agg(F.count("*").alias("n"), F.grouping("class").alias("all")).select(F.col("class").alias("c"), "n", F.col("all").alias("a"))
    x = sums.join(n, (F.col("all") == F.col("a")) & F.col("class").eqNullSafe(F.col("c")))
    return x.select(F.when(F.col("all") == 1, "ALL").otherwise(F.col("class")).alias("class"), "byte", (F.col("total") / F.col("n")).alias("mean"))


def grid(scores: DataFrame, packets: int, width: int) -> DataFrame:
    """(sample, packet, byte, score): a dense window from the sample's first byte on; absent cells are 0."""
    origin = scores.groupBy("sample").agg(F.min("byte").alias("origin"))
    cells = origin.withColumn("packet", F.explode(F.sequence(F.lit(0), F.lit(packets - 1)))).withColumn("byte", F.explode(F.sequence(F.col("origin"), F.col("origin") + width - 1)))
    cells = cells.select("sample", F.col("packet").cast("long").alias("packet"), "byte")
    return cells.join(scores.select("sample", "packet", "byte", "score"), ["sample", "packet", "byte"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def colour_cap(cells: DataFrame, q: float = 0.99) -> DataFrame:
    """(sample, vmax): the exact quantile over all cells of a sample's grid, null without a positive cell."""
    return cells.groupBy("sample").agg(F.when(F.max("score") > 0, F.percentile("score", F.lit(q))).alias("vmax"))


def colour_caps(cells: DataFrame, q: float = 0.99) -> DataFrame:
    """(class or ALL, vmax): the exact quantile over all cells of a class, and of all classes, null without a positive
    cell. Classes of any size are counted in many tasks; a class named ALL is counted with the whole."""
    x = cells.select(F.explode(F.array(F.col("class"), F.lit("ALL"))).alias("class"), "score")
    caps = exact_quantile(x, ["class"], "score", q, "vmax").join(x.groupBy(F.col("class").alias("c")).agg(F.max("score").alias("top")), F.col("class").eqNullSafe(F.col("c")))
    return caps.select("class", F.when(F.col("top") > 0, F.col("vmax")).alias("vmax"))
