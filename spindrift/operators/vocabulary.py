"""Vocabularies learnt from token tables, and tokens as padded ids with segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import global_rank

SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
PAD, UNK, CLS = 0, 1, 2


def learn_vocabulary(tokens: DataFrame, column: str = "token", least: int = 1, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """(token, id, n): the special tokens first, then all tokens that occur ``least`` times, by frequency, then code order.

    Counted with partial sums and ranked over sorted partitions, so a vocabulary of any size stays in the cluster. A
    token spelt like a special one is that special one; null tokens don't count.
    """
    spark = tokens.sparkSession
    n = tokens.where(F.col(column).isNotNull() & ~F.col(column).isin(*special)).groupBy(F.col(column).alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranked = global_rank(n.withColumn("seldom", -F.col("n")), ["seldom", "token"], "id").select("token", (F.col("id") + len(special)).alias("id"), "n")
    first = spark.createDataFrame([(t, i, 0) for i, t in enumerate(special)], "token string, id long, n long")
    return first.unionByName(ranked)


def with_ids(tokens: DataFrame, vocabulary: DataFrame, column: str = "token", unknown: int = UNK) -> DataFrame:
    """``tokens`` with ``id``; tokens that the vocabulary lacks, and null ones, get ``unknown``. A plain left join: Spark
    sends the vocabulary round if it is small, else both sides by token, splitting frequent ones."""
    v = vocabulary.select(F.col("token").alias("v_token"), F.col("id").alias("v_id"))
    return tokens.join(v, F.col(column) == F.col("v_token"), "left").withColumn("id", F.coalesce("v_id", F.lit(unknown).cast("long"))).drop("v_token", "v_id")


def padded_ids(tokens: DataFrame, key: str, length: int, cls: int = CLS, pad: int = PAD) -> DataFrame:
    """(key, ids, segments) of rows (key, pos, id): [CLS] and the ids in order of pos, cut or padded to ``length``; segments
    are 1 for tokens and 0 for padding. A row whose id is null stands for a sequence without tokens. Positions past the
    length are left out before anything is gathered, so a sequence gathers ``length`` ids at most."""
    kept = tokens.where((F.col("pos") < length - 1) | F.col("id").isNull())
    x = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("t"))
    ids = F.slice(F.concat(F.array(F.lit(cls).cast("long")), F.transform("t", lambda t: t["id"])), 1, length)
    x = x.select(key, ids.alias("ids"))
    rest = F.greatest(F.lit(length) - F.size("ids"), F.lit(0))
    return x.select(key, F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), rest)).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), rest)).alias("segments"))
