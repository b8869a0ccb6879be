"""Bounded samples of labelled documents, from which the two classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1_000_000


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text has this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def share(id_col: str, salt: str) -> Column:
    """A uniform number below SCALE that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(SCALE))


def sample_labels(labels: DataFrame, column: str, modulus: int, remainder: int, max_rows: int) -> DataFrame:
    """(doc_id, y) of about ``max_rows`` labelled ids at most, none of them held out.

    Ids are taken by hash, so the sample is spread evenly and doesn't depend on partitions; null ids and
    labels don't count, an id with several labels has the largest.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).dropna()
    ids = ids.where(~held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = ids.count()
    return ids.where(share("doc_id", "sample") < int(SCALE * min(1.0, max_rows / max(n, 1))))
