"""Generated traffic as JSON: merging, pairing, validation, coercion and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binary import clean_ip, clean_port

PAYLOAD_KEYS = ("payload", "data", "raw", "hex")


def merge_lists(files: DataFrame) -> DataFrame:
    """(key, items): lists (file, key, items) under one key, joined in file order."""
    x = files.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("file", "items"))).alias("f"))
    return x.select("key", F.flatten(F.transform("f", lambda f: f["items"])).alias("items"))


def zip_pairs(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(key, pos, header, payload): rows (key, pos, value) of both sides with equal key and position.

    Positions are joined as a key of their own, so a key with very many items is spread and nothing is gathered.
    """
    return headers.withColumnRenamed("value", "header").join(payloads.withColumnRenamed("value", "payload"), ["key", "pos"])


def positions(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("pos", (F.row_number().over(W.partitionBy(key).orderBy(order)) - 1).cast("long"))


def text_to_bytes(text: Column) -> Column:
    """Bytes of a string: hex digits (blanks, colons and 0x dropped) if that is all there is, else UTF-8."""
    bare = F.replace(F.replace(F.replace(F.trim(text), F.lit(" "), F.lit("")), F.lit(":"), F.lit("")), F.lit("0x"), F.lit(""))
    is_hex = bare.rlike("^[0-9a-fA-F]*$") & (F.length(bare) % 2 == 0)
    return F.when(text.isNull(), F.lit(b"")).when(is_hex, F.unhex(F.when(is_hex, bare))).otherwise(F.encode(text, "UTF-8"))


def payload_bytes(item: Column) -> Column:
    """Bytes of a payload: of the first of PAYLOAD_KEYS that a JSON object has, else of the string itself."""
    fields = F.coalesce(*[F.get_json_object(item, f"$.{k}") for k in PAYLOAD_KEYS])
    return F.when(item.isNull(), F.lit(b"")).when(F.startswith(F.trim(item), F.lit("{")), text_to_bytes(fields)).otherwise(text_to_bytes(item))


def checked_headers(rows: DataFrame) -> DataFrame:
    """Cleaned src, dst, sport and dport, protocol (6 unless a number is given, else TCP) and the first error."""
    x = rows.select("*", clean_ip(F.col("src")).alias("c_src"), clean_ip(F.col("dst")).alias("c_dst"), clean_port(F.col("sport")).alias("c_sport"), clean_port(F.col("dport")).alias("c_dport"))
    x = x.withColumn("c_proto", F.when(F.trim("proto").rlike(r"^\d{1,9}$"), F.trim("proto").cast("long")).otherwise(6)).withColumn("l4", F.when(F.col("c_proto") == 17, "udp").otherwise("tcp"))
    bad_ip, bad_port = F.col("c_src").isNull() | F.col("c_dst").isNull(), F.col("c_sport").isNull() | F.col("c_dport").isNull()
    return x.withColumn("error", F.when(bad_ip, "INVALID_IP").when(bad_port, "INVALID_PORT"))


def error_counts(checked: DataFrame) -> DataFrame:
    """Rows by error class, OK for those without."""
    return checked.groupBy(F.coalesce("error", F.lit("OK")).alias("outcome")).agg(F.count("*").alias("rows"))


def outcome_report(checked: DataFrame) -> DataFrame:
    """(outcome, rows): every known error class that occurs and OK, errors of no known class as OTHER (maybe 0), and how
    many rows were ATTEMPTED and PRODUCED."""
    known = F.when(F.col("error").isNull(), "OK").when(F.col("error").isin("INVALID_IP", "INVALID_PORT"), F.col("error")).otherwise("OTHER")
    n = checked.agg(
        *[F.sum(F.when(known == k, 1).otherwise(0)).alias(k) for k in ("OK", "INVALID_IP", "INVALID_PORT", "OTHER")], F.count("*").alias("ATTEMPTED"),
        F.sum(F.when(F.col("error").isNull(), 1).otherwise(0)).alias("PRODUCED"),
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("outcome"), F.coalesce(F.col(k), F.lit(0)).alias("rows")) for k in n.columns])
    return n.select(F.explode(pairs).alias("x")).select("x.outcome", "x.rows").where("rows > 0 OR outcome IN ('OTHER', 'ATTEMPTED', 'PRODUCED')")


def clock(rows: DataFrame, by: str, order: str, start: float, step: float, good: str = "true") -> DataFrame:
    """Times of the good rows of each group: start + step * (ordinal among the good rows), to microseconds."""
    x = rows.where(good)
    return x.withColumn("time", F.round(F.lit(start) + F.lit(step) * (F.row_number().over(W.partitionBy(by).orderBy(order)) - 1), 6))
