"""The driver tables seen as flows, packets, headers, features and so on. The header arithmetic is plain SQL that
Spark and DuckDB read alike, so queries and their oracles start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as flows: class = lang, source_tag = source, bytes = UTF-8 length, pkts = lines."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("flow_id"), F.col("lang").alias("class"), F.col("source").alias("source_tag"), F.octet_length("text").cast("long").alias("bytes"),
        F.size(F.split("text", "\n")).cast("long").alias("pkts"), F.concat_ws("/", "lang", "source", "doc_id").alias("path"),
    )


FLOWS_SQL = """SELECT doc_id AS flow_id, lang AS class, source AS source_tag, strlen(text)::BIGINT AS bytes, len(string_split(text, chr(10)))::BIGINT AS pkts,
 concat_ws('/', lang, source, doc_id) AS path FROM documents"""

#: events as packets of a flow (user), in order of event_id.
_PACKETS = {"flow": "user_id", "idx": "event_id", "class": "event_type", "len": "cast(60 + event_id % 1400 as bigint)", "tuple": "cast(user_id % 3 as bigint)"}


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("long").alias("ts_us")
    return load(spark, sf_dir, "events").select(*[F.expr(e).alias(c) for c, e in _PACKETS.items()], at)


PACKETS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in _PACKETS.items()) + ", epoch_us(ts) AS ts_us FROM events"

_TCP, _WEB, _DNS = "event_id % 10 < 5", "event_id % 10 < 2", "event_id % 10 = 5"
#: events as packet headers, by arithmetic that reaches every rule.
_HEADERS = {
    "idx": "event_id", "flow": "user_id",
    "ip_version": "case when event_id % 97 = 0 then 6 else 4 end", "ip_ihl": "case when event_id % 89 = 0 then 4 else 5 end", "ip_ttl": "event_id % 64",
    "src_ip": "case when event_id % 101 = 0 then 3758096385 when event_id % 103 = 0 then 0 else 167772160 + (user_id * 7919) % 16777216 end",
    "dst_ip": "case when event_id % 107 = 0 then 0 else 3232235520 + event_id % 65536 end",
    "proto": f"case when {_TCP} then 6 when event_id % 10 < 9 then 17 else 1 end",
    "sport": "case when event_id % 10 = 9 then null when event_id % 53 = 0 then 0 else 1024 + user_id % 5000 end",
    "dport": f"case when event_id % 10 = 9 then null when event_id % 59 = 0 then 0 when {_WEB} then 80 when {_DNS} then 53 else 443 end",
    "flags": f"case when {_TCP} then (event_id * 7) % 64 end", "tcp_ack": f"case when {_TCP} then (case when event_id % 3 = 0 then 0 else event_id end) end",
    "tcp_window": f"case when {_TCP} then event_id % 50 end", "udp_len": "case when event_id % 10 between 5 and 8 then 6 + event_id % 20 end",
    "http_method": f"case when {_WEB} then (case event_id % 7 when 0 then 'GET' when 1 then 'POST' when 2 then 'FETCH' when 3 then '' else 'PUT' end) end",
    "http_version": f"case when {_WEB} then (case event_id % 3 when 0 then 'HTTP/1.1' when 1 then 'HTTP/2' else (case when event_id % 2 = 0 then '' else 'HTTP/1.0x' end) end) end",
    "http_host": f"case when {_WEB} and event_id % 4 <> 0 then (case when event_id % 4 = 1 then '' else 'host' end) end",
    "dns_id": f"case when {_DNS} then event_id % 7 end", "dns_qr": f"case when {_DNS} then event_id % 3 end", "dns_rcode": f"case when {_DNS} then event_id % 9 end",
    "l3_len": "case when event_id % 10 = 9 then 0 else 40 + event_id % 200 end",
}
_TEXT = {"http_method", "http_version", "http_host"}


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(*[F.expr(e).cast("string" if c in _TEXT else "long").alias(c) for c, e in _HEADERS.items()])


HEADERS_SQL = "SELECT " + ", ".join(f"cast({e} as {'varchar' if c in _TEXT else 'bigint'}) AS {c}" for c, e in _HEADERS.items()) + " FROM events"

NUMERIC, CATEGORICAL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_constant"], ["l_returnflag", "l_linestatus", "l_shipmonth"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as feature frames: rows with an even order key are real, the others generated."""
    x = load(spark, sf_dir, "lineitem")
    return x.select(
        F.when(F.col("l_orderkey") % 2 == 0, "real").otherwise("gen").alias("side"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.lit(1.0).alias("l_constant"),
        "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth"),
    )


FEATURES_SQL = """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'gen' END AS side, l_quantity, l_extendedprice, l_discount, l_tax, 1.0::DOUBLE AS l_constant,
 l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS l_shipmonth FROM lineitem"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as saliency: 4 packets of 16 tokens, a token covering two bytes; score = |x|."""
    x = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("string").alias("class"), F.posexplode("embedding").alias("g", "x"))
    j = F.col("g") % 16
    return x.select("sample", "class", F.floor(F.col("g") / 16).cast("long").alias("packet"), j.cast("long").alias("byte_start"), (j + 2).cast("long").alias("byte_end"), F.abs(F.col("x").cast("double")).alias("score"))


SCORES_SQL = """SELECT vec_id AS sample, label::VARCHAR AS class, (g - 1) // 16 AS packet, (g - 1) % 16 AS byte_start, (g - 1) % 16 + 2 AS byte_end, abs(x::DOUBLE) AS score
 FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS g FROM embeddings)"""


def turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """conversations as generated traffic: one role's turns of a conversation, in order."""
    return load(spark, sf_dir, "conversations").where(F.col("role") == role).select(F.col("conv_id").alias("key"), "turn", F.col("text").alias("value"))
