"""Protocol compliance as a table of rules, and address filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binary import cidr_bounds

METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")

#: (protocol, message, violated when); fields as in the header frame. A rule with a null condition isn't violated.
RULES = (
    ("ip", "bad version", "ip_version <> 4"),
    ("ip", "bad ihl", "ip_ihl < 5 OR ip_ihl > 15"),
    ("ip", "ttl zero", "ip_ttl = 0"),
    ("ip", "multicast source", "src_ip >= 3758096384 AND src_ip < 4026531840"),
    ("ip", "unspecified source", "src_ip = 0"),
    ("ip", "unspecified destination", "dst_ip = 0"),
    ("ip", "bad address", "ip_version = 4 AND (src_ip IS NULL OR dst_ip IS NULL)"),
    ("tcp", "zero port", "proto = 6 AND (sport = 0 OR dport = 0)"),
    ("tcp", "fin with rst", "proto = 6 AND (flags & 5) = 5"),
    ("tcp", "syn-ack without ack number", "proto = 6 AND (flags & 18) = 18 AND tcp_ack = 0"),
    ("tcp", "zero window", "proto = 6 AND tcp_window = 0"),
    ("udp", "zero port", "proto = 17 AND (sport = 0 OR dport = 0)"),
    ("udp", "short length", "proto = 17 AND udp_len < 8"),
    ("http", "bad method", "http_version IS NOT NULL AND http_method <> '' AND http_method NOT IN (" + ", ".join(f"'{m}'" for m in METHODS) + ")"),
    ("http", "bad version", "http_version <> '' AND NOT (http_version LIKE 'HTTP/_._%' AND substring(http_version, 6, 1) BETWEEN '0' AND '9' AND substring(http_version, 8, 1) BETWEEN '0' AND '9')"),
    ("http", "no host", "http_version IS NOT NULL AND coalesce(http_host, '') = ''"),
    ("dns", "zero id", "dns_id = 0"),
    ("dns", "bad qr", "dns_qr NOT IN (0, 1)"),
    ("dns", "bad rcode", "dns_qr = 1 AND dns_rcode > 5"),
)


def violations(packets: DataFrame) -> DataFrame:
    """``packets`` with the array ``violations`` of 'protocol: message', one pass over the row for all rules."""
    each = F.array(*[F.when(F.expr(cond), f"{p}: {m}") for p, m, cond in RULES])
    return packets.withColumn("violations", F.filter(each, lambda x: x.isNotNull()))


def compliance(packets: DataFrame, by: list[str]) -> DataFrame:
    """Per group: packets, compliant ones, violations and the rate (1 when empty)."""
    bad = F.size("violations")
    n, ok = F.count("*"), F.sum(F.when(bad == 0, 1).otherwise(0))
    x = violations(packets).groupBy(*by).agg(n.alias("packets"), ok.alias("compliant"), F.sum(bad).alias("violations"))
    return x.withColumn("rate", F.when(F.col("packets") == 0, 1.0).otherwise(F.col("compliant") / F.col("packets")))


def numbered_violations(packets: DataFrame, by: str, order: str) -> DataFrame:
    """Violating packets with their number among the violating ones of their group."""
    x = violations(packets).where(F.size("violations") > 0)
    return x.withColumn("number", F.row_number().over(W.partitionBy(by).orderBy(order)).cast("long"))


def address_filter(packets: DataFrame, src: list[str] | None = None, dst: list[str] | None = None, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Packets whose source is in ``src`` (or none given), destination in ``dst``, and both in one of ``pairs``.

    Entries are addresses or CIDR ranges; invalid ones are skipped. Packets without IPv4 addresses are dropped. The
    few literal ranges are folded into one predicate, so no join is needed.
    """
    from functools import reduce

    def within(col: str, text: str):
        low, high = cidr_bounds(F.lit(text))
        return F.coalesce(F.col(col).between(low, high), F.lit(False))

    def any_of(terms):
        return reduce(lambda a, b: a | b, terms)

    keep = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    for col, texts in (("src_ip", src), ("dst_ip", dst)):
        if texts:
            keep = keep & any_of([within(col, t) for t in texts])
    if pairs is not None:
        if not pairs:
            raise ValueError("no valid pair is left: a filter without pairs would pass everything")
        keep = keep & any_of([within("src_ip", a) & within("dst_ip", b) for a, b in pairs])
    return packets.where(keep)


def address_join(packets: DataFrame, ranges: DataFrame, col: str = "src_ip") -> DataFrame:
    """Packets whose address lies in one of many ranges (column cidr), as an equi-join on (prefix length, network).

    The prefix lengths that occur are 33 at most; a packet is looked up once for each of them, so neither a nested loop
    nor one hot block arises, and only distinct addresses are joined and then kept by a semi-join.
    """
    low, high = cidr_bounds(F.col("cidr"))
    r = ranges.select(low.alias("net"), (high - low + 1).alias("size")).where("net IS NOT NULL").distinct()
    sizes = r.select(F.col("size").alias("s")).distinct()  # 33 rows at most
    a = packets.select(F.col(col).alias("a")).where("a IS NOT NULL").distinct().crossJoin(F.broadcast(sizes))
    hit = a.join(r, (F.col("s") == F.col("size")) & ((F.col("a") - F.col("a") % F.col("s")) == F.col("net")), "left_semi").select("a").distinct()
    return packets.join(hit, packets[col] == hit["a"], "left_semi")


def pair_spec(text: Column) -> Column:
    """A struct (src, dst) from 'src=..,dst=..' text: keys in either case and order, blanks trimmed; null if malformed."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    value = lambda k: F.try_element_at(F.transform(F.filter(parts, lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))) == k), lambda p: F.trim(F.regexp_extract(p, "=(.*)$", 1))), F.lit(1))
    src, dst = F.nullif(value("src"), F.lit("")), F.nullif(value("dst"), F.lit(""))
    return F.when(src.isNotNull() & dst.isNotNull(), F.struct(src.alias("src"), dst.alias("dst")))


def match_rate(packets: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: total, matched, percent."""
    a = packets.agg(F.count("*").alias("total"))
    b = matched.agg(F.count("*").alias("matched"))  # one row each
    return a.crossJoin(b).withColumn("percent", F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("matched") / F.col("total")))


def header_features(packets: DataFrame) -> DataFrame:
    """Five-tuple, session key and length by protocol of header rows."""
    ends = F.array_sort(F.array(F.struct(F.col("src_ip").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dport").alias("port"))))
    x = packets.withColumn("l3", F.when(F.col("proto") == 6, "tcp").when(F.col("proto") == 17, "udp").otherwise("other"))
    return x.withColumn("ends", ends).withColumn("session", F.concat_ws("-", "l3", F.transform("ends", lambda e: F.concat_ws(":", e["ip"].cast("string"), e["port"].cast("string")))))


def length_gate(packets: DataFrame, tcp: int = 144, udp: int = 103) -> DataFrame:
    """TCP and UDP packets that are long enough."""
    return packets.where(((F.col("proto") == 6) & (F.col("l3_len") >= tcp)) | ((F.col("proto") == 17) & (F.col("l3_len") >= udp)))


def sessions(packets: DataFrame) -> DataFrame:
    """(session, packets, first_idx, first_len): bidirectional sessions and their first packet."""
    x = header_features(packets).groupBy("session").agg(F.count("*").alias("packets"), F.min("idx").alias("first_idx"), F.min_by("l3_len", "idx").alias("first_len"))
    return x
