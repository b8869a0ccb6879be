"""Queries over IPv6 packets, prefixes of both kinds of address, and server names in frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.addresses import ipv4_key
from ..functions.binary import ipv4_text
from ..operators import frames as R
from ..operators import prefixes as X
from ..sources import pcap
from .dataset_queries import _DRAWN, _NULLS, _fold, _frames, _framed, _h, _sum
from .lenses import HEADERS_SQL, PACKETS_SQL, headers, load, packets

#: What IPv6 packets are made of, as hex digits; Spark and DuckDB read these alike, h(x, n) being x in n bytes.
_SRC = """CASE idx % 4 WHEN 0 THEN concat('20010db8', {flow}, '0000000000000000', {idx}) WHEN 1 THEN concat('20010db80000', {flow}, '00000000', {seven}, {idx})
 WHEN 2 THEN concat('fe80000000000000', {mixed}, '00000000', {flow}) ELSE concat('00000000000000000000ffff', {four}) END"""
_DST = "concat('20010db8ffff', '0000000000000000', {nine})"
_KIND = "CASE idx % 5 WHEN 1 THEN '00' WHEN 2 THEN '3c' WHEN 3 THEN '2c' WHEN 4 THEN '2c' END"
_EXTRA = """CASE idx % 5 WHEN 1 THEN concat({proto}, '00010400000000') WHEN 2 THEN concat('2b00010400000000', {proto}, '00000000000000') WHEN 3 THEN concat({proto}, '0000000000002a')
 WHEN 4 THEN concat({proto}, '0000010000002a') ELSE '' END"""


def _digits(h):
    """The expressions above for one of the two dialects."""
    parts = {"flow": h("flow % 65536", 2), "idx": h("idx % 65536", 2), "seven": h("flow % 7", 2), "mixed": h("(idx * 40503) % 65536", 2), "four": h("167772160 + flow % 16777216", 4), "nine": h("idx % 9", 2), "proto": "CASE WHEN idx % 2 = 0 THEN '06' ELSE '11' END"}
    return [e.format(**parts) for e in (_SRC, _DST, _KIND, _EXTRA)]


def _frames6(spark, sf):
    src, dst, kind, extra = (F.unhex(F.expr(e)) for e in _digits(lambda e, n: f"lower(lpad(hex({e}), {2 * n}, '0'))"))
    x = packets(spark, sf).select("flow", "idx", "ts_us", src.alias("src"), dst.alias("dst"), kind.alias("kind"), extra.alias("extra"), "class")
    x = x.withColumn("proto", F.when(F.col("idx") % 2 == 0, 6).otherwise(17)).withColumn("sport", 1024 + F.col("flow") % 5000).withColumn("dport", F.lit(443))
    x = x.withColumn("payload", F.encode(F.concat("class", F.lit("-"), F.col("idx").cast("string")), "UTF-8"))
    first = F.when(F.col("kind").isNotNull(), F.conv(F.hex("kind"), 16, 10).cast("long"))
    return x.select("flow", "idx", "ts_us", F.lit(pcap.RAW).alias("link"), pcap.build_packet6("src", "dst", "sport", "dport", "payload", extensions=F.col("extra"), first=first).alias("data"))


def ipv6_frames(spark, sf):
    """IPv6 packets with and without extension headers: addresses as text, protocol, ports and checksums."""
    x = pcap.layers(R.with_checksums(_frames6(spark, sf)))
    at = F.col("l4_at") + F.when(F.col("proto") == 6, 16).otherwise(6)
    total = F.conv(F.hex(F.substring("data", (at + 1).cast("int"), F.lit(2))), 16, 10).cast("long")
    return x.select("idx", "src", "dst", F.col("proto").cast("long").alias("proto"), "sport", total.alias("l4_sum"), F.decode("payload", "UTF-8").alias("payload"), F.md5("data").alias("frame_md5"))


def zeroize_fields6(spark, sf):
    """IPv6 packets with addresses, ports and sequence numbers zero: their md5."""
    return R.zeroize_fields(_frames6(spark, sf)).select("idx", F.md5("data").alias("frame_md5"))


def _two_kinds(spark, sf):
    """Headers with keys: those with an odd number are IPv6, the same numbers behind 2001:db8::/96."""
    six = F.lit(bytes.fromhex("20010db8") + bytes(8))
    key = lambda c: F.when(F.col("idx") % 2 == 0, ipv4_key(F.col(c))).otherwise(F.concat(six, R.number(F.col(c), 4)))
    return headers(spark, sf).select("idx", key("src_ip").alias("src_key"), key("dst_ip").alias("dst_key"))


def _pairs(spark, sf):
    """A pair of ranges for every supplier, of either kind; every tenth is none."""
    k = F.col("s_suppkey")
    text = lambda at, bits: F.when(k % 10 == 7, "10.0.0/8").when(k % 2 == 0, F.concat(ipv4_text(at), F.lit("/"), bits.cast("string"))).otherwise(F.concat(F.lit("2001:db8::"), ipv4_text(at), F.lit("/"), (bits + 96).cast("string")))
    src, dst = F.lit(167772160) + (k * 104729) % 4096 * 4096, F.lit(3232235520) + (k * 7919) % 256 * 256
    return load(spark, sf, "supplier").select(k.alias("id"), text(src, 8 + k % 13).alias("src_cidr"), text(dst, 16 + k % 9).alias("dst_cidr"))


def ip_filter_pair_join(spark, sf):
    """Packets of either kind between the ends of one of many pairs of ranges, with the closest pair."""
    x = X.pair_join(_two_kinds(spark, sf), _pairs(spark, sf), "src_key", "dst_key")
    return x.select("idx", F.col("src_bits").cast("long").alias("src_bits"), F.col("dst_bits").cast("long").alias("dst_bits"), "pair_id")


def longest_prefix(spark, sf):
    """Packets of either kind with the longest of many ranges that their source lies in."""
    x = X.prefix_join(_two_kinds(spark, sf), _pairs(spark, sf).withColumnRenamed("src_cidr", "cidr"), "src_key")
    return x.select("idx", F.col("range_bits").cast("long").alias("range_bits"), "range_id")


def mixed_literal_filter(spark, sf):
    """Packets of either kind whose source lies in one of a few literal ranges."""
    return _two_kinds(spark, sf).where(X.within_any(F.col("src_key"), ["10.64.0.0/10", "2001:DB8::10.0.0.0/105", "::1", "no range"])).select("idx")


#: A TLS client hello as hex digits of expressions: dummy extensions first, more than a hundred in some.
_HELLO = """concat('160301', {record}, '01', {hand}, '0303', md5(cast(idx AS {text})), md5(cast(idx AS {text})), CASE WHEN idx % 3 = 0 THEN '00' ELSE '04deadbeef' END, '00021301', '0100', {total}, repeat('000a0000', {dummies}), '0000', {n5}, {n3}, '00', {n}, {name})"""


def _hello(h, text, name, dummies="cast(idx % 150 AS int)"):
    """``name`` is an expression for a name's hex digits."""
    n = f"(length({name}) / 2)" if text == "string" else f"(length({name}) // 2)"
    inner = f"(4 * (idx % 150) + {n} + 9)"
    session = "(CASE WHEN idx % 3 = 0 THEN 1 ELSE 5 END)"
    hand = f"(2 + 32 + {session} + 4 + 2 + 2 + {inner})"
    return _HELLO.format(record=h(f"{hand} + 4", 2), hand=h(hand, 3), total=h(inner, 2), n5=h(f"{n} + 5", 2), n3=h(f"{n} + 3", 2), n=h(n, 2), name=name, text=text, dummies=dummies)


def _hellos(spark, sf):
    name = "lower(hex(encode(concat('host', idx, '.example.org'), 'UTF-8')))"
    return _frames(spark, sf, payload=F.unhex(F.expr(_hello(lambda e, n: f"lower(lpad(hex(cast({e} AS bigint)), {2 * n}, '0'))", "string", name))))


def zeroize_names(spark, sf):
    """Frames with TLS hellos, fields zero and server names replaced: their md5."""
    return R.zeroize_fields(_hellos(spark, sf)).select("idx", F.md5("data").alias("frame_md5"))


def randomize_names(spark, sf):
    """The same with drawn fields and names."""
    return R.randomize_fields(_hellos(spark, sf), ["flow", "idx"]).select("idx", F.md5("data").alias("frame_md5"))


def _text6(h):
    """RFC 5952 text of 32 hex digits, in DuckDB."""
    joined = f"array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN ltrim(substr({h}, (i * 4 + 1)::BIGINT, 4), '0') = '' THEN '0' ELSE ltrim(substr({h}, (i * 4 + 1)::BIGINT, 4), '0') END), ':')"
    runs = " ".join(f"WHEN regexp_matches({joined}, '^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$') THEN regexp_replace({joined}, '^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$', '\\1::\\2')" for n in range(8, 1, -1))
    byte = lambda i: f"('0x' || substr({h}, {2 * i + 1}, 2))::BIGINT"
    return f"CASE WHEN starts_with({h}, '00000000000000000000ffff') THEN concat('::ffff:', {byte(12)}, '.', {byte(13)}, '.', {byte(14)}, '.', {byte(15)}) {runs} ELSE {joined} END"


_SIX, _SIX_DST, _SIX_KIND, _SIX_EXTRA = _digits(_h)


def _six(sip, dip, sport, dport):
    """CTE w: IPv6 packets with checksums, from expressions for their fields."""
    return f"""g AS MATERIALIZED (SELECT *, idx % 2 = 0 AS tcp, lower(hex(encode(class || '-' || idx))) AS body, {sip} AS sip, {dip} AS dip, {_SIX_KIND} AS kind, {_SIX_EXTRA} AS extra, {sport} || {dport} AS ports FROM ({PACKETS_SQL})),
b AS (SELECT *, ports || CASE WHEN tcp THEN '000000000000000050182000' ELSE {_h('8 + length(body) // 2', 2)} END AS l1, CASE WHEN tcp THEN '0000' ELSE '' END AS l2, (CASE WHEN tcp THEN 20 ELSE 8 END + length(body) // 2) AS n FROM g),
c AS (SELECT *, {_sum("(sip || dip || l1 || '0000' || l2 || body)")} + CASE WHEN tcp THEN 6 ELSE 17 END + n AS total FROM b),
k AS (SELECT *, CASE WHEN idx % 5 = 4 THEN 0 WHEN NOT tcp AND {_fold('total')} = 0 THEN 65535 ELSE {_fold('total')} END AS l4_sum FROM c),
w AS MATERIALIZED (SELECT *, '60000000' || {_h('n + length(extra) // 2', 2)} || coalesce(kind, CASE WHEN tcp THEN '06' ELSE '11' END) || '40' || sip || dip || extra || l1 || {_h('l4_sum', 2)} || l2 || body AS data FROM k)"""


def _replaced(name):
    return f"substr(repeat(lower(hex(encode({name}))), 30), 1, 2 * length('host' || idx || '.example.org'))"


def _named(fields, name):
    """Frames with hellos: of TCP those with ``name`` (hex digits), of UDP those with the name as it was."""
    plain, other = (_hello(_h, "varchar", x, "idx % 150") for x in ("lower(hex(encode(concat('host', idx, '.example.org'))))", name))
    return _framed(*fields, body=f"(CASE WHEN idx % 2 = 0 THEN {other} ELSE {plain} END)")


_BOTH = f"""h AS (SELECT idx, idx % 2 AS odd, src_ip, dst_ip FROM ({HEADERS_SQL})),
r AS (SELECT s_suppkey AS id, s_suppkey % 2 AS odd, 8 + s_suppkey % 13 AS sb, 16 + s_suppkey % 9 AS db, 167772160 + (s_suppkey * 104729) % 4096 * 4096 AS s, 3232235520 + (s_suppkey * 7919) % 256 * 256 AS d FROM supplier WHERE s_suppkey % 10 <> 7)"""
_NAME = "('www.' || (100 + ('0x' || substr(md5('name42|' || flow || '|' || idx), 1, 6))::BIGINT % 900) || '.com')"
SQL = {
    "ipv6_frames": f"""WITH {_six(_SIX, _SIX_DST, _h('1024 + flow % 5000', 2), "'01bb'")}
SELECT idx, {_text6('sip')} AS src, {_text6('dip')} AS dst, CASE WHEN tcp THEN 6 ELSE 17 END::BIGINT AS proto, 1024 + flow % 5000 AS sport, l4_sum, class || '-' || idx AS payload, md5(unhex(data)) AS frame_md5 FROM w""",
    "zeroize_fields6": f"""WITH {_six("repeat('0', 32)", "repeat('0', 32)", "'0000'", "'0000'")} SELECT idx, md5(unhex(data)) AS frame_md5 FROM w""",
    "ip_filter_pair_join": f"""WITH {_BOTH}, m AS (SELECT idx, sb + 96 AS src_bits, db + 96 AS dst_bits, id AS pair_id, row_number() OVER (PARTITION BY idx ORDER BY sb DESC, db DESC, id) AS k
FROM h JOIN r ON h.odd = r.odd AND src_ip >> (32 - sb) = s >> (32 - sb) AND dst_ip >> (32 - db) = d >> (32 - db)) SELECT idx, src_bits, dst_bits, pair_id FROM m WHERE k = 1""",
    "longest_prefix": f"""WITH {_BOTH}, m AS (SELECT idx, sb + 96 AS range_bits, id AS range_id, row_number() OVER (PARTITION BY idx ORDER BY sb DESC, id) AS k FROM h JOIN r ON h.odd = r.odd AND src_ip >> (32 - sb) = s >> (32 - sb))
SELECT idx, range_bits, range_id FROM m WHERE k = 1""",
    "mixed_literal_filter": f"SELECT idx FROM ({HEADERS_SQL}) WHERE CASE WHEN idx % 2 = 0 THEN src_ip >> 22 = 171966464 >> 22 ELSE src_ip >> 23 = 167772160 >> 23 END",
    "zeroize_names": f"WITH {_named(_NULLS, _replaced(repr('zeroed')))} SELECT idx, md5(unhex(head || load)) AS frame_md5 FROM w",
    "randomize_names": f"WITH {_named(_DRAWN, _replaced(_NAME))} SELECT idx, md5(unhex(head || load)) AS frame_md5 FROM w",
}
QUERIES = {f.__name__: f for f in (ipv6_frames, zeroize_fields6, ip_filter_pair_join, longest_prefix, mixed_literal_filter, zeroize_names, randomize_names)}
