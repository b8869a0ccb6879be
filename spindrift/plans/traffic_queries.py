"""Queries over headers and packets: features, sessions, compliance, address filters, perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.binary import flag_names, ipv4_text
from ..operators import compliance as C
from ..operators import perturb as P
from .lenses import FLOWS_SQL, HEADERS_SQL, PACKETS_SQL, flows, headers, load, packets

SRC, DST = ["10.0.0.0/10", "224.0.0.1", "bad"], ["192.168.0.0/17"]
PAIRS = [("10.0.0.0/12", "192.168.16.0/20"), ("10.16.0.0/12", "192.168.0.0/20")]


def _packets(spark, sf):
    return packets(spark, sf)


def packet_features(spark, sf):
    """Per-packet features: gap to the packet before, addresses as text, protocol and flag names."""
    h = headers(spark, sf)
    p = P.inter_arrival(_packets(spark, sf)).select("idx", "iat_us", F.col("len").alias("pkt_len"))
    name = F.when(F.col("proto") == 6, "TCP").when(F.col("proto") == 17, "UDP").otherwise("OTHER")
    return h.join(p, "idx").select("idx", "pkt_len", "iat_us", ipv4_text(F.col("src_ip")).alias("src"), ipv4_text(F.col("dst_ip")).alias("dst"), "ip_ttl", "ip_ihl", name.alias("l4"), "sport", "dport", "tcp_window", flag_names(F.col("flags")).alias("tcp_flags"), "udp_len")


def tcp_flag_strings(spark, sf):
    """How often each combination of TCP flags occurs."""
    return headers(spark, sf).where("flags IS NOT NULL").groupBy(flag_names(F.col("flags")).alias("tcp_flags")).agg(F.count("*").alias("packets"))


def five_tuple_sessions(spark, sf):
    """Bidirectional sessions with their packets and first packet."""
    return C.sessions(headers(spark, sf))


def inter_arrival(spark, sf):
    """Gaps between a flow's packets."""
    return P.inter_arrival(_packets(spark, sf)).select("flow", "idx", "iat_us")


def protocol_violations(spark, sf):
    """Packets by the rules that they break."""
    x = C.violations(headers(spark, sf)).select("idx", F.explode("violations").alias("violation"))
    return x.groupBy("violation").agg(F.count("*").alias("packets"))


def compliance_rate(spark, sf):
    """Compliant packets and violations of each protocol."""
    x = C.compliance(headers(spark, sf), ["proto"])
    return x.withColumn("rate", F.round("rate", 8))


def compliance_rollup(spark, sf):
    """The share of compliant packets over all flows."""
    x = C.compliance(headers(spark, sf), ["flow"]).agg(F.sum("packets").alias("packets"), F.sum("compliant").alias("compliant"))
    return x.withColumn("rate", F.round(F.col("compliant") / F.col("packets"), 8))


def violation_numbering(spark, sf):
    """Violating packets numbered within their flow."""
    return C.numbered_violations(headers(spark, sf), "flow", "idx").select("flow", "idx", "number", F.array_join("violations", "; ").alias("messages"))


def ip_filter_literal(spark, sf):
    """Packets from one list of ranges to another."""
    return C.address_filter(headers(spark, sf), SRC, DST).select("idx")


def ip_filter_pairs(spark, sf):
    """Packets between the ends of one of two pairs of ranges."""
    return C.address_filter(headers(spark, sf), pairs=PAIRS).select("idx")


def _ranges(spark, sf):
    """A range of 4096 addresses for every supplier."""
    s = load(spark, sf, "supplier")
    at = F.lit(167772160) + (F.col("s_suppkey") * 104729) % 4096 * 4096
    return s.select(F.concat(ipv4_text(at), F.lit("/20")).alias("cidr"))


def ip_filter_cidr_join(spark, sf):
    """Packets whose source lies in one of many ranges."""
    return C.address_join(headers(spark, sf), _ranges(spark, sf)).select("idx")


def match_rate(spark, sf):
    """How many packets the literal filter keeps."""
    h = headers(spark, sf)
    return C.match_rate(h, C.address_filter(h, SRC, DST)).withColumn("percent", F.round("percent", 6))


def time_scale(spark, sf):
    """Gaps of all flows scaled to 0.6."""
    return P.time_scale(_packets(spark, sf), 0.6).select("flow", "idx", F.round("ts_us").cast("long").alias("ts_us"))


def jitter_drop_hash(spark, sf):
    """Packets dropped and gaps jittered by hashed randomness, in milliseconds."""
    x = P.jitter_drop(_packets(spark, sf), 10000.0, 0.03)
    return x.select("flow", "idx", F.floor(F.col("ts_us") / 1000).cast("long").alias("ts_ms"))


def tail_shift(spark, sf):
    """The first five packets of a flow scaled, the others moved after them."""
    return P.tail_shift(_packets(spark, sf), 5, 0.6).select("flow", "idx", F.round("ts_us").cast("long").alias("ts_us"))


def label_noise(spark, sf):
    """Five percent of each class moved to other classes."""
    return P.label_noise(flows(spark, sf).select("flow_id", "class"), 0.05)


def reorder(spark, sf):
    """Packets swapped with later ones."""
    return P.reorder(_packets(spark, sf), 8, 0.35, 0.20)


def reorder_light(spark, sf):
    """The same at the lightest level."""
    return P.reorder(_packets(spark, sf), 4, 0.15, 0.10)


def reorder_heavy(spark, sf):
    """The same at the heaviest level, at which swaps follow on each other over long stretches."""
    return P.reorder(_packets(spark, sf), 16, 0.70, 0.40)


def retransmit(spark, sf):
    """Packets sent again a few places off."""
    return P.retransmit(_packets(spark, sf), 0.06, 5)


def frag_merge(spark, sf):
    """Neighbouring packets merged, large ones cut, with payload and sequence number."""
    x = _packets(spark, sf).withColumn("seq", F.col("idx") * 1000003 % (1 << 32))
    x = x.withColumn("payload", F.encode(F.substring(F.repeat(F.md5(F.col("idx").cast("string")), 46), F.lit(1), F.col("len").cast("int")), "UTF-8"))
    return P.frag_merge(x, 0.20, 0.20, 600, 24).withColumn("payload", F.md5("payload"))


def _in_ms(x):
    return x.withColumn("ts_us", F.floor(F.col("ts_us") / 1000).cast("long")).withColumnRenamed("ts_us", "ts_ms")


def perturb_chain(spark, sf):
    """Retransmission, then jitter, then scaling, in milliseconds."""
    return _in_ms(P.chain(_packets(spark, sf), [2, 3, 5, 2]))


def perturb_first_n(spark, sf):
    """Retransmission and scaling of the first five packets of a flow, the others following, in milliseconds."""
    return _in_ms(P.chain(_packets(spark, sf), [2, 5], target="first_n", n=5))


def scope_split(spark, sf):
    """Packets in the scope of the first five of a flow and outside it, by class."""
    x = P.split_by_scope(_packets(spark, sf), "first_n", 5)
    return x.groupBy("class", "in_scope").agg(F.count("*").alias("packets"))


def pair_spec(spark, sf):
    """Pair specs parsed from text that comes in several forms, some malformed."""
    n = load(spark, sf, "supplier").select("s_suppkey", ipv4_text(F.lit(167772160) + F.col("s_suppkey")).alias("a"), ipv4_text(F.lit(3232235520) + F.col("s_suppkey")).alias("b"))
    spec = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("src="), "a", F.lit(",dst="), "b")).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit(" DST = "), "b", F.lit(" , Src= "), "a", F.lit(" ")))
    spec = spec.when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("src="), "a")).otherwise(F.concat(F.lit("from="), "a", F.lit(",dst=")))
    return n.select("s_suppkey", C.pair_spec(spec).alias("p")).select("s_suppkey", "p.src", "p.dst")


def events_sorted_gaps(spark, sf):
    """The widest gap of each flow."""
    x = P.inter_arrival(_packets(spark, sf), clip=True)
    return x.groupBy("flow").agg(F.count("*").alias("packets"), F.max("iat_us").alias("widest_us"))


#: The rules once more, written for DuckDB on their own.
_V = f"""v AS MATERIALIZED (SELECT *, list_filter([
  CASE WHEN ip_version != 4 THEN 'ip: bad version' END, CASE WHEN NOT (ip_ihl BETWEEN 5 AND 15) THEN 'ip: bad ihl' END, CASE WHEN ip_ttl < 1 THEN 'ip: ttl zero' END,
  CASE WHEN src_ip >> 28 = 14 THEN 'ip: multicast source' END, CASE WHEN src_ip = 0 THEN 'ip: unspecified source' END, CASE WHEN dst_ip = 0 THEN 'ip: unspecified destination' END,
  CASE WHEN ip_version = 4 AND coalesce(src_ip, dst_ip) IS NULL THEN 'ip: bad address' END,
  CASE WHEN proto = 6 AND 0 IN (sport, dport) THEN 'tcp: zero port' END, CASE WHEN proto = 6 AND flags % 2 = 1 AND flags // 4 % 2 = 1 THEN 'tcp: fin with rst' END,
  CASE WHEN proto = 6 AND flags // 2 % 2 = 1 AND flags // 16 % 2 = 1 AND tcp_ack = 0 THEN 'tcp: syn-ack without ack number' END, CASE WHEN proto = 6 AND tcp_window = 0 THEN 'tcp: zero window' END,
  CASE WHEN proto = 17 AND 0 IN (sport, dport) THEN 'udp: zero port' END, CASE WHEN proto = 17 AND udp_len < 8 THEN 'udp: short length' END,
  CASE WHEN http_version IS NOT NULL AND NOT regexp_full_match(http_method, '(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)?') THEN 'http: bad method' END,
  CASE WHEN length(http_version) > 0 AND NOT regexp_matches(http_version, '^HTTP/[0-9][.][0-9]') THEN 'http: bad version' END,
  CASE WHEN http_version IS NOT NULL AND nullif(http_host, '') IS NULL THEN 'http: no host' END,
  CASE WHEN dns_id = 0 THEN 'dns: zero id' END, CASE WHEN dns_qr NOT BETWEEN 0 AND 1 THEN 'dns: bad qr' END, CASE WHEN dns_qr = 1 AND dns_rcode >= 6 THEN 'dns: bad rcode' END
 ], lambda x: x IS NOT NULL) AS bad FROM ({HEADERS_SQL}))"""


def _u(seed, *cols):
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(cols)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_ROW = "class, len, tuple"


def _sql_ranked(name, src):
    return f"{name}r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY ts_us, idx) - 1 AS r, count(*) OVER (PARTITION BY flow) AS n FROM {src})"


def _sql_reorder(window, p, ratio):
    return f"""WITH s AS ({PACKETS_SQL}), {_sql_ranked('x', 's')},
h AS (SELECT *, {_u('swap42', 'flow', 'r')} < {p} AS wish FROM xr), g AS (SELECT *, wish AND sum(wish::INT) OVER (PARTITION BY flow ORDER BY r) <= floor(n * {ratio}::DOUBLE) AS hit FROM h),
j AS (SELECT *, least(n, r + 2 + floor({_u('far42', 'flow', 'r')} * {window - 1})::BIGINT) AS j FROM g),
f AS (SELECT flow, any_value(n) AS n, list([r + 1, j] ORDER BY r) FILTER (hit) AS swaps FROM j GROUP BY flow),
p AS (SELECT flow, CASE WHEN swaps IS NULL THEN range(1, n + 1) ELSE list_reduce(swaps, lambda acc, x: list_transform(acc, lambda v, t: CASE WHEN t = x[1] THEN acc[x[2]] WHEN t = x[2] THEN acc[x[1]] ELSE v END), range(1, n + 1)) END AS perm FROM f)
SELECT c.flow, o.idx, c.class, c.len, c.tuple, c.ts_us, true AS ok, NULL::VARCHAR AS error FROM (SELECT flow, unnest(perm) AS src, generate_subscripts(perm, 1) AS pos FROM p) q
JOIN xr c ON c.flow = q.flow AND c.r = q.src - 1 JOIN xr o ON o.flow = q.flow AND o.r = q.pos - 1"""


def _sql_retransmit(name, src, ratio, span, seed):
    return f"""{_sql_ranked(name, src)},
{name}t AS (SELECT flow, r, ts_us, CASE WHEN r = 0 THEN ts_us - 1 ELSE (ts_us + lag(ts_us) OVER (PARTITION BY flow ORDER BY r)) // 2 END AS mid FROM {name}r),
{name}e AS (SELECT flow, n, k, floor({_u(f'which{seed}', 'flow', 'k')} * n)::BIGINT AS i, floor({_u(f'where{seed}', 'flow', 'k')} * {2 * span + 1})::BIGINT - {span} AS step
  FROM (SELECT flow, n, unnest(range(1, round_even(n * {ratio}::DOUBLE, 0)::BIGINT + 1)) AS k FROM {name}r WHERE r = 0)),
{name}a AS (SELECT *, least(n, greatest(0, i + step)) AS spot FROM {name}e),
{name} AS (SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY ts_us, k, r) - 1 AS idx, {_ROW}, ts_us FROM (
  SELECT flow, {_ROW}, ts_us, r, 0 AS k FROM {name}r UNION ALL
  SELECT x.flow, {', '.join('x.' + c for c in _ROW.split(', '))}, CASE WHEN a.spot = a.n THEN t.ts_us + 1 ELSE t.mid END, a.i, a.k
  FROM {name}a a JOIN {name}t t ON t.flow = a.flow AND t.r = least(a.spot, a.n - 1) JOIN {name}r x ON x.flow = a.flow AND x.r = a.i))"""


def _sql_jitter(name, src, sigma, drop, seed):
    u, w = _u(f"drop{seed}", "flow", "idx"), "WINDOW w AS (PARTITION BY flow ORDER BY idx)"
    return f"""{name}k AS (SELECT * FROM (SELECT *, {u} >= {drop} AS k, bool_or({u} >= {drop}) OVER (PARTITION BY flow) AS any_left, row_number() OVER (PARTITION BY flow ORDER BY idx) AS r FROM {src}) WHERE k OR (NOT any_left AND r = 1)),
{name}i AS (SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL THEN 0 ELSE greatest(0, ts_us - lag(ts_us) OVER w) END AS iat, row_number() OVER w AS nth FROM {name}k {w}),
{name}s AS (SELECT *, CASE WHEN nth = 1 THEN 0.0 ELSE greatest(0.0, iat + {sigma}::DOUBLE * sqrt(-2 * ln(1 - {_u(f'jitter{seed}a', 'flow', 'idx')})) * cos(6.283185307179586 * {_u(f'jitter{seed}b', 'flow', 'idx')})) END AS g FROM {name}i),
{name} AS (SELECT flow, idx, {_ROW}, trunc(first_value(ts_us) OVER w + sum(g) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS ts_us FROM {name}s {w})"""


def _sql_scale(name, src, scale):
    w = "WINDOW w AS (PARTITION BY flow ORDER BY idx)"
    return f"""{name}i AS (SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL THEN 0 ELSE greatest(0, ts_us - lag(ts_us) OVER w) END AS iat FROM {src} {w}),
{name} AS (SELECT flow, idx, {_ROW}, trunc(first_value(ts_us) OVER w + sum(iat * {scale}::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS ts_us FROM {name}i {w})"""


def _flags(c):
    each = ", ".join(f"CASE WHEN {c} & {m} <> 0 THEN '{n}' END" for n, m in (("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32)))
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce(nullif(concat_ws(',', {each}), ''), 'NONE') END"


def _ip(c):
    return f"concat_ws('.', ({c} >> 24) & 255, ({c} >> 16) & 255, ({c} >> 8) & 255, {c} & 255)"


def _num(a, b, c, d):
    return ((a * 256 + b) * 256 + c) * 256 + d


_SRC = f"(src_ip BETWEEN {_num(10, 0, 0, 0)} AND {_num(10, 63, 255, 255)} OR src_ip = {_num(224, 0, 0, 1)})"
_DST = f"dst_ip BETWEEN {_num(192, 168, 0, 0)} AND {_num(192, 168, 127, 255)}"
_PAIRS = f"""(src_ip BETWEEN {_num(10, 0, 0, 0)} AND {_num(10, 15, 255, 255)} AND dst_ip BETWEEN {_num(192, 168, 16, 0)} AND {_num(192, 168, 31, 255)})
 OR (src_ip BETWEEN {_num(10, 16, 0, 0)} AND {_num(10, 31, 255, 255)} AND dst_ip BETWEEN {_num(192, 168, 0, 0)} AND {_num(192, 168, 15, 255)})"""
_IAT = "CASE WHEN lag(ts_us) OVER w IS NULL THEN 0 ELSE greatest(0, ts_us - lag(ts_us) OVER w) END"
_W = "WINDOW w AS (PARTITION BY flow ORDER BY idx)"
_U = lambda seed: f"('0x' || substr(md5('{seed}|' || flow || '|' || idx), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
SQL = {
    "packet_features": f"""SELECT idx, pkt_len, iat_us, {_ip('src_ip')} AS src, {_ip('dst_ip')} AS dst, ip_ttl, ip_ihl, CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'OTHER' END AS l4, sport, dport, tcp_window, {_flags('flags')} AS tcp_flags, udp_len
FROM ({HEADERS_SQL}) JOIN (SELECT idx, len AS pkt_len, ts_us - lag(ts_us) OVER (PARTITION BY flow ORDER BY idx) AS iat_us FROM ({PACKETS_SQL})) USING (idx)""",
    "tcp_flag_strings": f"SELECT {_flags('flags')} AS tcp_flags, count(*) AS packets FROM ({HEADERS_SQL}) WHERE flags IS NOT NULL GROUP BY 1",
    "five_tuple_sessions": f"""SELECT session, count(*) AS packets, min(idx) AS first_idx, arg_min(l3_len, idx) AS first_len FROM (SELECT *, CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' ELSE 'other' END || '-' ||
CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND (sport IS NULL OR sport <= dport)) THEN concat_ws(':', src_ip, sport) || '-' || concat_ws(':', dst_ip, dport) ELSE concat_ws(':', dst_ip, dport) || '-' || concat_ws(':', src_ip, sport) END AS session FROM ({HEADERS_SQL})) GROUP BY session""",
    "inter_arrival": f"SELECT flow, idx, ts_us - lag(ts_us) OVER (PARTITION BY flow ORDER BY idx) AS iat_us FROM ({PACKETS_SQL})",
    "protocol_violations": f"WITH {_V} SELECT violation, count(*) AS packets FROM (SELECT unnest(bad) AS violation FROM v) GROUP BY 1",
    "compliance_rate": f"WITH {_V} SELECT proto, count(*) AS packets, count(*) FILTER (len(bad) = 0) AS compliant, sum(len(bad))::BIGINT AS violations, round(count(*) FILTER (len(bad) = 0) / count(*), 8) AS rate FROM v GROUP BY proto",
    "compliance_rollup": f"WITH {_V} SELECT count(*) AS packets, count(*) FILTER (len(bad) = 0) AS compliant, round(count(*) FILTER (len(bad) = 0) / count(*), 8) AS rate FROM v",
    "violation_numbering": f"WITH {_V} SELECT flow, idx, row_number() OVER (PARTITION BY flow ORDER BY idx) AS number, array_to_string(bad, '; ') AS messages FROM v WHERE len(bad) > 0",
    "ip_filter_literal": f"SELECT idx FROM ({HEADERS_SQL}) WHERE {_SRC} AND {_DST}",
    "ip_filter_pairs": f"SELECT idx FROM ({HEADERS_SQL}) WHERE {_PAIRS}",
    "ip_filter_cidr_join": f"SELECT idx FROM ({HEADERS_SQL}) WHERE EXISTS (SELECT 1 FROM (SELECT 167772160 + (s_suppkey * 104729) % 4096 * 4096 AS lo FROM supplier) WHERE src_ip BETWEEN lo AND lo + 4095)",
    "match_rate": f"SELECT count(*) AS total, count(*) FILTER ({_SRC} AND {_DST}) AS matched, round(100.0::DOUBLE * count(*) FILTER ({_SRC} AND {_DST}) / count(*), 6) AS percent FROM ({HEADERS_SQL})",
    "time_scale": f"""SELECT flow, idx, round(first_value(ts_us) OVER w + sum(iat * 0.6::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS ts_us FROM (SELECT *, {_IAT} AS iat FROM ({PACKETS_SQL}) {_W}) {_W}""",
    "jitter_drop_hash": f"""WITH k AS (SELECT * FROM (SELECT *, {_U('drop42')} >= 0.03 AS k, bool_or({_U('drop42')} >= 0.03) OVER (PARTITION BY flow) AS any_left, row_number() OVER (PARTITION BY flow ORDER BY idx) AS r FROM ({PACKETS_SQL})) WHERE k OR (NOT any_left AND r = 1)),
i AS (SELECT *, {_IAT} AS iat, row_number() OVER w AS n FROM k {_W}),
s AS (SELECT *, CASE WHEN n = 1 THEN 0.0 ELSE greatest(0.0, iat + 10000.0 * sqrt(-2 * ln(1 - {_U('jitter42a')})) * cos(6.283185307179586 * {_U('jitter42b')})) END AS g FROM i)
SELECT flow, idx, floor((first_value(ts_us) OVER w + sum(g) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 1000)::BIGINT AS ts_ms FROM s {_W}""",
    "tail_shift": f"""WITH r AS (SELECT *, row_number() OVER w AS r, {_IAT} AS iat FROM ({PACKETS_SQL}) {_W}),
h AS (SELECT *, first_value(ts_us) OVER w + sum(iat * 0.6::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nw FROM r WHERE r <= 5 {_W}),
e AS (SELECT flow, arg_max(nw, r) AS new_last, arg_max(ts_us, r) AS old_last FROM h GROUP BY flow), t AS (SELECT flow, ts_us AS tail FROM r WHERE r = 6)
SELECT flow, idx, round(nw)::BIGINT AS ts_us FROM h UNION ALL
SELECT r.flow, idx, round(ts_us + new_last + greatest(1.0, tail - old_last) - tail)::BIGINT FROM r JOIN e USING (flow) JOIN t USING (flow) WHERE r > 5""",
    "label_noise": f"""WITH f AS MATERIALIZED (SELECT flow_id, class FROM ({FLOWS_SQL})), l AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT class FROM f)),
x AS (SELECT f.*, i, k, row_number() OVER (PARTITION BY f.class ORDER BY md5('noise42|' || flow_id), flow_id) AS r, count(*) OVER (PARTITION BY f.class) AS n FROM f JOIN l ON f.class = l.class),
m AS (SELECT *, CASE WHEN k > 1 AND r <= round_even(n * 0.05::DOUBLE, 0) THEN (i + 1 + ('0x' || substr(md5('move42|' || flow_id), 1, 8))::BIGINT % greatest(1, k - 1)) % k END AS t FROM x)
SELECT flow_id, m.class, coalesce(l.class, m.class) AS new_class FROM m LEFT JOIN l ON l.i = m.t""",
    "reorder": _sql_reorder(8, 0.35, 0.20),
    "reorder_light": _sql_reorder(4, 0.15, 0.10),
    "reorder_heavy": _sql_reorder(16, 0.70, 0.40),
    "retransmit": f"WITH s AS ({PACKETS_SQL}), {_sql_retransmit('x', 's', 0.06, 5, 42)} SELECT *, true AS ok, NULL::VARCHAR AS error FROM x",
    "frag_merge": f"""WITH s AS (SELECT *, idx * 1000003 % 4294967296 AS seq, substring(repeat(md5(idx::VARCHAR), 46), 1, len) AS payload FROM ({PACKETS_SQL})), {_sql_ranked('x', 's')},
l AS (SELECT *, lead(ts_us) OVER w AS ts2, lead(len) OVER w AS len2, lead(payload) OVER w AS payload2, coalesce({_u('merge42', 'flow', 'r')} < 0.20 AND tuple = lead(tuple) OVER w AND len + lead(len) OVER w <= 600, false) AS wish FROM xr WINDOW w AS (PARTITION BY flow ORDER BY r)),
b AS (SELECT *, coalesce(max(CASE WHEN NOT wish THEN r END) OVER (PARTITION BY flow ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last FROM l),
m AS (SELECT *, wish AND (r - last) % 2 = 1 AS leads FROM b), d AS (SELECT *, coalesce(lag(leads) OVER (PARTITION BY flow ORDER BY r), false) AS gone FROM m),
c AS (SELECT *, CASE WHEN NOT leads AND len >= 48 AND {_u('frag42', 'flow', 'r')} < 0.20 THEN 24 + floor({_u('cut42', 'flow', 'r')} * (len - 47))::BIGINT END AS cut FROM d WHERE NOT gone),
o AS (SELECT flow, class, tuple, r, 0 AS part, seq, CASE WHEN leads THEN len + len2 ELSE coalesce(cut, len) END AS len, CASE WHEN leads THEN (ts_us + ts2) // 2 ELSE ts_us END AS ts_us,
  CASE WHEN leads THEN payload || payload2 ELSE substring(payload, 1, coalesce(cut, len)) END AS payload FROM c
 UNION ALL SELECT flow, class, tuple, r, 1, (seq + cut) % 4294967296, len - cut, ts_us + 1, substring(payload, cut + 1) FROM c WHERE cut IS NOT NULL)
SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY ts_us, r, part) - 1 AS idx, class, len, tuple, ts_us, seq, md5(payload) AS payload, true AS ok, NULL::VARCHAR AS error FROM o""",
    "perturb_chain": f"WITH s AS ({PACKETS_SQL}), {_sql_retransmit('again', 's', 0.06, 5, 44)}, {_sql_jitter('shaken', 'again', 10000.0, 0.03, 45)}, {_sql_scale('scaled', 'shaken', 0.6)} SELECT flow, idx, {_ROW}, ts_us // 1000 AS ts_ms FROM scaled",
    "perturb_first_n": f"""WITH p AS ({PACKETS_SQL}), q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY idx) AS place FROM p), s AS (SELECT * EXCLUDE (place) FROM q WHERE place <= 5),
{_sql_retransmit('again', 's', 0.06, 5, 44)}, {_sql_scale('scaled', 'again', 0.6)}, e AS (SELECT flow, max(ts_us) AS last_new, count(*) AS new_n FROM scaled GROUP BY flow), o AS (SELECT flow, arg_max(ts_us, idx) AS last_old FROM s GROUP BY flow),
t AS (SELECT flow, ts_us AS first_tail FROM q WHERE place = 6)
SELECT flow, row_number() OVER (PARTITION BY flow ORDER BY idx) - 1 AS idx, {_ROW}, ts_us // 1000 AS ts_ms FROM scaled UNION ALL
SELECT q.flow, new_n + place - 6, {_ROW}, (ts_us + last_new + greatest(1, first_tail - last_old) - first_tail) // 1000 FROM q JOIN e USING (flow) JOIN o USING (flow) JOIN t USING (flow) WHERE place > 5""",
    "scope_split": f"SELECT class, place <= 5 AS in_scope, count(*) AS packets FROM (SELECT class, row_number() OVER (PARTITION BY flow ORDER BY idx) AS place FROM ({PACKETS_SQL})) GROUP BY 1, 2",
    "pair_spec": f"""SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN {_ip('(167772160 + s_suppkey)')} END AS src, CASE WHEN s_suppkey % 4 < 2 THEN {_ip('(3232235520 + s_suppkey)')} END AS dst FROM supplier""",
    "events_sorted_gaps": f"SELECT flow, count(*) AS packets, max(iat) AS widest_us FROM (SELECT *, {_IAT} AS iat FROM ({PACKETS_SQL}) {_W}) GROUP BY flow",
}
QUERIES = {
    f.__name__: f
    for f in (
        packet_features, tcp_flag_strings, five_tuple_sessions, inter_arrival, protocol_violations, compliance_rate, compliance_rollup, violation_numbering, ip_filter_literal,
        ip_filter_pairs, ip_filter_cidr_join, match_rate, time_scale, jitter_drop_hash, tail_shift, label_noise, reorder, reorder_light, reorder_heavy, retransmit, frag_merge, perturb_chain, perturb_first_n, scope_split, pair_spec, events_sorted_gaps,
    )
}
