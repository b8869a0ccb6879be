"""Queries over details of operators: directions, paths, literals, outcomes, overflows, listings of tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.binary import ipv4_text
from ..operators import perturb as P
from ..operators import sampling as S
from ..operators import scoring as R
from ..sources.files import literal_dicts
from .lenses import FLOWS_SQL, HEADERS_SQL, PACKETS_SQL, flows, headers, load, packets
from .sampling_queries import _FAIR, _P, _TARGET, CAP, LEAST, _packets, _split, _split_counts
from .traffic_queries import _ip, _sql_retransmit


def directional_tuples(spark, sf):
    """Packets of each five-tuple as sent: source, destination, ports and protocol; packets without ports are IP, with null ports."""
    h = headers(spark, sf).where("src_ip IS NOT NULL AND dst_ip IS NOT NULL")
    l4 = F.when(F.col("proto") == 6, "TCP").when(F.col("proto") == 17, "UDP").otherwise("IP")
    port = lambda c: F.when(F.col("proto").isin(6, 17), F.col(c)).alias(c)
    return h.groupBy(ipv4_text(F.col("src_ip")).alias("src"), ipv4_text(F.col("dst_ip")).alias("dst"), port("sport"), port("dport"), l4.alias("l4")).agg(F.count("*").alias("packets"))


def path_parts(spark, sf):
    """Paths by parent, name, stem and suffix, with the digests of the path."""
    p = flows(spark, sf).select("flow_id", F.concat("path", F.lit(".v1.pcap")).alias("path"))
    name = F.substring_index("path", "/", -1)
    parent = F.regexp_replace("path", "/[^/]*$", "")
    digests = [F.sha1(F.col("path").cast("binary")).alias("sha1"), F.sha2(F.col("path").cast("binary"), 256).alias("sha256"), F.md5(F.col("path").cast("binary")).alias("md5")]
    return p.select("flow_id", parent.alias("parent"), name.alias("name"), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("stem"), F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"), *digests)


def literal_values(spark, sf):
    """Values from dictionary text in single or double quotes; text that is none has null."""
    s = load(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("k"))
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("{'a': 'x"), "k", F.lit("', 'b': '1'}"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit('{"a": "x'), "k", F.lit('"}'))).otherwise(F.concat(F.lit("["), "k"))
    return s.select("s_suppkey", literal_dicts(text)["a"].alias("a"))


def run_ids(spark, sf):
    """Names of runs, one a document: its perturbations, level and scope follow from its number."""
    d = load(spark, sf, "documents").select("doc_id")
    codes = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 4), lambda i: (1 + (F.col("doc_id") + 3 * i) % 6).cast("int"))
    level = F.element_at(F.array(*map(F.lit, ("light", "medium", "heavy"))), (1 + F.col("doc_id") % 3).cast("int"))
    first = F.col("doc_id") % 2 == 0
    return d.select("doc_id", P.run_name(codes, level, F.when(first, "first").otherwise("all"), F.when(first, 1 + F.col("doc_id") % 10)).alias("run"))


def perturb_outcomes(spark, sf):
    """Packets after a retransmission that went well, and those of flows that had an error."""
    x = packets(spark, sf).withColumn("ts_us", F.when(F.col("flow") % 10 != 3, F.col("ts_us")))
    return P.run_counts(P.retransmit(x, 0.06, 5))


def gold_saliency(spark, sf):
    """Saliency sums of a linear scorer for each vector's own label."""
    import numpy as np

    w = np.cos(np.arange(640, dtype=np.float64)).reshape(64, 10)
    x = load(spark, sf, "embeddings").where("label IS NOT NULL").withColumn("gold", F.pmod(F.col("label").cast("long"), F.lit(10)))
    out = R.apply_scorer(x, R.LinearScorer(w, np.zeros(10)), "embedding", "vec_id", "gold")
    return out.select("vec_id", F.round(F.aggregate("saliency", F.lit(0.0), lambda a, b: a + b), 6).alias("saliency"))


def packet_target_overflow(spark, sf):
    """Test packets that the sample to targets left out, by class."""
    p = _packets(spark, sf)
    x = S.target_overflow(p, S.packet_target(_split_counts(p), cap=300))
    return x.groupBy("class").agg(F.count("*").alias("packets"))


def packet_test_expansion(spark, sf):
    """The split of the fair sample widened under the packet rule: every class at just its cap."""
    kept, rest = S.capped_sample(flows(spark, sf), LEAST, CAP)
    return S.expand_test(S.stratified_split(kept).select("flow_id", "class", "split"), rest.select("flow_id", "class"), CAP, exact=True)


def ordered_distinct(spark, sf):
    """Event types of each user in the order in which they first came."""
    x = packets(spark, sf).groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("idx", "class"))).alias("s"))
    return x.select("flow", F.array_join(F.array_distinct(F.transform("s", lambda s: s["class"])), ",").alias("classes"))


def task_listing(spark, sf):
    """Parts as a catalogue of tasks (name, type as group, brand as summary): those that a prefix, a keyword and a group leave."""
    from .registry import chosen

    x = load(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("grp"), F.col("p_brand").alias("summary"), "p_partkey")
    return chosen(x, prefix="", keyword="BRAND#1", group="PROMO").select("name", "grp", "summary", "p_partkey")


SQL = {
    "directional_tuples": f"SELECT {_ip('src_ip')} AS src, {_ip('dst_ip')} AS dst, CASE WHEN proto IN (6, 17) THEN sport END AS sport, CASE WHEN proto IN (6, 17) THEN dport END AS dport, CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'IP' END AS l4, count(*) AS packets FROM ({HEADERS_SQL}) WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY ALL",
    "path_parts": f"""SELECT flow_id, class || '/' || source_tag AS parent, flow_id || '.v1.pcap' AS name, flow_id || '.v1' AS stem, '.pcap' AS suffix, sha1(path || '.v1.pcap') AS sha1, sha256(path || '.v1.pcap') AS sha256, md5(path || '.v1.pcap') AS md5 FROM ({FLOWS_SQL})""",
    "literal_values": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'x' || s_suppkey END AS a FROM supplier",
    "run_ids": """WITH n AS (SELECT doc_id, list_distinct_in_order AS codes FROM (SELECT doc_id, list_transform(range(0, doc_id % 4 + 1), lambda i: 1 + (doc_id + 3 * i) % 6) AS c,
 list_filter(list_transform(range(0, doc_id % 4 + 1), lambda i: 1 + (doc_id + 3 * i) % 6), lambda x, i: list_position(c, x) = i) AS list_distinct_in_order FROM documents))
SELECT doc_id, array_to_string(list_transform(codes, lambda k: ['reorder', 'retransmit', 'jitter_drop', 'frag_merge', 'time_scale', 'label_noise'][k]), '+') || '_' || ['light', 'medium', 'heavy'][1 + doc_id % 3] || '_' ||
 CASE WHEN doc_id % 2 = 0 THEN 'first' || (1 + doc_id % 10) ELSE 'all' END AS run FROM n""",
    "perturb_outcomes": f"""WITH p AS ({PACKETS_SQL}), s AS (SELECT * FROM p WHERE flow % 10 <> 3), {_sql_retransmit('again', 's', 0.06, 5, 42)}
SELECT (SELECT count(*) FROM again) AS ok, (SELECT count(*) FROM p WHERE flow % 10 = 3) AS failed""",
    "gold_saliency": """SELECT vec_id, round(sum(abs(cos(10 * f + ((label::BIGINT % 10) + 10) % 10))), 6) AS saliency FROM embeddings, range(64) u(f) WHERE label IS NOT NULL GROUP BY vec_id, label""",
    "packet_target_overflow": f"""WITH {_P}, {_TARGET}, t AS (SELECT class, CASE WHEN least(train, valid, test) <= 0 OR can < 100 THEN 0 ELSE least(can, 300) END AS target FROM g),
h AS (SELECT class, split, count(*) AS have, round_even(target * CASE split WHEN 'train' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END, 0) AS want FROM p JOIN t USING (class) WHERE target > 0 GROUP BY class, split, target),
ok AS (SELECT class FROM h GROUP BY class HAVING bool_and(have >= want) AND count(*) = 3)
SELECT class, (have - want)::BIGINT AS packets FROM h WHERE split = 'test' AND class IN (SELECT class FROM ok) AND have > want AND want > 0""",
    "packet_test_expansion": f"""WITH {_FAIR}, {_split('s', 'k')},
o AS MATERIALIZED (SELECT flow_id, class, row_number() OVER (PARTITION BY class ORDER BY md5('expand42|' || flow_id), flow_id) AS rk, count(*) OVER (PARTITION BY class) AS pool FROM f WHERE flow_id NOT IN (SELECT flow_id FROM k) AND class IN (SELECT class FROM f GROUP BY class HAVING count(*) >= {LEAST})),
c AS (SELECT class, count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM s GROUP BY class),
g AS (SELECT (SELECT bool_and(total = {CAP}) FROM c) AS ok, (SELECT min(pool) FROM o) AS m)
SELECT flow_id, class, split FROM s UNION ALL SELECT o.flow_id, o.class, 'test' FROM o JOIN c USING (class), g WHERE ok AND rk <= greatest(0, least(m, 10 * train - test, pool))""",
    "ordered_distinct": f"SELECT flow, string_agg(class, ',' ORDER BY first_idx) AS classes FROM (SELECT flow, class, min(idx) AS first_idx FROM ({PACKETS_SQL}) GROUP BY flow, class) GROUP BY flow",
    "task_listing": "SELECT p_name AS name, p_type AS grp, p_brand AS summary, p_partkey FROM part WHERE contains(p_type, 'PROMO') AND (contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'brand#1'))",
}
QUERIES = {
    f.__name__: f
    for f in (directional_tuples, path_parts, literal_values, run_ids, perturb_outcomes, gold_saliency, packet_target_overflow, packet_test_expansion, ordered_distinct, task_listing)
}
