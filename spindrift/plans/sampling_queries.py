"""Queries over the flows lens: manifests, caps, fair samples, splits, subsets, quotas and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators.encode import label_map
from .lenses import FLOWS_SQL, HEADERS_SQL, flows, headers, load

CAP, LEAST = 40, 10


def flow_manifest(spark, sf):
    """Every flow with its class, source, size and packets."""
    return flows(spark, sf).withColumn("level", F.lit("flow"))


def flow_validity_filter(spark, sf):
    """Flows of 2048 bytes and 3 packets or more."""
    return S.valid_flows(flows(spark, sf))


def class_min_filter(spark, sf):
    """Flows of classes (language and source) with ten flows or more."""
    x = flows(spark, sf).withColumn("class", F.concat_ws("-", "class", "source_tag"))
    return S.class_min(x, LEAST).select("flow_id", "class")


def soft_cap_per_source(spark, sf):
    """At most 20 flows of each class and source."""
    return S.soft_cap(flows(spark, sf), 10).select("flow_id", "class", "source_tag")


def maxmin_fair_sample(spark, sf):
    """A max-min fair sample of 40 flows a class over its sources."""
    return S.fair_sample(flows(spark, sf), CAP).select("flow_id", "class", "source_tag")


def fair_sample_overflow(spark, sf):
    """The flows that the fair sample left out."""
    return S.capped_sample(flows(spark, sf), LEAST, CAP)[1].select("flow_id", "class", "source_tag")


def stratified_split(spark, sf):
    """Train, valid or test for every flow, within its class."""
    return S.stratified_split(flows(spark, sf)).select("flow_id", "class", "split")


def split_stats_grouping_sets(spark, sf):
    """Counts of the split by split and class, split, class and in total."""
    return S.split_stats(S.stratified_split(flows(spark, sf)))


def test_expansion(spark, sf):
    """The split of the fair sample, with test flows added from the overflow."""
    kept, rest = S.capped_sample(flows(spark, sf), LEAST, CAP)
    return S.expand_test(S.stratified_split(kept).select("flow_id", "class", "split"), rest.select("flow_id", "class"), CAP)


def _packets(spark, sf):
    """Each flow's lines as packets, split as their flow is."""
    x = S.stratified_split(flows(spark, sf)).select("flow_id", "class", "split", F.explode(F.sequence(F.lit(1), F.col("pkts"))).alias("line"))
    return x.select("class", "split", F.concat_ws("-", "flow_id", "line").alias("packet_id"))


def _split_counts(packets):
    return packets.groupBy("class").agg(*[F.sum(F.when(F.col("split") == s, 1).otherwise(0)).alias(s) for s in S.RATIOS])


def packet_target(spark, sf):
    """How many packets each class can give in the split's ratios."""
    return S.packet_target(_split_counts(_packets(spark, sf)))


def packet_target_sample(spark, sf):
    """Packets sampled to the targets in every split."""
    p = _packets(spark, sf)
    return S.sample_to_target(p, S.packet_target(_split_counts(p), cap=300))


def packet_length_gate(spark, sf):
    """TCP and UDP packets that are long enough."""
    from ..operators.compliance import length_gate

    return length_gate(headers(spark, sf)).select("idx", "proto", "l3_len")


def low_label_subsets(spark, sf):
    """1 to 75 percent of each class, one subset a percentage."""
    return S.low_label_subsets(flows(spark, sf).select("flow_id", "class"))


def _segments(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("class"))
    return load(spark, sf, "orders").select("o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("class").agg(F.count("*").alias("n"))


def quota_largest_remainder(spark, sf):
    """Quotas of 1003 over market segments by their orders."""
    return S.quotas(_segments(spark, sf), 1003, donors=False)


def quota_with_donors(spark, sf):
    """Quotas of 10 over classes of very different sizes: those left without one take it from the largest."""
    k = F.col("o_orderkey") % 97
    name = F.when(k == 0, "a").when(k == 1, "b").when(k < 6, "c").when(k < 30, "e").otherwise("d")
    return S.quotas(load(spark, sf, "orders").groupBy(name.alias("class")).agg(F.count("*").alias("n")), 10)


def take_until_target(spark, sf):
    """Flows of each class in shuffle order until 500 packets are reached."""
    x = flows(spark, sf)
    return S.take_until(x, x.select("class").distinct().withColumn("target", F.lit(500).cast("long"))).select("flow_id", "class", "rank", "before")


def quota_merge_one(spark, sf):
    """Flows merged to quotas of 2000 packets over the classes."""
    return S.merge_to_quota(flows(spark, sf), 2000).select("flow_id", "class", "target", "written")


def quota_merge_two(spark, sf):
    """Two folders (odd and even flows) merged to quotas of their own."""
    x = flows(spark, sf)
    out = S.merge_two(x.where("flow_id % 2 = 0"), x.where("flow_id % 2 = 1"), 1500, 900)
    return out.select("folder", "flow_id", "class", "target", "written")


def label_numbers(spark, sf):
    """Labels of the sorted classes."""
    return label_map(flows(spark, sf))


def collision_safe_names(spark, sf):
    """File names that clash within their class get a hash of their path."""
    x = flows(spark, sf).withColumn("name", F.concat(F.lit("f"), (F.col("flow_id") % 50).cast("string"), F.lit(".pcap")))
    return S.safe_names(x).select("flow_id", "class", "out_name")


def exact_k_cycle(spark, sf):
    """Exactly 2500 rows of embeddings, cycled in order."""
    return S.exact_k(load(spark, sf, "embeddings").select("vec_id"), 2500, "vec_id")


_F = f"f AS MATERIALIZED ({FLOWS_SQL})"
_FAIR = f"""{_F},
t AS (SELECT *, row_number() OVER (PARTITION BY class, source_tag ORDER BY md5('42|' || flow_id), flow_id) AS turn FROM f),
k AS MATERIALIZED (SELECT * EXCLUDE g FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY turn, md5('42|' || source_tag), source_tag) AS g FROM t) WHERE g <= {CAP})"""


def _split(name: str, rows: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT *, CASE WHEN rk <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN rk <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'valid' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5('split42|' || flow_id), flow_id) AS rk, count(*) OVER (PARTITION BY class) AS n FROM {rows}))"""


_TARGET = """c AS MATERIALIZED (SELECT class, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test FROM p GROUP BY class),
g AS (SELECT *, floor(least(train / 0.8::DOUBLE, valid / 0.1::DOUBLE, test / 0.1::DOUBLE)) AS can FROM c)"""
_P = f"{_F}, {_split('s', 'f')}, p AS MATERIALIZED (SELECT class, split, flow_id || '-' || line AS packet_id FROM s, unnest(range(1, pkts + 1)) u(line))"


def _quota(rows: str, total: int, name: str = "q") -> str:
    return f"""{name} AS MATERIALIZED (SELECT class, n, (floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, class) <= {total} - sum(floor(share)) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota
FROM (SELECT class, n, n * {total} / sum(n) OVER () AS share FROM (SELECT class, n::DOUBLE AS n FROM {rows})))"""


def _take(rows: str, quota: str, name: str) -> str:
    return f"""{name} AS (SELECT *, least(pkts, target - before) AS written FROM (SELECT f.*, quota AS target,
coalesce(sum(pkts) OVER (PARTITION BY f.class ORDER BY md5('take42|' || flow_id), flow_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM {rows} f JOIN {quota} q ON q.class = f.class WHERE pkts > 0) WHERE before < target)"""


_SEG = "SELECT c_mktsegment AS class, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"

SQL = {
    "flow_manifest": f"SELECT *, 'flow' AS level FROM ({FLOWS_SQL})",
    "flow_validity_filter": f"SELECT * FROM ({FLOWS_SQL}) WHERE bytes >= 2048 AND pkts >= 3",
    "class_min_filter": f"SELECT flow_id, class FROM (SELECT flow_id, class || '-' || source_tag AS class, count(*) OVER (PARTITION BY class, source_tag) AS n FROM ({FLOWS_SQL})) WHERE n >= {LEAST}",
    "soft_cap_per_source": f"SELECT flow_id, class, source_tag FROM (SELECT *, row_number() OVER (PARTITION BY class, source_tag ORDER BY md5('42|' || flow_id), flow_id) AS r FROM ({FLOWS_SQL})) WHERE r <= 20",
    "maxmin_fair_sample": f"WITH {_FAIR} SELECT flow_id, class, source_tag FROM k",
    "fair_sample_overflow": f"WITH {_FAIR} SELECT flow_id, class, source_tag FROM f WHERE class IN (SELECT class FROM f GROUP BY class HAVING count(*) >= {LEAST}) AND flow_id NOT IN (SELECT flow_id FROM k)",
    "stratified_split": f"WITH {_F}, {_split('s', 'f')} SELECT flow_id, class, split FROM s",
    "split_stats_grouping_sets": f"WITH {_F}, {_split('s', 'f')} SELECT coalesce(split, 'ALL') AS split, coalesce(class, 'ALL') AS class, count(*) AS flows FROM s GROUP BY GROUPING SETS ((split, class), (split), (class), ())",
    "test_expansion": f"""WITH {_FAIR}, {_split('s', 'k')},
o AS MATERIALIZED (SELECT flow_id, class, row_number() OVER (PARTITION BY class ORDER BY md5('expand42|' || flow_id), flow_id) AS rk, count(*) OVER (PARTITION BY class) AS pool FROM f WHERE flow_id NOT IN (SELECT flow_id FROM k) AND class IN (SELECT class FROM f GROUP BY class HAVING count(*) >= {LEAST})),
c AS (SELECT class, count(*) AS total, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM s GROUP BY class),
g AS (SELECT (SELECT bool_and(total >= {CAP}) FROM c) AS ok, (SELECT min(pool) FROM o) AS m)
SELECT flow_id, class, split FROM s UNION ALL
SELECT o.flow_id, o.class, 'test' FROM o JOIN c USING (class), g WHERE ok AND rk <= greatest(0, least(m, 10 * train - test, pool))""",
    "packet_target": f"WITH {_P}, {_TARGET} SELECT class, train, valid, test, (CASE WHEN least(train, valid, test) <= 0 OR can < 100 THEN 0 ELSE least(can, 5000) END)::BIGINT AS target FROM g",
    "packet_target_sample": f"""WITH {_P}, {_TARGET}, t AS (SELECT class, CASE WHEN least(train, valid, test) <= 0 OR can < 100 THEN 0 ELSE least(can, 300) END AS target FROM g),
h AS (SELECT class, split, count(*) AS have, round_even(target * CASE split WHEN 'train' THEN 0.8::DOUBLE ELSE 0.1::DOUBLE END, 0) AS want FROM p JOIN t USING (class) WHERE target > 0 GROUP BY class, split, target),
ok AS (SELECT class FROM h GROUP BY class HAVING bool_and(have >= want) AND count(*) = 3)
SELECT class, split, packet_id FROM (SELECT *, row_number() OVER (PARTITION BY class, split ORDER BY md5('packets42|' || packet_id), packet_id) AS rk FROM p) JOIN h USING (class, split) WHERE class IN (SELECT class FROM ok) AND rk <= want""",
    "packet_length_gate": f"SELECT idx, proto, l3_len FROM ({HEADERS_SQL}) WHERE (proto = 6 AND l3_len >= 144) OR (proto = 17 AND l3_len >= 103)",
    "low_label_subsets": f"""SELECT flow_id, class, pct FROM (SELECT flow_id, class, pct, count(*) OVER (PARTITION BY class, pct) AS n, row_number() OVER (PARTITION BY class, pct ORDER BY md5('42|' || pct || '|' || flow_id), pct || '|' || flow_id) AS rk
FROM ({FLOWS_SQL}), unnest([1, 5, 10, 20, 50, 75]) u(pct)) WHERE rk <= greatest(1, round_even(n * pct / 100.0::DOUBLE, 0))""",
    "quota_largest_remainder": f"WITH {_quota(f'({_SEG})', 1003)} SELECT class, n::BIGINT AS n, quota FROM q",
    "quota_with_donors": f"""WITH RECURSIVE o AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'a' WHEN o_orderkey % 97 = 1 THEN 'b' WHEN o_orderkey % 97 < 6 THEN 'c' WHEN o_orderkey % 97 < 30 THEN 'e' ELSE 'd' END AS class, count(*) AS n FROM orders GROUP BY 1),
{_quota('o', 10)}, z AS (SELECT class AS poor, row_number() OVER (ORDER BY class) AS k FROM q WHERE quota = 0 AND n > 0),
s(i, l) AS (SELECT 0::BIGINT, list({{'q': quota, 'c': class, 'n': n::BIGINT}} ORDER BY class) FROM q UNION ALL
 SELECT i + 1, CASE WHEN rich IS NULL THEN l ELSE list_transform(l, lambda x: {{'q': CASE WHEN x.c = poor THEN 1 WHEN x.c = rich THEN x.q - 1 ELSE x.q END, 'c': x.c, 'n': x.n}}) END
 FROM (SELECT i, l, poor, list_reverse_sort(list_filter(l, lambda x: x.q > 1))[1].c AS rich FROM s JOIN z ON z.k = s.i + 1))
SELECT x.c AS class, x.n AS n, x.q AS quota FROM (SELECT unnest(l) AS x FROM s WHERE i = (SELECT max(i) FROM s))""",
    "take_until_target": f"""SELECT flow_id, class, rank, before FROM (SELECT flow_id, class, row_number() OVER w AS rank, coalesce(sum(pkts) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM ({FLOWS_SQL}) WHERE pkts > 0 WINDOW w AS (PARTITION BY class ORDER BY md5('take42|' || flow_id), flow_id)) WHERE before < 500""",
    "quota_merge_one": f"WITH {_F}, {_quota('(SELECT class, sum(pkts) AS n FROM f GROUP BY class)', 2000)}, {_take('f', 'q', 't')} SELECT flow_id, class, target, written FROM t",
    "quota_merge_two": f"""WITH {_F}, a AS (SELECT * FROM f WHERE flow_id % 2 = 0 AND class IN (SELECT class FROM f WHERE flow_id % 2 = 1)), b AS (SELECT * FROM f WHERE flow_id % 2 = 1 AND class IN (SELECT class FROM f WHERE flow_id % 2 = 0)),
{_quota('(SELECT class, sum(pkts) AS n FROM a GROUP BY class)', 1500, 'qa')}, {_quota('(SELECT class, sum(pkts) AS n FROM b GROUP BY class)', 900, 'qb')}, {_take('a', 'qa', 'ta')}, {_take('b', 'qb', 'tb')}
SELECT 1 AS folder, flow_id, class, target, written FROM ta UNION ALL SELECT 2, flow_id, class, target, written FROM tb""",
    "label_numbers": f"SELECT class, row_number() OVER (ORDER BY class) - 1 AS label FROM (SELECT DISTINCT class FROM ({FLOWS_SQL}))",
    "collision_safe_names": f"""SELECT flow_id, class, CASE WHEN row_number() OVER (PARTITION BY class, flow_id % 50 ORDER BY path) > 1 THEN 'f' || flow_id % 50 || '_h' || substr(sha1(path), 1, 8) || '.pcap' ELSE 'f' || flow_id % 50 || '.pcap' END AS out_name FROM ({FLOWS_SQL})""",
    "exact_k_cycle": "SELECT vec_id, cycle FROM (SELECT vec_id, cycle, row_number() OVER (ORDER BY cycle, vec_id) AS r FROM embeddings, range(2500) u(cycle)) WHERE r <= 2500",
}
QUERIES = {
    f.__name__: f
    for f in (
        flow_manifest, flow_validity_filter, class_min_filter, soft_cap_per_source, maxmin_fair_sample, fair_sample_overflow, stratified_split, split_stats_grouping_sets,
        test_expansion, packet_target, packet_target_sample, packet_length_gate, low_label_subsets, quota_largest_remainder, quota_with_donors, take_until_target,
        quota_merge_one, quota_merge_two, label_numbers, collision_safe_names, exact_k_cycle,
    )
}
