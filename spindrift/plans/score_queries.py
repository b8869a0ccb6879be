"""Queries over scores, labels and generated JSON: saliency, accuracy, pairs, coercion, clocks and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genjson as G
from ..operators import saliency as A
from ..operators import scoring as R
from ..operators.encode import argmax
from .lenses import FLOWS_SQL, HEADERS_SQL, SCORES_SQL, flows, headers, load, scores, turns


def byte_saliency(spark, sf):
    """Token scores summed onto the bytes that they cover."""
    return A.byte_scores(scores(spark, sf)).withColumn("score", F.round("score", 6))


def byte_saliency_max(spark, sf):
    """The same with the largest token score of each byte."""
    return A.byte_scores(scores(spark, sf), "max").withColumn("score", F.round("score", 6))


def class_mean_saliency(spark, sf):
    """Mean byte saliency over all samples and over each class's."""
    b = A.sample_bytes(A.byte_scores(scores(spark, sf)))
    samples = load(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("string").alias("class"))
    return A.mean_saliency(b, samples).withColumn("mean", F.round("mean", 6))


def saliency_grid(spark, sf):
    """A dense grid of four packets by twelve bytes of every sample."""
    return A.grid(A.byte_scores(scores(spark, sf)), 4, 12).withColumn("score", F.round("score", 6))


def grid_vmax_p99(spark, sf):
    """The 0.99 quantile of every sample's grid."""
    return A.colour_cap(A.grid(A.byte_scores(scores(spark, sf)), 4, 12)).withColumn("vmax", F.round("vmax", 6))


def pixel_saliency(spark, sf):
    """Pixel scores summed by packet byte."""
    x = load(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("string").alias("class"), F.posexplode("embedding").alias("g", "x"))
    x = x.select("sample", "class", (F.col("g") * 25).alias("g"), F.abs(F.col("x").cast("double")).alias("score"))
    return A.pixel_scores(x).withColumn("score", F.round("score", 6))


def token_score_join(spark, sf):
    """Index rows joined to score arrays by position."""
    s = load(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.col("embedding").alias("scores"))
    index = s.where("size(scores) > 0").withColumn("g", F.explode(F.sequence(F.lit(0), F.size("scores") - 1))).select("sample", F.col("g").cast("long").alias("g"))
    return A.token_scores(index, s).select("sample", "g", F.round(F.col("score").cast("double"), 6).alias("score"))


def softmax_argmax(spark, sf):
    """The class with the largest of a vector's values."""
    return load(spark, sf, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("pred"))


def accuracy(spark, sf):
    """Accuracy of that prediction against the label."""
    x = load(spark, sf, "embeddings").select(F.col("label").cast("long").alias("gold"), argmax(F.col("embedding")).alias("pred"))
    return R.accuracy(x, "gold", "pred").withColumn("accuracy", F.round("accuracy", 8))


def linear_scores(spark, sf):
    """Predictions and saliency sums of a linear scorer over all embeddings."""
    import numpy as np

    w = np.cos(np.arange(640, dtype=np.float64)).reshape(64, 10)
    x = load(spark, sf, "embeddings")
    out = R.apply_scorer(x, R.LinearScorer(w, np.zeros(10)), "embedding", "vec_id")
    return out.select("vec_id", "pred", F.round(F.aggregate("saliency", F.lit(0.0), lambda a, b: a + b), 6).alias("saliency"))


def timed_scoring(spark, sf):
    """The same scorer in timed passes that read and score at once: rows a run, and whether the times add up."""
    import numpy as np

    x = load(spark, sf, "embeddings")
    scorer = R.LinearScorer(np.cos(np.arange(640, dtype=np.float64)).reshape(64, 10), np.zeros(10))
    t = R.observed_benchmark(x, scorer, "embedding", "vec_id", R.BenchConfig(warmup_passes=1, runs=2))
    tasks = spark.sparkContext.defaultParallelism
    return t.select(F.col("run").cast("long").alias("run"), "flows", ((F.col("prep_s") + F.col("infer_s")) <= F.col("total_s") * tasks).alias("adds_up"))


def class_colour_caps(spark, sf):
    """The exact 0.99 quantile of all byte scores of each class, and of all."""
    x = A.colour_caps(A.byte_scores(scores(spark, sf)))
    return x.withColumn("vmax", F.round("vmax", 6))


def timing_summary(spark, sf):
    """Means over timed runs (an order a run: its price stands for seconds)."""
    x = load(spark, sf, "orders").select(F.col("o_totalprice").alias("total_s"), (F.col("o_totalprice") / 4).alias("prep_s"), (F.col("o_totalprice") * 0.75).alias("infer_s"), F.lit(1000).cast("long").alias("flows"))
    t = R.timing_summary(x)
    return t.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c) for c, k in t.dtypes])


def distinct_labels(spark, sf):
    """How many labels there are."""
    return load(spark, sf, "embeddings").agg(F.count_distinct("label").alias("labels"))


def zip_header_payload(spark, sf):
    """User and assistant turns of a conversation paired by position."""
    h, p = (G.positions(turns(spark, sf, r), "key", "turn").select("key", "pos", "value") for r in ("user", "assistant"))
    return G.zip_pairs(h, p).select("key", "pos", F.md5("header").alias("header_md5"), F.md5("payload").alias("payload_md5"))


def _dirty(spark, sf):
    """Header rows as generated text: some addresses and ports with noise, some invalid."""
    from ..functions.binary import ipv4_text

    h = headers(spark, sf)
    dirt = lambda c, n: F.when(F.col("idx") % n == 0, F.concat(F.lit("a "), c, F.lit("x"))).when(F.col("idx") % n == 1, F.concat(c, F.lit(".7"))).when(F.col("idx") % n == 2, F.concat(F.lit("0"), c)).otherwise(c)
    port = lambda c, n: F.when(F.col("idx") % n == 0, F.concat(F.lit(" "), F.col(c).cast("string"))).when(F.col("idx") % n == 1, F.concat(F.col(c).cast("string"), F.lit(".0"))).when(F.col("idx") % n == 2, "70000").otherwise(F.col(c).cast("string"))
    proto = F.when(F.col("idx") % 5 == 0, "udp").otherwise(F.col("proto").cast("string"))
    return h.select("idx", "flow", dirt(ipv4_text(F.col("src_ip")), 11).alias("src"), dirt(ipv4_text(F.col("dst_ip")), 13).alias("dst"), port("sport", 7).alias("sport"), port("dport", 17).alias("dport"), proto.alias("proto"))


def clean_ip_port(spark, sf):
    """Addresses, ports and protocols cleaned or found invalid."""
    return G.checked_headers(_dirty(spark, sf)).select("idx", "c_src", "c_dst", "c_sport", "c_dport", "c_proto", "l4")


def error_classes(spark, sf):
    """Header rows by outcome."""
    return G.error_counts(G.checked_headers(_dirty(spark, sf)))


def synthetic_clock(spark, sf):
    """Times of the valid header rows of each flow, a millisecond apart."""
    return G.clock(G.checked_headers(_dirty(spark, sf)), "flow", "idx", 1700000000.0, 0.001, "error IS NULL").select("flow", "idx", "time")


def payload_coercion(spark, sf):
    """Bytes of payloads that come as JSON objects, hex text, plain text or nothing."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    item = F.when(F.col("turn") % 5 == 0, F.to_json(F.struct(F.md5("text").alias("data"))))
    item = item.when(F.col("turn") % 5 == 1, F.concat(F.lit(" 0x"), F.md5("text"))).when(F.col("turn") % 5 == 2, F.concat(F.lit("12:"), F.col("conv_id").cast("string")))
    item = item.when(F.col("turn") % 5 == 3, F.col("text"))
    return c.select("conv_id", "turn", F.lower(F.hex(G.payload_bytes(item))).alias("payload_hex"))


def merged_lists(spark, sf):
    """Turn lists of a conversation's roles joined in order of role."""
    c = load(spark, sf, "conversations")
    lists = c.groupBy("conv_id", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))), lambda x: x["m"]).alias("items"))
    out = G.merge_lists(lists.select(F.col("conv_id").alias("key"), F.col("role").alias("file"), "items"))
    return out.select("key", F.array_join("items", ",").alias("items"))


def class_intersection(spark, sf):
    """Sources that both of two thirds of the flows have."""
    x = flows(spark, sf)
    return x.where("flow_id % 3 = 0").select("source_tag").intersect(x.where("flow_id % 3 = 1").select("source_tag"))


def class_difference(spark, sf):
    """Flow ids of valid flows without those of the largest source."""
    x = flows(spark, sf)
    largest = x.groupBy("source_tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_tag").limit(1)
    return x.where("pkts >= 3").select("flow_id").exceptAll(x.join(F.broadcast(largest), "source_tag", "left_semi").select("flow_id"))


def tagged_union(spark, sf):
    """Splits put together again with their tag."""
    x = flows(spark, sf)
    parts = [x.where(f"flow_id % 3 = {k}").select("flow_id", F.lit(t).alias("split")) for k, t in enumerate(("train", "valid", "test"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def packets_per_capture(spark, sf):
    """Packets of each class and source, captures without valid packets counting 0."""
    x = flows(spark, sf)
    counts = x.where("bytes >= 2048").groupBy("class", "source_tag").agg(F.sum("pkts").alias("n"))
    every = x.select("class", "source_tag").distinct()
    return every.join(counts, ["class", "source_tag"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_sources(spark, sf):
    """The five sources with the most packets."""
    return flows(spark, sf).groupBy("source_tag").agg(F.sum("pkts").alias("packets")).orderBy(F.desc("packets"), "source_tag").limit(5)


_B = f"""t AS MATERIALIZED ({SCORES_SQL}), b AS MATERIALIZED (SELECT sample, class, packet, byte, sum(score) AS score, max(score) AS top FROM t, unnest(range(byte_start, byte_end)) u(byte) GROUP BY ALL)"""
_GRID = f"""WITH {_B}, o AS (SELECT sample, min(byte) AS o FROM b GROUP BY sample), c AS (SELECT sample, p AS packet, o + k AS byte FROM o, range(4) u(p), range(12) v(k)),
g AS MATERIALIZED (SELECT c.sample, c.packet, c.byte, coalesce(b.score, 0.0) AS score FROM c LEFT JOIN b ON b.sample = c.sample AND b.packet = c.packet AND b.byte = c.byte)"""
_ADDR = "concat_ws('.', ({c} >> 24) & 255, ({c} >> 16) & 255, ({c} >> 8) & 255, {c} & 255)"


def _dirt(c, n):
    a = _ADDR.format(c=c)
    return f"CASE idx % {n} WHEN 0 THEN 'a ' || {a} || 'x' WHEN 1 THEN {a} || '.7' WHEN 2 THEN '0' || {a} ELSE {a} END"


def _port(c, n):
    return f"CASE idx % {n} WHEN 0 THEN ' ' || {c} WHEN 1 THEN {c} || '.0' WHEN 2 THEN '70000' ELSE {c}::VARCHAR END"


def _clean(c):
    bare = f"regexp_replace({c}, '[^0-9.]', '', 'g')"
    ok = f"regexp_full_match({bare}, '(0|[1-9][0-9]{{0,2}})([.](0|[1-9][0-9]{{0,2}})){{3}}') AND list_max(list_transform(string_split({bare}, '.'), lambda x: TRY_CAST(x AS INT))) <= 255"
    return f"CASE WHEN {ok} THEN {bare} END"


_CHK = f"""d AS (SELECT idx, flow, {_dirt('src_ip', 11)} AS src, {_dirt('dst_ip', 13)} AS dst, {_port('sport', 7)} AS sport, {_port('dport', 17)} AS dport, CASE WHEN idx % 5 = 0 THEN 'udp' ELSE proto::VARCHAR END AS proto FROM ({HEADERS_SQL})),
k AS MATERIALIZED (SELECT idx, flow, {_clean('src')} AS c_src, {_clean('dst')} AS c_dst,
 CASE WHEN regexp_full_match(trim(sport), '[0-9]+') AND trim(sport)::BIGINT <= 65535 THEN trim(sport)::BIGINT END AS c_sport, CASE WHEN regexp_full_match(trim(dport), '[0-9]+') AND trim(dport)::BIGINT <= 65535 THEN trim(dport)::BIGINT END AS c_dport,
 CASE WHEN regexp_full_match(proto, '[0-9]+') THEN proto::BIGINT ELSE 6 END AS c_proto FROM d),
e AS (SELECT *, CASE WHEN c_proto = 17 THEN 'udp' ELSE 'tcp' END AS l4, CASE WHEN c_src IS NULL OR c_dst IS NULL THEN 'INVALID_IP' WHEN c_sport IS NULL OR c_dport IS NULL THEN 'INVALID_PORT' END AS error FROM k)"""
_PRED = "list_position(embedding, list_max(embedding)) - 1"
SQL = {
    "byte_saliency": f"WITH {_B} SELECT sample, class, packet, byte, round(score, 6) AS score FROM b",
    "byte_saliency_max": f"WITH {_B} SELECT sample, class, packet, byte, round(top, 6) AS score FROM b",
    "class_mean_saliency": f"""WITH {_B}, n AS (SELECT label::VARCHAR AS class, count(*) AS n FROM embeddings GROUP BY 1)
SELECT class, byte, round(sum(score) / any_value(n.n), 6) AS mean FROM b JOIN n USING (class) GROUP BY class, byte UNION ALL SELECT 'ALL', byte, round(sum(score) / (SELECT count(*) FROM embeddings), 6) FROM b GROUP BY byte""",
    "saliency_grid": f"{_GRID} SELECT sample, packet, byte, round(score, 6) AS score FROM g",
    "grid_vmax_p99": f"{_GRID} SELECT sample, round(CASE WHEN max(score) > 0 THEN quantile_cont(score, 0.99) END, 6) AS vmax FROM g GROUP BY sample",
    "pixel_saliency": "SELECT vec_id AS sample, label::VARCHAR AS class, (g - 1) * 25 // 320 AS packet, (g - 1) * 25 % 320 AS byte, round(sum(abs(x::DOUBLE)), 6) AS score FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS g FROM embeddings) GROUP BY ALL",
    "token_score_join": "SELECT vec_id AS sample, g, round(embedding[g + 2]::DOUBLE, 6) AS score FROM embeddings, unnest(range(0, len(embedding))) u(g) WHERE g + 2 <= len(embedding)",
    "softmax_argmax": f"SELECT vec_id, {_PRED} AS pred FROM embeddings",
    "accuracy": f"SELECT count(*) AS rows, count(*) FILTER ({_PRED} = label) AS correct, round(count(*) FILTER ({_PRED} = label) / count(*), 8) AS accuracy FROM embeddings",
    "linear_scores": """WITH w AS MATERIALIZED (SELECT f, c, cos(10 * f + c) AS w FROM range(64) a(f), range(10) b(c)), e AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings),
s AS (SELECT vec_id, c, sum(coalesce(embedding[f + 1], 0)::DOUBLE * w) AS score FROM e, w GROUP BY vec_id, c), p AS (SELECT vec_id, arg_max(c, score) AS pred FROM s GROUP BY vec_id)
SELECT vec_id, pred, round(t, 6) AS saliency FROM p JOIN (SELECT c, sum(abs(w)) AS t FROM w GROUP BY c) ON c = pred""",
    "timed_scoring": "SELECT run, count(*) AS flows, true AS adds_up FROM embeddings, range(2) u(run) GROUP BY run",
    "class_colour_caps": f"""WITH {_B}, x AS (SELECT class, score FROM b UNION ALL SELECT 'ALL', score FROM b) SELECT class, round(CASE WHEN max(score) > 0 THEN quantile_cont(score, 0.99) END, 6) AS vmax FROM x GROUP BY class""",
    "timing_summary": "SELECT round(avg(o_totalprice), 4) AS total_s, round(avg(o_totalprice / 4), 4) AS prep_s, round(avg(o_totalprice * 0.75::DOUBLE), 4) AS infer_s, 1000 AS flows, round(avg(o_totalprice) / 1000 * 1000, 4) AS ms_per_flow, round(1000 / avg(o_totalprice), 4) AS flows_per_sec FROM orders",
    "distinct_labels": "SELECT count(DISTINCT label) AS labels FROM embeddings",
    "zip_header_payload": """WITH c AS (SELECT conv_id AS key, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos FROM conversations)
SELECT h.key, h.pos, md5(h.text) AS header_md5, md5(p.text) AS payload_md5 FROM c h JOIN c p ON h.key = p.key AND h.pos = p.pos WHERE h.role = 'user' AND p.role = 'assistant'""",
    "clean_ip_port": f"WITH {_CHK} SELECT idx, c_src, c_dst, c_sport, c_dport, c_proto, l4 FROM e",
    "error_classes": f"WITH {_CHK} SELECT coalesce(error, 'OK') AS outcome, count(*) AS rows FROM e GROUP BY 1",
    "synthetic_clock": f"WITH {_CHK} SELECT flow, idx, round(1700000000.0::DOUBLE + 0.001::DOUBLE * (row_number() OVER (PARTITION BY flow ORDER BY idx) - 1), 6) AS time FROM e WHERE error IS NULL",
    "payload_coercion": """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN md5(text) WHEN 1 THEN md5(text) WHEN 2 THEN CASE WHEN length('12' || conv_id) % 2 = 0 THEN '12' || conv_id ELSE lower(hex(encode('12:' || conv_id))) END
WHEN 3 THEN CASE WHEN regexp_full_match(b, '[0-9a-fA-F]*') AND length(b) % 2 = 0 THEN lower(b) ELSE lower(hex(encode(text))) END ELSE '' END AS payload_hex FROM (SELECT *, replace(replace(replace(trim(text), ' ', ''), ':', ''), '0x', '') AS b FROM conversations)""",
    "merged_lists": "SELECT conv_id AS key, string_agg(md5(text), ',' ORDER BY role, turn, md5(text)) AS items FROM conversations GROUP BY conv_id",
    "class_intersection": f"SELECT source_tag FROM ({FLOWS_SQL}) WHERE flow_id % 3 = 0 INTERSECT SELECT source_tag FROM ({FLOWS_SQL}) WHERE flow_id % 3 = 1",
    "class_difference": f"SELECT flow_id FROM ({FLOWS_SQL}) WHERE pkts >= 3 EXCEPT ALL SELECT flow_id FROM ({FLOWS_SQL}) WHERE source_tag = (SELECT source_tag FROM ({FLOWS_SQL}) GROUP BY source_tag ORDER BY count(*) DESC, source_tag LIMIT 1)",
    "tagged_union": "SELECT doc_id AS flow_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM documents",
    "packets_per_capture": f"SELECT class, source_tag, coalesce(sum(pkts) FILTER (bytes >= 2048), 0)::BIGINT AS n FROM ({FLOWS_SQL}) GROUP BY ALL",
    "top_sources": f"SELECT source_tag, sum(pkts)::BIGINT AS packets FROM ({FLOWS_SQL}) GROUP BY 1 ORDER BY packets DESC, source_tag LIMIT 5",
}
QUERIES = {
    f.__name__: f
    for f in (
        byte_saliency, byte_saliency_max, class_mean_saliency, saliency_grid, grid_vmax_p99, pixel_saliency, token_score_join, softmax_argmax, accuracy, linear_scores, timed_scoring, class_colour_caps, timing_summary,
        distinct_labels, zip_header_payload, clean_ip_port, error_classes, synthetic_clock, payload_coercion, merged_lists, class_intersection, class_difference, tagged_union,
        packets_per_capture, top_sources,
    )
}
