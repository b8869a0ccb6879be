"""Queries over bytes: tokens, indexes, matrices, masks and captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.binary import hex_lower, slice_bytes
from ..operators import encode as E
from .lenses import PACKETS_SQL, load, packets


def _docs(spark, sf):
    return load(spark, sf, "documents").select(F.col("doc_id").alias("packet_id"), F.col("lang").alias("class"), F.encode("text", "UTF-8").alias("data"))


def _pages(spark, sf):
    """Pages as packets of a flow of ten pages: the url is the header, the html the payload."""
    p = load(spark, sf, "pages")
    return p.select(
        F.floor(F.col("page_id") / 10).cast("long").alias("flow"), F.col("page_id").alias("idx"), F.encode("url", "UTF-8").alias("header"), F.encode("html", "UTF-8").alias("payload"),
        F.encode("html", "UTF-8").alias("data"),
    )


def hex_tokens(spark, sf):
    """Sliding hex tokens of whole documents: how many, and their md5."""
    n, tokens = E.joined_tokens(F.col("data"))
    return _docs(spark, sf).select("packet_id", n.alias("n_tokens"), F.md5(tokens).alias("tokens_md5"))


def token_byte_index(spark, sf):
    """Which bytes each token of a packet's slice covers."""
    x = E.packet_tokens(_docs(spark, sf), E.START, E.SIZE)
    return E.token_index(x)


def flow_token_concat(spark, sf):
    """The tokens of a flow's packets in order, 100 a flow."""
    return E.flow_tokens(E.packet_tokens(_pages(spark, sf), 0, 40), 100)


def byte_matrix(spark, sf):
    """1600 bytes of a flow's first five packets."""
    x = E.byte_matrix(_pages(spark, sf))
    return x.select("flow", F.lower(F.hex("matrix")).alias("matrix_hex"))


def pixel_index(spark, sf):
    """Every pixel of the matrices with its place in packet and region."""
    return E.pixel_index(E.byte_matrix(_pages(spark, sf)))


def pixel_normalized(spark, sf):
    """Pixel sums of the matrices as image models take them."""
    x = E.pixel_index(E.byte_matrix(_pages(spark, sf))).groupBy("flow").agg(F.sum(E.normalized(F.col("value"))).alias("total"))
    return x.select("flow", F.round("total", 6).alias("total"))


def zeroize_bytes(spark, sf):
    """Documents with the address bytes of a packet zeroed: length and md5."""
    x = _docs(spark, sf).select("packet_id", E.zeroize(F.col("data"), [(0, 12), (26, 8), (34, 4)]).alias("z"))
    return x.select("packet_id", F.octet_length("z").cast("long").alias("size"), F.md5("z").alias("md5"))


def byte_slices(spark, sf):
    """The sliced bytes of documents, padded with zeros."""
    return _docs(spark, sf).select("packet_id", hex_lower(slice_bytes(F.col("data"), E.START, E.SIZE, True)).alias("slice_hex"))


def padded_ids(spark, sf):
    """Token ids of a small vocabulary with a class token, padded to 16."""
    vocab = F.create_map(*[F.lit(x) for i, t in enumerate(("6174", "6865", "6520", "2074")) for x in (t, i + 10)])
    x = E.packet_tokens(_docs(spark, sf), 0, 12)
    return x.select("packet_id", F.array_join(E.pad_ids(F.col("tokens"), vocab, 16, 2), " ").alias("ids"))


def labelled_documents(spark, sf):
    """Labels joined from a map that lacks a class: -1 there."""
    docs = _docs(spark, sf).select("packet_id", "class")
    return E.with_labels(docs, E.label_map(docs.where("class <> 'es'")), inner=False)


def image_records(spark, sf):
    """The record of each document's image: names, class, label (one class has none) and what its regions are."""
    d = load(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".pcap"))).alias("rel_pcap"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias("rel_png"))
    d = d.withColumn("rel_pcap", F.when(F.col("doc_id") % 4 > 0, F.col("rel_pcap")))
    classes = E.label_map(load(spark, sf, "documents").select(F.col("lang").alias("class")).where("class <> 'fr'"))
    x = E.record_envelope(d, classes)
    return x.select("doc_id", "file", "rel_pcap", "rel_png", "label", "class_name", "total_pixels", F.to_json("meta").alias("meta"))


def token_offsets(spark, sf):
    """Tokens of the flow ahead of each packet."""
    from ..operators.saliency import token_offsets as offsets

    x = packets(spark, sf).select("flow", "idx", (F.col("len") % 37).alias("token_count"))
    return offsets(x, 1)


def capture_roundtrip(spark, sf):
    """Events written as captures, one a user, read back and decoded."""
    from ..functions.paths import work_path
    from ..sources import pcap

    path = work_path(spark, "captures")
    x = packets(spark, sf).withColumn("file", F.concat(F.lit("u"), (F.col("flow") % 16).cast("string"), F.lit("/"), F.col("class"), F.lit(".pcap")))
    x = x.withColumn("src", F.lit(167772160) + F.col("flow")).withColumn("dst", F.lit(3232235520) + F.col("idx") % 65536).withColumn("sport", 1024 + F.col("flow") % 5000).withColumn("dport", F.lit(443))
    x = x.withColumn("proto", F.when(F.col("idx") % 2 == 0, 6).otherwise(17)).withColumn("payload", F.encode(F.col("class"), "UTF-8"))
    pcap.write_captures(x.withColumn("data", pcap.build_packet("src", "dst", "sport", "dport", "payload")), path)
    y = pcap.layers(pcap.read_captures(spark, path))
    return y.select("ts_us", "src", "dst", "proto", "sport", "dport", "l3_len", F.decode("payload", "UTF-8").alias("payload"))


_DOCS = "SELECT doc_id AS packet_id, lang AS class, encode(text) AS data FROM documents"
_HEX = "lower(hex(data))"


def _win(h, limit=None):
    n = f"(length({h}) - 4) // 2 + 1"
    return f"CASE WHEN length({h}) >= 4 THEN list_transform(range(0, ({n})::BIGINT), lambda i: substring({h}, i * 2 + 1, 4)) ELSE [] END"


_SLICE = "substring(lower(hex(data)), 153, 128)"
_PAGES = "SELECT page_id // 10 AS flow, page_id AS idx, lower(hex(encode(url))) AS header, lower(hex(encode(html))) AS payload FROM pages"
_MATRIX = f"""m AS MATERIALIZED (SELECT flow, rpad(string_agg(rpad(substring(header, 1, 160), 160, '0') || rpad(substring(payload, 1, 480), 480, '0'), '' ORDER BY idx), 3200, '0') AS h
FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY idx) AS r FROM ({_PAGES})) WHERE r <= 5 GROUP BY flow)"""
_PIX = f"""WITH {_MATRIX}, g AS (SELECT flow, h, g, g % 320 AS i FROM m, range(1600) u(g)),
p AS (SELECT flow, g AS global_offset, g // 40 AS row, g % 40 AS col, g // 320 AS packet_index, i // 40 AS row_in_packet, g % 40 AS col_in_row, CASE WHEN i < 80 THEN 'header' ELSE 'payload' END AS region, CASE WHEN i < 80 THEN 'Header 0–' || 80 ELSE 'Payload 0–' || 240 END AS region_label, CASE WHEN i < 80 THEN i ELSE i - 80 END AS region_offset,
 ('0x' || substring(h, g * 2 + 1, 2))::BIGINT AS value FROM g)"""
SQL = {
    "hex_tokens": f"SELECT packet_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT packet_id, {_win('h')} AS t FROM (SELECT packet_id, {_HEX} AS h FROM ({_DOCS})))",
    "token_byte_index": f"""SELECT packet_id, j - 1 AS j, token, 76 + (j - 1) AS byte_start, 76 + (j + 1) AS byte_end, 77 + (j - 1) AS byte_start_1b, 76 + (j + 1) AS byte_end_1b
FROM (SELECT packet_id, unnest(t) AS token, generate_subscripts(t, 1) AS j FROM (SELECT packet_id, {_win('h')} AS t FROM (SELECT packet_id, {_SLICE} AS h FROM ({_DOCS}))))""",
    "flow_token_concat": f"""SELECT flow, len(list_slice(t, 1, 100))::BIGINT AS n_tokens, array_to_string(list_slice(t, 1, 100), ' ') AS text_a FROM (
SELECT flow, flatten(list(t ORDER BY idx)) AS t FROM (SELECT flow, idx, {_win('h')} AS t FROM (SELECT page_id // 10 AS flow, page_id AS idx, substring(lower(hex(encode(html))), 1, 80) AS h FROM pages)) GROUP BY flow)""",
    "byte_matrix": f"WITH {_MATRIX} SELECT flow, h AS matrix_hex FROM m",
    "pixel_index": f"{_PIX} SELECT * FROM p",
    "pixel_normalized": f"{_PIX} SELECT flow, round(sum((value / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE), 6) AS total FROM p GROUP BY flow",
    "zeroize_bytes": f"""SELECT packet_id, length(h) // 2 AS size, md5(unhex(h)) AS md5 FROM (SELECT packet_id, string_agg(CASE WHEN i < 12 OR i BETWEEN 26 AND 37 THEN '00' ELSE substring(h, i * 2 + 1, 2) END, '' ORDER BY i) AS h
FROM (SELECT packet_id, {_HEX} AS h FROM ({_DOCS})), unnest(range(0, length(h) // 2)) u(i) GROUP BY packet_id)""",
    "byte_slices": f"SELECT packet_id, rpad({_SLICE}, 128, '0') AS slice_hex FROM ({_DOCS})",
    "padded_ids": f"""SELECT packet_id, array_to_string(list_slice(list_concat([2], list_transform(t, lambda x: CASE x WHEN '6174' THEN 10 WHEN '6865' THEN 11 WHEN '6520' THEN 12 WHEN '2074' THEN 13 ELSE 1 END), list_transform(range(16), lambda i: 0)), 1, 16), ' ') AS ids
FROM (SELECT packet_id, {_win('h')} AS t FROM (SELECT packet_id, substring({_HEX}, 1, 24) AS h FROM ({_DOCS})))""",
    "labelled_documents": "SELECT doc_id AS packet_id, lang AS class, CASE WHEN lang = 'es' THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN lang = 'es' THEN NULL ELSE lang END NULLS LAST) - 1 END AS label FROM documents",
    "image_records": """WITH c AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'fr'))
SELECT doc_id, doc_id || CASE WHEN doc_id % 4 > 0 THEN '.pcap' ELSE '.png' END AS file, CASE WHEN doc_id % 4 > 0 THEN lang || '/' || source || '/' || doc_id || '.pcap' END AS rel_pcap, lang || '/' || doc_id || '.png' AS rel_png, coalesce(label, -1) AS label, lang AS class_name, 1600 AS total_pixels,
'{"packets":5,"header_bytes":80,"payload_bytes":240,"matrix_rows":40,"matrix_cols":40,"region_def":{"header":{"label":"Header 0–' || 80 || '","bytes":[0,80]},"payload":{"label":"Payload 0–' || 240 || '","bytes":[0,240]}}}' AS meta FROM documents LEFT JOIN c USING (lang)""",
    "token_offsets": f"SELECT flow, idx, len % 37 AS token_count, (1 + coalesce(sum(len % 37) OVER (PARTITION BY flow ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset FROM ({PACKETS_SQL})",
    "capture_roundtrip": f"""SELECT ts_us, '10.' || (flow >> 16) % 256 || '.' || (flow >> 8) % 256 || '.' || flow % 256 AS src, '192.168.' || (idx % 65536) // 256 || '.' || idx % 256 AS dst, CASE WHEN idx % 2 = 0 THEN 6 ELSE 17 END AS proto,
1024 + flow % 5000 AS sport, 443 AS dport, length(class) + CASE WHEN idx % 2 = 0 THEN 40 ELSE 28 END AS l3_len, class AS payload FROM ({PACKETS_SQL})""",
}
QUERIES = {f.__name__: f for f in (hex_tokens, token_byte_index, flow_token_concat, byte_matrix, pixel_index, pixel_normalized, zeroize_bytes, byte_slices, padded_ids, labelled_documents, image_records, token_offsets, capture_roundtrip)}
