"""Bytes as tokens and matrices, with indexes back to the bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binary import hex_lower, slice_bytes

START, SIZE, WINDOW, STRIDE = 76, 64, 4, 2
HEADER, PAYLOAD, PACKETS, SIDE = 80, 240, 5, 40


def sliding_tokens(data: Column, window: int = WINDOW, stride: int = STRIDE, limit: int = 0) -> Column:
    """Substrings of ``window`` hex digits of binary ``data`` every ``stride`` digits; at most ``limit`` (0: all).

    Windows of whole bytes are cut from the bytes, which takes constant time each. ``data`` is bound once: a
    lambda would evaluate it again for every token.
    """
    whole = window % 2 == 0 and stride % 2 == 0

    def cut(d):
        size = F.octet_length(d) * 2 if whole else F.length(d)
        n = F.floor((size - window) / stride).cast("int") + 1
        n = F.least(n, F.lit(limit)) if limit else n
        if whole:
            piece = lambda i: F.lower(F.hex(F.substring(d, i * (stride // 2) + 1, F.lit(window // 2))))
        else:
            piece = lambda i: F.substring(d, i * stride + 1, F.lit(window))
        return F.when(size >= window, F.transform(F.sequence(F.lit(0), n - 1), piece)).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(data if whole else hex_lower(data)), cut)[0]


def joined_tokens(data: Column) -> tuple[Column, Column]:
    """How many sliding tokens of two bytes, one byte apart, binary ``data`` has, and all of them joined by blanks: one
    pass over its hex digits, without an array."""
    digits = hex_lower(data)
    every = F.regexp_replace(digits, "(?=(....))..", "$1 ")  # leaves the last byte after the last blank
    n = F.floor((F.octet_length(data) * 2 - WINDOW) / STRIDE) + 1
    return F.greatest(F.lit(0), F.coalesce(n, F.lit(0))).cast("long"), F.when(n > 0, F.regexp_replace(every, " ..$", "")).otherwise(F.lit(""))


def packet_tokens(packets: DataFrame, start: int = START, size: int = SIZE) -> DataFrame:
    """packets (flow, idx, data) with their slice's tokens."""
    return packets.withColumn("tokens", sliding_tokens(slice_bytes(F.col("data"), start, size)))


def flow_tokens(packets: DataFrame, limit: int) -> DataFrame:
    """(flow, n_tokens, text): the tokens of a flow's packets in order, cut at ``limit`` for the flow.

    A packet's tokens can matter only if fewer than ``limit`` came before, so later packets are dropped by a
    running count before tokens are gathered: a flow gathers ``limit`` tokens and a packet's at most.
    """
    w = W.partitionBy("flow").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    x = packets.withColumn("ahead", F.coalesce(F.sum(F.size("tokens")).over(w), F.lit(0))).where(F.col("ahead") < limit)
    got = x.groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("idx", "tokens"))).alias("p"))
    tokens = F.slice(F.flatten(F.transform("p", lambda p: p["tokens"])), 1, limit)
    return got.select("flow", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("text_a"))


def token_index(packets: DataFrame, start: int = START, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """One row per token of (packet_id, tokens): which bytes of the packet it covers, 0-based and 1-based."""
    x = packets.select("packet_id", F.posexplode("tokens").alias("j", "token"))
    b, e = F.floor(F.col("j") * stride / 2).cast("long") + start, F.floor((F.col("j") * stride + window) / 2).cast("long") + start
    return x.select("packet_id", F.col("j").cast("long").alias("j"), "token", b.alias("byte_start"), e.alias("byte_end"), (b + 1).alias("byte_start_1b"), e.alias("byte_end_1b"))


def label_map(df: DataFrame, by: str = "class") -> DataFrame:
    """(class, label): labels number the sorted classes from 0. One row per class."""
    return df.select(by).distinct().coalesce(1).withColumn("label", (F.row_number().over(W.orderBy(by)) - 1).cast("long"))


def with_labels(df: DataFrame, labels: DataFrame, by: str = "class", inner: bool = True) -> DataFrame:
    """The label joined by class: unknown classes are dropped, or get -1 (``inner`` false)."""
    if inner:
        return df.join(labels, by)
    return df.join(labels, by, "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))


def packet_bytes(header: Column, payload: Column) -> Column:
    """80 header bytes and 240 payload bytes, each cut and zero-padded."""
    return F.concat(slice_bytes(header, 0, HEADER, True), slice_bytes(payload, 0, PAYLOAD, True))


def byte_matrix(packets: DataFrame) -> DataFrame:
    """(flow, matrix): 1600 bytes of a flow's first five packets (flow, idx, header, payload), zero-padded."""
    first = packets.withColumn("r", F.row_number().over(W.partitionBy("flow").orderBy("idx"))).where(f"r <= {PACKETS}")
    x = first.select("flow", F.struct("r", packet_bytes(F.col("header"), F.col("payload")).alias("b")).alias("p")).groupBy("flow").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["b"]))
    return x.select("flow", F.rpad(joined, PACKETS * (HEADER + PAYLOAD), F.lit(bytes(1))).alias("matrix"))


def pixel_index(matrices: DataFrame) -> DataFrame:
    """One row per pixel: where it is in the matrix and in its packet, and its value."""
    g, inner = F.col("g"), F.col("g") % (HEADER + PAYLOAD)
    x = matrices.select("flow", "matrix", F.explode(F.sequence(F.lit(0), F.octet_length("matrix") - 1)).alias("g"))
    region = F.when(inner < HEADER, "header").otherwise("payload")
    return x.select(
        "flow", g.cast("long").alias("global_offset"), F.floor(g / SIDE).cast("long").alias("row"), (g % SIDE).cast("long").alias("col"),
        F.floor(g / (HEADER + PAYLOAD)).cast("long").alias("packet_index"), F.floor(inner / SIDE).cast("long").alias("row_in_packet"),
        (g % SIDE).cast("long").alias("col_in_row"), region.alias("region"), F.when(inner < HEADER, f"Header 0\u2013{HEADER}").otherwise(f"Payload 0\u2013{PAYLOAD}").alias("region_label"),
        F.when(inner < HEADER, inner).otherwise(inner - HEADER).cast("long").alias("region_offset"),
        F.conv(F.hex(F.substring("matrix", g + 1, F.lit(1))), 16, 10).cast("long").alias("value"),
    )


def record_envelope(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Records of images (rel_pcap, rel_png): file, rel_pcap, rel_png, label, class_name, total_pixels, meta. The class is the first part
    of the path, the label that of ``labels`` (class, label) or -1, the file that of the capture or else of the image."""
    path = F.coalesce(F.nullif("rel_pcap", F.lit("")), "rel_png")
    x = images.withColumn("file", F.substring_index(path, "/", -1)).withColumn("class_name", F.substring_index(path, "/", 1))
    x = with_labels(x, labels.select(F.col("class").alias("class_name"), "label"), "class_name", inner=False)
    region = lambda name, size: F.struct(F.lit(f"{name} 0\u2013{size}").alias("label"), F.array(F.lit(0), F.lit(size)).alias("bytes"))
    meta = F.struct(
        F.lit(PACKETS).alias("packets"), F.lit(HEADER).alias("header_bytes"), F.lit(PAYLOAD).alias("payload_bytes"), F.lit(SIDE).alias("matrix_rows"), F.lit(SIDE).alias("matrix_cols"),
        F.struct(region("Header", HEADER).alias("header"), region("Payload", PAYLOAD).alias("payload")).alias("region_def"),
    )
    rest = [c for c in images.columns if c not in ("rel_pcap", "rel_png")]
    return x.select("file", "rel_pcap", "rel_png", "label", "class_name", F.lit(SIDE * SIDE).alias("total_pixels"), meta.alias("meta"), *rest)


def normalized(value: Column) -> Column:
    """A pixel as the image models take it: (x / 255 - 0.5) / 0.5."""
    return (value / 255.0 - 0.5) / 0.5


def zeroize(data: Column, spans: list[tuple[int, int]]) -> Column:
    """``data`` with the byte ranges (offset, size) set to zero, as far as it reaches."""
    for at, size in spans:
        n = F.greatest(F.lit(0), F.least(F.lit(size), F.octet_length(data) - at))
        zeros = F.rpad(F.lit(b""), n, F.lit(bytes(1)))
        data = F.when(F.octet_length(data) > at, F.concat(F.substring(data, 1, at), zeros, F.substring(data, at + size + 1, 2147483647))).otherwise(data)
    return data


def pad_ids(tokens: Column, vocab: Column, length: int, cls: int, unknown: int = 1) -> Column:
    """[CLS] and the tokens' ids, cut or zero-padded to ``length``; ``vocab`` is a map column."""
    ids = F.concat(F.array(F.lit(cls)), F.transform(tokens, lambda t: F.coalesce(F.try_element_at(vocab, t), F.lit(unknown))))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def argmax(scores: Column) -> Column:
    """0-based index of the largest score: what softmax and argmax give, softmax being monotone."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")
