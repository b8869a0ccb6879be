"""Packets by address prefixes of either kind: literal lists, tables of ranges, tables of pairs of ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import cidr, cidr_key


def _halves(key: Column) -> tuple[Column, Column]:
    """A 16-byte key as two numbers of 64 bits, of which a prefix is a bitwise and; other keys give null."""
    digits = F.when(F.octet_length(key) == 16, F.hex(key))
    word = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    return F.shiftleft(word(1), 32).bitwiseOR(word(9)), F.shiftleft(word(17), 32).bitwiseOR(word(25))


def _masks(bits: int) -> tuple[int, int]:
    """The two halves of the mask of a length, as signed numbers."""
    signed = lambda n: max(0, min(n, 64)) and -(1 << (64 - max(0, min(n, 64))))
    return signed(bits), signed(bits - 64)


def _mask_rows(lengths: list[int]) -> Column:
    """An array of structs (bits, h, l) of the lengths and their masks."""
    rows = [F.struct(F.lit(n).cast("int").alias("bits"), *(F.lit(m).cast("long").alias(c) for m, c in zip(_masks(n), ("h", "l"), strict=True))) for n in lengths]
    return F.array(*rows) if rows else F.array().cast("array<struct<bits: int, h: bigint, l: bigint>>")


def within_any(key: Column, ranges: list[str]) -> Column:
    """Whether a key lies in one of a few literal ranges; ranges that are none are passed over. The ranges are read once, by the
    driver: a row is compared with the first and the last key of each."""
    terms = []
    for first, bits in filter(None, map(cidr, ranges)):
        host = (1 << (128 - bits)) - 1
        terms.append(key.between(F.lit(first), F.lit((int.from_bytes(first, "big") | host).to_bytes(16, "big"))))
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in terms), F.lit(False))


def _longest(keys: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """Distinct keys (h, l) with the longest of the ranges (bits, h, l) that they lie in, as ``name`` (bits, h, l); others are
    dropped. Every other range of the table that holds a key holds that longest one too."""
    lengths = sorted(x["bits"] for x in ranges.select("bits").distinct().collect())
    looked = keys.select("h", "l", F.explode(_mask_rows(lengths)).alias("m"))
    looked = looked.select(F.col("h").alias("kh"), F.col("l").alias("kl"), F.col("m.bits").alias("bits"), F.col("h").bitwiseAND(F.col("m.h")).alias("h"), F.col("l").bitwiseAND(F.col("m.l")).alias("l"))
    best = looked.join(ranges.select("bits", "h", "l").distinct(), ["bits", "h", "l"]).groupBy("kh", "kl").agg(F.max(F.struct("bits", "h", "l")).alias(name))
    return best.withColumnsRenamed({"kh": "h", "kl": "l"})


def _net(c: str, out: str = "") -> list[Column]:
    h, low = _halves(F.col(f"{c}.net"))
    return [F.col(f"{c}.bits").alias(f"{out}bits"), h.alias(f"{out}h"), low.alias(f"{out}l")]


def prefix_join(packets: DataFrame, ranges: DataFrame, col: str) -> DataFrame:
    """Packets with the longest of the ranges (cidr, id) that their key ``col`` lies in: range_bits, range_id (the smallest of
    equal ranges); others are dropped.

    The lengths that occur (129 at most, which the driver reads) make an equi-join on (length, network) of each distinct
    key; no nested loop, no scan of ranges per packet.
    """
    r = ranges.select(F.col("id").alias("range_id"), cidr_key(F.col("cidr")).alias("c")).where("c IS NOT NULL").select("range_id", *_net("c")).groupBy("bits", "h", "l").agg(F.min("range_id").alias("range_id"))
    h, low = _halves(F.col(col))
    keys = packets.select(h.alias("h"), low.alias("l")).where("h IS NOT NULL").distinct()
    found = _longest(keys, r, "b").select(F.col("h").alias("__h"), F.col("l").alias("__l"), F.col("b.bits").alias("bits"), F.col("b.h").alias("h"), F.col("b.l").alias("l"))
    best = found.join(r, ["bits", "h", "l"]).select("__h", "__l", F.col("bits").alias("range_bits"), "range_id")
    return packets.withColumns({"__h": h, "__l": low}).join(best, ["__h", "__l"]).drop("__h", "__l")


def pair_join(packets: DataFrame, pairs: DataFrame, src: str, dst: str) -> DataFrame:
    """Packets with the closest of the pairs of ranges (src_cidr, dst_cidr, id) that hold both ends: src_bits, dst_bits, pair_id.

    Closest is the longest source prefix, then the longest destination prefix, then the smallest id; packets in no pair
    are dropped, and so are pairs with an end that is no range. Which pairs hold a packet depends only on the longest range of
    the table that its source lies in, and on that of its destination. So packets are brought to these two first, by
    equi-joins on (length, network); only each distinct two are looked up once for each pair of lengths that occurs (129 by
    129 at most; the driver reads them), however many packets share them.
    """
    p = pairs.select(F.col("id").alias("pair_id"), cidr_key(F.col("src_cidr")).alias("s"), cidr_key(F.col("dst_cidr")).alias("d")).where("s IS NOT NULL AND d IS NOT NULL")
    p = p.select("pair_id", *_net("s", "s"), *_net("d", "d")).groupBy("sbits", "sh", "sl", "dbits", "dh", "dl").agg(F.min("pair_id").alias("pair_id"))
    x, ends = packets, (("s", src), ("d", dst))
    for e, c in ends:
        x = x.withColumns(dict(zip((f"__{e}h", f"__{e}l"), _halves(F.col(c)), strict=True)))
    x = x.where("__sh IS NOT NULL AND __dh IS NOT NULL")
    for e, _ in ends:
        table = p.select(F.col(f"{e}bits").alias("bits"), F.col(f"{e}h").alias("h"), F.col(f"{e}l").alias("l"))
        keys = x.select(F.col(f"__{e}h").alias("h"), F.col(f"__{e}l").alias("l")).distinct()
        x = x.join(_longest(keys, table, f"__{e}").withColumnsRenamed({"h": f"__{e}h", "l": f"__{e}l"}), [f"__{e}h", f"__{e}l"])
    lengths = sorted((r["sbits"], r["dbits"]) for r in p.select("sbits", "dbits").distinct().collect())
    kinds = [F.struct(s.alias("s"), d.alias("d")) for s, d in ((_mask_rows([a])[0], _mask_rows([b])[0]) for a, b in lengths)]
    two = x.select("__s", "__d").distinct()
    looked = two.select("__s", "__d", F.explode(F.array(*kinds)).alias("k")) if kinds else two.withColumn("k", F.lit(None).cast("struct<s: struct<bits: int, h: bigint, l: bigint>, d: struct<bits: int, h: bigint, l: bigint>>"))
    looked = looked.where("k.s.bits <= __s.bits AND k.d.bits <= __d.bits")
    part = lambda e, c: F.col(f"k.{e}.bits").alias(f"{e}bits") if c == "bits" else F.col(f"__{e}.{c}").bitwiseAND(F.col(f"k.{e}.{c}")).alias(f"{e}{c}")
    looked = looked.select("__s", "__d", *(part(e, c) for e in "sd" for c in ("bits", "h", "l")))
    best = looked.join(p, ["sbits", "sh", "sl", "dbits", "dh", "dl"]).groupBy("__s", "__d").agg(F.max(F.struct("sbits", "dbits", (-F.col("pair_id")).alias("id"))).alias("b"))
    best = best.select("__s", "__d", F.col("b.sbits").alias("src_bits"), F.col("b.dbits").alias("dst_bits"), (-F.col("b.id")).alias("pair_id"))
    return x.join(best, ["__s", "__d"]).select(*packets.columns, "src_bits", "dst_bits", "pair_id")
