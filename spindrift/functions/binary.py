"""Expressions over packet bytes, addresses and header fields; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: TCP flag masks in the order in which names are listed.
TCP_FLAGS = (("FIN", 0x01), ("SYN", 0x02), ("RST", 0x04), ("PSH", 0x08), ("ACK", 0x10), ("URG", 0x20))


def unsigned(data: Column, offset: int | Column, size: int) -> Column:
    """A big-endian unsigned number of ``size`` bytes (7 at most) at a 0-based offset; null past the end."""
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    piece = F.substring(data, at.cast("int"), F.lit(size))
    return F.when(F.octet_length(piece) == size, F.conv(F.hex(piece), 16, 10).cast("long"))


def flag_names(flags: Column) -> Column:
    """'SYN,ACK' and so on, 'NONE' without any of the six; null flags give null."""
    names = F.concat_ws(",", *[F.when(flags.bitwiseAND(mask) != 0, name) for name, mask in TCP_FLAGS])
    return F.when(flags.isNotNull(), F.when(names == "", "NONE").otherwise(names))


def ipv4_text(ip: Column) -> Column:
    part = lambda k: F.shiftright(ip, k).bitwiseAND(255).cast("string")
    return F.when(ip.isNotNull(), F.concat_ws(".", part(24), part(16), part(8), part(0)))


def ipv4_number(text: Column) -> Column:
    """The number of a dotted address; null unless it has four octets of 0 to 255 without leading zeros."""
    ok = text.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    octets = F.split(F.when(ok, text), r"\.").cast("array<long>")
    return F.when(F.array_max(octets) <= 255, F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def clean_ip(text: Column) -> Column:
    """A valid dotted address once all but digits and dots is dropped, else null."""
    bare = F.regexp_replace(text, r"[^\d.]", "")
    return F.when(ipv4_number(bare).isNotNull(), bare)


def clean_port(text: Column) -> Column:
    """A whole number from 0 to 65535, else null."""
    n = F.when(F.trim(text).rlike(r"^[+-]?\d{1,9}$"), F.trim(text).cast("long"))
    return F.when(n.between(0, 65535), n)


def cidr_bounds(text: Column) -> tuple[Column, Column]:
    """First and last address of a.b.c.d/len (host bits allowed) or of a single address; null if invalid."""
    ip = ipv4_number(F.substring_index(text, "/", 1))
    bits = F.when(~F.contains(text, F.lit("/")), F.lit(32)).when(F.substring_index(text, "/", -1).rlike(r"^\d{1,2}$"), F.substring_index(text, "/", -1).cast("int"))
    size = F.when(bits <= 32, F.pow(F.lit(2.0), 32 - bits).cast("long"))
    low = ip - ip % size
    return low, low + size - 1


def hex_lower(data: Column) -> Column:
    return F.coalesce(F.lower(F.hex(data)), F.lit(""))


def slice_bytes(data: Column, start: int, size: int, pad: bool = False) -> Column:
    """Bytes [start, start + size), filled with zero bytes on the right if ``pad``."""
    out = F.substring(data, start + 1, size)
    return F.rpad(out, size, F.lit(bytes(1))) if pad else out
