"""IPv4 and IPv6 addresses as 16-byte keys, prefixes of keys, and their text.

An IPv4 address has the key of its mapped IPv6 address (::ffff:a.b.c.d), so one kind of key and of prefix serves both:
a.b.c.d/n is a prefix of 96 + n bits.
"""

from __future__ import annotations

import ipaddress
import re
import socket

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binary import ipv4_number, unsigned

MAPPED = bytes(10) + b"\xff\xff"
_GROUP = "[0-9a-fA-F]{1,4}"


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row."""
    return F.transform(F.array(value), body)[0]


def ipv4_key(ip: Column) -> Column:
    """The key of an IPv4 address given as a number."""
    return F.when(ip.isNotNull(), F.concat(F.lit(MAPPED), F.unhex(F.lpad(F.hex(ip.cast("long")), 8, "0"))))


@F.arrow_udf(T.StringType())
def _text6(keys):
    import pyarrow as pa

    return pa.array([text6(k) for k in keys.to_pylist()], pa.string())


def text6(key: bytes | None) -> str | None:
    if key is None or len(key) != 16:
        return None
    if key.startswith(MAPPED):
        return f"::ffff:{socket.inet_ntoa(key[12:])}"
    text = socket.inet_ntop(socket.AF_INET6, key)
    return f"::{key[12:14].hex().lstrip('0') or '0'}:{key[14:].hex().lstrip('0') or '0'}" if "." in text else text


def ipv6_text(data: Column) -> Column:
    """16 bytes as RFC 5952 wants them: lower case, no leading zeros, the first of the longest runs of two or more zero
    groups as ::. A mapped IPv4 address is written as such; null unless there are 16 bytes."""
    return _text6(data)


def ipv6_bytes(text: Column) -> Column:
    """The 16 bytes of an IPv6 address (:: at most once, the last 32 bits may be dotted), else null."""
    mixed = r"^(.*:)(\d{1,3}(?:\.\d{1,3}){3})$"
    dotted = F.regexp_extract(text, mixed, 2)
    tail = ipv4_number(F.when(dotted != "", dotted))
    pair = F.concat(F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(65535)))
    plain = F.when(dotted == "", text).otherwise(F.concat(F.regexp_extract(text, mixed, 1), pair))

    def read(t):
        parts = F.split(t, "::", -1)
        groups = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":", -1))
        left, right = groups(parts[0]), F.when(F.size(parts) == 2, groups(F.get(parts, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        room = 8 - F.size(left) - F.size(right)
        whole = F.concat(left, F.when(F.size(parts) == 2, F.array_repeat(F.lit("0"), F.greatest(room, F.lit(0)))).otherwise(F.array().cast("array<string>")), right)
        good = (F.size(parts) <= 2) & (F.size(whole) == 8) & ((F.size(parts) == 1) | (room >= 1)) & F.forall(whole, lambda g: g.rlike(f"^{_GROUP}$"))
        return F.when(good, F.unhex(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))

    return bound(plain, lambda t: F.when(t.isNotNull() & F.contains(t, F.lit(":")), read(t)))


def address_key(text: Column) -> Column:
    """The key of an address of either kind, null if it is none."""
    return F.coalesce(ipv4_key(ipv4_number(text)), ipv6_bytes(text))


def masked(key: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a key, the others zero."""
    whole = F.floor(bits / 8).cast("int")
    rest = (bits % 8).cast("int")
    byte = unsigned(key, whole, 1)
    part = byte - byte % F.pow(F.lit(2), 8 - rest).cast("long")
    middle = F.when(rest > 0, F.unhex(F.lpad(F.hex(part), 2, "0"))).otherwise(F.lit(b""))
    return F.rpad(F.concat(F.substring(key, F.lit(1), whole), middle), 16, F.lit(bytes(1)))


def cidr(text: str | None) -> tuple[bytes, int] | None:
    """(net, bits) of an address or of address/length of either kind, host bits dropped; None if it is none."""
    head, slash, tail = (text or "").partition("/")
    tail = tail.rpartition("/")[2]
    try:
        address = ipaddress.ip_address(head)
    except ValueError:
        return None
    if "%" in head or (slash and not re.fullmatch("[0-9]{1,3}", tail)):
        return None
    size = int(tail) if slash else address.max_prefixlen
    if size > address.max_prefixlen:
        return None
    key, bits = (address.packed, size) if address.version == 6 else (MAPPED + address.packed, size + 96)
    return (int.from_bytes(key, "big") >> (128 - bits) << (128 - bits)).to_bytes(16, "big"), bits


@F.arrow_udf(T.StructType([T.StructField("net", T.BinaryType()), T.StructField("bits", T.IntegerType())]))
def _cidrs(texts):
    import pyarrow as pa

    found = [c and {"net": c[0], "bits": c[1]} for c in map(cidr, texts.to_pylist())]
    return pa.array(found, pa.struct([("net", pa.binary()), ("bits", pa.int32())]))


def cidr_key(text: Column) -> Column:
    """A struct (net, bits) of an address or of address/length of either kind, host bits dropped; null if it is none."""
    return _cidrs(text)
