"""Bytes of whole frames: checksums, sensitive fields, matrices; fields are located by their layers, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import packed
from ..functions.binary import slice_bytes
from ..functions.ordering import hash_key
from ..sources.pcap import ETHERNET, layers
from .encode import HEADER, PACKETS, PAYLOAD, packet_bytes


def number(value: Column | int, size: int) -> Column:
    """A big-endian number of ``size`` bytes."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("long")), size * 2, "0"))


@F.arrow_udf(T.BinaryType())
def _checksummed(data, link):
    def work(data, link):
        p = packed.Packed(data)
        packed.write_checksums(p, packed.numbers(link))
        return p.array()

    return packed.sliced(work, data, link)


def with_checksums(packets: DataFrame) -> DataFrame:
    """``packets`` (link, data) with IPv4, TCP, UDP and (over IPv6) ICMPv6 checksums worked out anew; other packets stay as
    they are. Over IPv6, so do fragments and packets that a routing header still sends elsewhere: what their checksum
    covers isn't in the packet."""
    return packets.withColumn("data", _checksummed(F.col("data"), F.col("link")))


@F.arrow_udf(T.StructType([T.StructField("at", T.LongType()), T.StructField("size", T.LongType())]))
def _server_name(data, payload_at):
    import pyarrow as pa

    def work(data, payload_at):
        at, size = packed.server_names(packed.Packed(data), packed.numbers(payload_at))
        return pa.StructArray.from_arrays([packed.column(at), packed.column(size)], ["at", "size"], mask=pa.array(at < 0))

    return packed.sliced(work, data, payload_at)


def server_name(data: Column, payload_at: Column) -> Column:
    """A struct (at, size) of the server name in a TLS client hello, null elsewhere; all extensions are looked through."""
    return _server_name(data, payload_at)


#: Sensitive fields and their bytes, in the order in which they are written.
_SIZES = {"mac_dst": 6, "mac_src": 6, "ip_id": 2, "src": 4, "dst": 4, "src6": 16, "dst6": 16, "sport": 2, "dport": 2, "seq": 4, "ack": 4}


@F.arrow_udf(T.BinaryType())
def _overwritten(data, link, fields, name):
    import numpy as np

    def work(data, link, fields, name):
        p, link = packed.Packed(data), packed.numbers(link)
        f, _ = packed.headers(p, link)
        tcp = f["proto"] == 6
        at, size = packed.server_names(p, np.where(tcp, f["payload_at"], -1))
        p.write_repeated(at, size, packed.Packed(name), 30)
        ether, l4 = np.where(link == ETHERNET, 0, -1), np.where(tcp | (f["proto"] == 17), f["l4_at"], -1)
        v4, v6, tcp = np.where(f["ip_version"] == 4, f["l3_at"], -1), np.where(f["ip_version"] == 6, f["l3_at"], -1), np.where(tcp, f["l4_at"], -1)
        starts = ((ether, 0), (ether, 6), (v4, 4), (v4, 12), (v4, 16), (v6, 8), (v6, 24), (l4, 0), (l4, 2), (tcp, 4), (tcp, 8))
        total, done = sum(_SIZES.values()), 0
        values = packed.Packed(fields).flat[: len(link) * total].reshape(-1, total)
        for (layer, n), width in zip(starts, _SIZES.values(), strict=True):
            p.write(packed.after(layer, n), values[:, done : done + width])
            done += width
        packed.write_checksums(p, link)
        return p.array()

    return packed.sliced(work, data, link, fields, name)


def _over_fields(packets: DataFrame, fill, name: Column) -> DataFrame:
    """Sensitive fields replaced by ``fill(field, size)``, hex digits: MAC addresses, addresses, IPv4 id, ports, TCP seq and ack,
    and a server name by ``name``, repeated or cut to its length so that no length changes; then checksums."""
    fields = F.unhex(F.concat(*[fill(field, size) for field, size in _SIZES.items()]))
    return packets.withColumn("data", _overwritten(F.col("data"), F.col("link"), fields, name.cast("binary")))


def zeroize_fields(packets: DataFrame) -> DataFrame:
    """Packets (link, data) with sensitive fields zero and server names 'zeroed'."""
    return _over_fields(packets, lambda _, size: F.lit("00" * size), F.lit("zeroed"))


def randomize_fields(packets: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Packets (link, data) with sensitive fields drawn by a hash of seed, ``key`` and field: MAC addresses start with
    02:00, server names become www.<100 to 999>.com."""

    def fill(field: str, size: int) -> Column:
        drawn = hash_key(f"{field}{seed}", *key)
        return F.concat(F.lit("0200"), F.substring(drawn, 1, 8)) if field.startswith("mac") else F.substring(drawn, 1, 2 * size)

    three = 100 + F.conv(F.substring(hash_key(f"name{seed}", *key), 1, 6), 16, 10).cast("long") % 900
    return _over_fields(packets, fill, F.concat(F.lit("www."), three.cast("string"), F.lit(".com")))


def ip_only(packets: DataFrame) -> DataFrame:
    """Packets (link, data) that are IPv4 or IPv6."""
    x = layers(packets.withColumn("before", F.struct(*packets.columns))).where("ip_version IN (4, 6)")
    return x.select("before.*")


def frame_matrix(packets: DataFrame) -> DataFrame:
    """(flow, matrix) of packets (flow, idx, link, data): the first five IP packets of a flow, each 80 bytes of what
    comes before its payload (with checksums worked out anew) and 240 of payload, zero-padded to 1600; flows without IP
    packets have none."""
    x = ip_only(packets).withColumn("r", F.row_number().over(W.partitionBy("flow").orderBy("idx"))).where(f"r <= {PACKETS}")
    x = layers(with_checksums(x.select("flow", "r", "link", "data")))
    head = F.when(F.col("payload_at").isNotNull(), F.substring("data", F.lit(1), F.col("payload_at").cast("int"))).otherwise(F.col("data"))
    x = x.select("flow", F.struct("r", packet_bytes(head, F.coalesce("payload", F.lit(b""))).alias("b")).alias("p"))
    x = x.groupBy("flow").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["b"]))
    return x.select("flow", slice_bytes(joined, 0, PACKETS * (HEADER + PAYLOAD), True).alias("matrix"))


def whole_matrices(matrices: DataFrame) -> DataFrame:
    """Matrices that have just as many pixels as they must."""
    return matrices.where(F.octet_length("matrix") == PACKETS * (HEADER + PAYLOAD))
