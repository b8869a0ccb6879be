"""Packet captures as a Spark data source: ``spark.read.format("pcap")`` and ``df.write.format("pcap")``.

Classic captures of either byte order, in microseconds or nanoseconds, with raw IP, Ethernet or other link types, and
pcapng captures. Captures of any size are read by byte ranges (``ranges``) where executors can open their store; in
others Spark's own binary reader opens them, each whole (2 GB at most, that reader's bound).
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import packed
from ..functions.addresses import ipv4_key, ipv6_text
from ..functions.binary import flag_names, ipv4_text
from ..functions.packed import ETHERNET, RAW

SCHEMA = "path string, idx long, ts_us long, link int, orig_len long, data binary"
#: Packets that a reader hands on at a time.
BATCH = 4096

#: First four bytes -> (byte order, sub-second units per second).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
NG = b"\x0a\x0d\x0d\x0a"


def decode(content: bytes, max_packets: int | None = None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(idx, ts_us, link, orig_len, data) of each packet. A record that the file cuts short ends the capture;
    content that is no capture has no packets."""
    if content[:4] == NG:
        found = _decode_ng(content)
    elif content[:4] in MAGIC and len(content) >= 24:
        found = _decode_classic(content)
    else:
        return
    for idx, p in enumerate(found):
        if max_packets is not None and idx >= max_packets:
            return
        yield (idx, *p)


def _decode_classic(content: bytes):
    order, units = MAGIC[content[:4]]
    link = struct.unpack_from(order + "I", content, 20)[0] & 0xFFFF
    record, at = struct.Struct(order + "IIII"), 24
    while at + 16 <= len(content):
        sec, sub, size, orig = record.unpack_from(content, at)
        if at + 16 + size > len(content):
            return
        yield sec * 10**6 + sub * 10**6 // units, link, orig, content[at + 16 : at + 16 + size]
        at += 16 + size


def _decode_ng(content: bytes):
    at, order, faces = 0, "<", []
    while at + 12 <= len(content):
        if content[at : at + 4] == NG:
            order = "<" if content[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            faces = []
        kind, size = struct.unpack_from(order + "II", content, at)
        if size < 12 or at + size > len(content):
            return
        body = content[at + 8 : at + size - 4]
        if kind == 1:
            units, p = 10**6, 8
            while p + 4 <= len(body):
                code, n = struct.unpack_from(order + "HH", body, p)
                if code == 0:
                    break
                if code == 9 and n:
                    v = body[p + 4]
                    units = 2 ** (v & 127) if v & 128 else 10**v
                p += 4 + n + -n % 4
            faces.append((struct.unpack_from(order + "H", body, 0)[0], units))
        elif kind == 6 and len(body) >= 20:
            face, high, low, caught, orig = struct.unpack_from(order + "IIIII", body, 0)
            link, units = faces[face] if face < len(faces) else (0, 10**6)
            yield (high << 32 | low) * 10**6 // units, link, orig, body[20 : 20 + caught]
        at += size


def file_header(link: int = RAW, snaplen: int = 262144) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, link)


def encode(packets, link: int = RAW, snaplen: int = 262144) -> Iterator[bytes]:
    """A classic little-endian microsecond capture, piece by piece, of (ts_us, data) rows."""
    yield file_header(link, snaplen)
    for ts, data in packets:
        yield struct.pack("<IIII", ts // 10**6, ts % 10**6, len(data), len(data)) + data


def read_captures(spark: SparkSession, path: str, max_packets: int | None = None, pattern: str = "*.{pcap,pcapng,cap}", range_bytes: int | None = None) -> DataFrame:
    """Packets of all captures under ``path``; ``max_packets`` a file stops early. A capture is cut into ranges that many
    tasks read, see ``ranges``; where only Spark reads the store, a file is one task's."""
    import pyarrow as pa

    from . import ranges

    if ranges.by_ranges(path):
        return ranges.read_ranges(ranges.capture_index(spark, path, pattern, range_bytes or ranges.RANGE), max_packets)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = decode(content, max_packets)
                while rows := list(itertools.islice(found, BATCH)):
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *columns], names=["path", "idx", "ts_us", "link", "orig_len", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def count_packets(spark: SparkSession, path: str, pattern: str = "*.{pcap,pcapng,cap}") -> DataFrame:
    """(path, packets): records of every capture, counted from their headers alone; 0 for files that are none."""
    import pyarrow as pa

    from . import ranges

    if ranges.by_ranges(path):
        return ranges.capture_index(spark, path, pattern).groupBy("path").agg(F.sum("packets").alias("packets"))

    def run(batches):
        for b in batches:
            n = [sum(1 for _ in decode(c)) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["path", "packets"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, packets long")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def store(path: str):
    """(file system, path in it) of a local path or of a URI that pyarrow opens (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit = options["path"], options.get("maxPackets")

    def partitions(self):
        from pyarrow import fs

        files, root = store(self.path)
        if files.get_file_info(root).type == fs.FileType.File:
            found = [root]
        else:
            every = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
            found = [f.path for f in every if f.path.lower().endswith((".pcap", ".pcapng", ".cap"))]
        return [_File(p) for p in sorted(found)] or [_File("")]

    def read(self, partition):
        from .ranges import Header, Window, blocks, packets_of

        if partition.value:
            file = store(self.path)[0].open_input_file(partition.value)
            w = Window(file, file.size())
            with file:
                head = Header(w.take(0, 24))
                found = packets_of(w, head) if head.good else blocks(w) if w.take(0, 4) == NG else ()
                for idx, p in enumerate(itertools.islice(found, int(self.limit) if self.limit else None)):
                    yield (partition.value, idx, *p)


class CaptureWriter(DataSourceArrowWriter):
    """One capture per value of ``file`` (rows come sorted by file and idx); a task writes whole files, batch by batch.

    With ``rollBytes``, a file's packets may come to several tasks, and each writes pieces of about so many bytes, named
    by its number and theirs: x.pcap gives x-00003-0000.pcap and so on, in order of the packets.
    """

    def __init__(self, schema, options, overwrite: bool):
        self.names, self.root, self.link = schema.names, options["path"].rstrip("/"), int(options.get("link", RAW))
        self.roll = int(options.get("rollBytes", 0))

    def write(self, batches):
        import numpy as np
        from pyspark import TaskContext

        files, root = store(self.root)
        part, name, k, out, target, written = TaskContext.get().partitionId(), None, 0, None, "", 0

        def close():
            if out is not None:
                out.close()
                files.move(target + ".part", target)  # a retried task writes the same file again

        for b in batches:
            columns = [b.column(self.names.index(c)) for c in ("data", "file", "ts_us")]
            for data, own, ts in packed.slices(*columns):
                body, bounds = packed.records(ts, data)
                for a, end in packed.runs(own):
                    if out is None or own[a].as_py() != name:
                        close()
                        name, k, out = own[a].as_py(), 0, None
                    while a < end:
                        if out is None or (self.roll and written >= self.roll):
                            close()
                            stem, dot, ending = name.rpartition(".")
                            target = f"{root}/{f'{stem}-{part:05d}-{k:04d}{dot}{ending}' if self.roll else name}"
                            files.create_dir(target.rpartition("/")[0], recursive=True)
                            out, k = files.open_output_stream(target + ".part"), k + 1
                            out.write(first := file_header(self.link))
                            written = len(first)
                        # a piece is closed with the packet that fills it
                        stop = min(end, max(a + 1, int(np.searchsorted(bounds, bounds[a] + self.roll - written)))) if self.roll else end
                        out.write(body[bounds[a] : bounds[stop]])
                        written, a = written + int(bounds[stop] - bounds[a]), stop
        close()
        return WriterCommitMessage()


class CaptureSource(DataSource):
    """``format("pcap")`` for folders and stores that pyarrow opens; ``read_captures`` reads from any that Spark does."""

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options)

    def writer(self, schema, overwrite):
        return CaptureWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def write_captures(packets: DataFrame, path: str, link: int = RAW, roll_bytes: int | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Rows (file, idx, ts_us, data) as captures under ``path``: each file whole in one task, in packet order; or, with
    ``roll_bytes``, in pieces of about that size that many tasks write, however many packets one file has.

    ``finish``, which works row by row, gives rows (file, idx, ...) their data once they are dealt out: Spark works whatever
    comes before out twice, as it takes a sample to find the ranges."""
    register(packets.sparkSession)
    rows = packets if finish else packets.select("file", "idx", "ts_us", "data")
    rows = rows.repartitionByRange("file", "idx") if roll_bytes else rows.repartition("file")
    rows = rows.sortWithinPartitions("file", "idx")
    out = (finish(rows).select("file", "idx", "ts_us", "data") if finish else rows).write.format("pcap").option("link", link)
    (out.option("rollBytes", roll_bytes) if roll_bytes else out).mode("append").save(path)


_CHAIN = T.StructType([T.StructField(c, T.LongType() if c in ("proto", "at") else T.BooleanType()) for c in ("proto", "at", "whole", "rerouted", "there")])


@F.arrow_udf(T.StructType([*(T.StructField(c, T.LongType()) for c in packed.FIELDS), T.StructField("chain", _CHAIN)]))
def _headers(data, link):
    import pyarrow as pa

    def found(data, link):
        fields, chain = packed.headers(packed.Packed(data), packed.numbers(link))
        six = pa.array(fields["ip_version"] != 6)
        parts = [packed.column(v) if v.dtype != bool else pa.array(v) for v in chain.values()]
        links = pa.StructArray.from_arrays(parts, list(chain), mask=six)
        return pa.StructArray.from_arrays([*(packed.column(v) for v in fields.values()), links], [*fields, "chain"])

    return packed.sliced(found, data, link)


def layers(packets: DataFrame) -> DataFrame:
    """Header fields of packets (link, data), read batch by batch: null where a layer isn't there. VLAN tags are skipped, and so
    are IPv6 extension headers, whose ``chain`` says more, see ``packed``; src and dst are text of either kind, src_key and
    dst_key keys of 16 bytes."""
    d = F.col("data")
    x = packets.withColumn("__h", _headers(d, F.col("link")))
    h = lambda c: F.col(f"__h.{c}").alias(c)
    first = ("l3_at", "ip_version", "ip_ihl", "chain", "proto", "l3_len", "ip_ttl", "src_ip", "dst_ip")
    x = x.withColumns({c: h(c).cast("int") if c == "l3_at" else h(c) for c in first})
    six = lambda at: F.when(F.col("ip_version") == 6, F.substring(d, (F.col("l3_at") + at + 1).cast("int"), F.lit(16)))
    x = x.withColumn("src_key", F.coalesce(ipv4_key(F.col("src_ip")), six(8))).withColumn("dst_key", F.coalesce(ipv4_key(F.col("dst_ip")), six(24)))
    x = x.withColumns({c: h(c) for c in ("l4_at", "sport", "dport", "tcp_seq", "tcp_ack", "flags", "tcp_window", "udp_len", "payload_at")}).drop("__h")
    x = x.withColumn("payload", F.when(F.col("payload_at").isNotNull(), F.substring(d, (F.col("payload_at") + 1).cast("int"), F.lit(2147483647))))
    v6 = F.col("ip_version") == 6
    text = lambda end: F.when(v6, ipv6_text(F.when(v6, F.col(f"{end}_key")))).otherwise(ipv4_text(F.col(f"{end}_ip")))
    return x.withColumn("src", text("src")).withColumn("dst", text("dst")).withColumn("flag_names", flag_names(F.col("flags")))


def build_packet(src: str, dst: str, sport: str, dport: str, payload: str, proto: str = "proto", flags: int = 0x18):
    """A raw IPv4 packet column from address numbers, ports and payload columns (checksums are left zero)."""
    n = lambda c, size: F.unhex(F.lpad(F.hex(c.cast("long")), size * 2, "0"))
    udp = F.col(proto) == 17
    body = F.octet_length(payload)
    l4 = F.when(udp, F.concat(n(F.col(sport), 2), n(F.col(dport), 2), n(body + 8, 2), n(F.lit(0), 2))).otherwise(
        F.concat(n(F.col(sport), 2), n(F.col(dport), 2), n(F.lit(0), 4), n(F.lit(0), 4), n(F.lit(0x50), 1), n(F.lit(flags), 1), n(F.lit(8192), 2), n(F.lit(0), 4))
    )
    total = 20 + F.when(udp, 8).otherwise(20) + body
    ip = F.concat(n(F.lit(0x4500), 2), n(total, 2), n(F.lit(0), 4), n(F.lit(64), 1), n(F.when(udp, 17).otherwise(6), 1), n(F.lit(0), 2), n(F.col(src), 4), n(F.col(dst), 4))
    return F.concat(ip, l4, F.col(payload))


def build_packet6(src: str, dst: str, sport: str, dport: str, payload: str, proto: str = "proto", extensions: Column | None = None, first: Column | None = None):
    """A raw IPv6 packet column from 16-byte addresses, ports and payload; ``extensions`` are the bytes of its extension
    headers, the last of which names the protocol, and ``first`` is the kind of the first one (checksums are left zero)."""
    n = lambda c, size: F.unhex(F.lpad(F.hex(c.cast("long")), size * 2, "0"))
    udp, body = F.col(proto) == 17, F.octet_length(payload)
    l4 = F.when(udp, F.concat(n(F.col(sport), 2), n(F.col(dport), 2), n(body + 8, 2), n(F.lit(0), 2))).otherwise(
        F.concat(n(F.col(sport), 2), n(F.col(dport), 2), n(F.lit(0), 8), n(F.lit(0x5018), 2), n(F.lit(8192), 2), n(F.lit(0), 4))
    )
    extra = F.coalesce(extensions, F.lit(b"")) if extensions is not None else F.lit(b"")
    kind = F.coalesce(first, F.col(proto)) if first is not None else F.col(proto)
    size = F.octet_length(extra) + F.octet_length(l4) + body
    return F.concat(F.lit(b"\x60\0\0\0"), n(size, 2), n(kind, 1), F.lit(b"\x40"), F.col(src), F.col(dst), extra, l4, F.col(payload))
