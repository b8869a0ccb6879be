"""Captures of any size read by byte ranges: one file is spread over many tasks, none of which holds more than a window.

A range starts at the first record whose header, and the headers that follow from it, are plausible. Whether that guess is
right is then proved: the record before a range's first one must end where it begins. Ranges that don't fit are
walked again from the proved place, so that no payload, however much it looks like headers, gives other packets.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pcap import BATCH, MAGIC, NG, SCHEMA, store

#: Bytes of a range, of a window that a task reads at a time, and headers that must follow plausibly from a guessed one.
RANGE, WINDOW, CHAIN = 64 << 20, 1 << 20, 12
#: A header is plausible up to this many bytes of a packet (or the capture's own limit, if that is larger).
LONGEST = 262_144
#: Packets are handed on when they hold so many bytes, if not BATCH of them before.
BATCH_BYTES = 8 << 20
#: Schemes that executors open themselves by ranges; captures in other stores come whole, through Spark's own reader.
SCHEMES = ("file", "hdfs", "s3", "gs")

INDEX = "path string, range int, lo long, hi long, start long, stop long, packets long"


class Window:
    """A file seen through a window that follows the reader; skipped bytes are not read."""

    def __init__(self, file, size: int, least: int | None = None):
        self.file, self.size, self.at, self.body, self.least = file, size, 0, b"", least

    def head(self) -> Header:
        """What the file's first bytes say, read without a window."""
        self.file.seek(0)
        return Header(self.file.read(24))

    def take(self, at: int, n: int) -> bytes:
        """Bytes [at, at + n), fewer at the end of the file."""
        if not (self.at <= at and at + n <= self.at + len(self.body)) and at < self.size:
            self.file.seek(at)
            self.at, self.body = at, self.file.read(max(n, WINDOW if self.least is None else self.least))
        return self.body[at - self.at : at - self.at + n]


class Header:
    """What a classic capture's first 24 bytes say; ``good`` is false for other files."""

    def __init__(self, head: bytes):
        self.good = len(head) == 24 and head[:4] in MAGIC
        if self.good:
            self.order, self.units = MAGIC[head[:4]]
            snaplen, link = struct.unpack_from(self.order + "II", head, 16)
            self.link, self.most = link & 0xFFFF, max(LONGEST, snaplen if snaplen < 1 << 30 else 0)
            self.record = struct.Struct(self.order + "IIII")


def plausible(body: bytes, head: Header) -> np.ndarray:
    """Offsets in ``body`` at which sixteen bytes could be a record's header."""
    n = len(body) - 15
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.zeros(n, bool)
    for k in range(4):
        words = np.frombuffer(body, head.order + "u4", (len(body) - k) // 4, k)
        if len(words) >= 4:
            sub, size, orig = words[1:-2], words[2:-1], words[3:]
            ok[k : k + 4 * len(sub) : 4] = (sub < head.units) & (size > 0) & (size <= head.most) & (orig >= size) & (orig <= max(head.most, 1 << 17))
    return np.flatnonzero(ok)


def synchronised(w: Window, head: Header, lo: int, hi: int) -> int | None:
    """The first place from ``lo`` (to ``hi``, exclusive) from which CHAIN plausible headers follow, or the file's end."""
    at = lo
    while at < hi:
        body = w.take(at, min(WINDOW, hi - at + 15))
        for k in plausible(body, head).tolist():
            if at + k >= hi:
                return None
            if chained(w.file, w.size, head, at + k):
                return at + k
        at += max(len(body) - 15, 1)
    return None


def chained(file, size: int, head: Header, at: int) -> bool:
    before = None
    for _ in range(CHAIN):
        if at == size:
            return True
        if at + 16 > size:
            return False
        file.seek(at)
        sec, sub, n, orig = head.record.unpack(file.read(16))
        if sub >= head.units or not 0 < n <= head.most or orig < n or (before is not None and abs(sec - before) > 1 << 22):
            return False
        before, at = sec, at + 16 + n
    return True


def walk(w: Window, head: Header, start: int, hi: int) -> tuple[int, int]:
    """(records that start in [start, hi), where the last of them ends); payloads are passed over. A record that the file
    cuts short isn't counted and ends the capture: whatever follows lies within it."""
    at, n, size_at = start, 0, struct.Struct(head.order + "8xI").unpack_from
    while at < hi and at + 16 <= w.size:
        body = w.take(at, max(16, min(WINDOW, hi - at + 15)))
        p, last = 0, min(len(body) - 16, hi - at - 1)
        while p <= last:
            size = size_at(body, p)[0]
            if at + p + 16 + size > w.size:
                return n, max(at + p + 16 + size, w.size)
            p, n = p + 16 + size, n + 1
        at += p
    return n, at if at >= hi or at + 16 <= w.size else w.size


def opened(path: str, need: int | None = None) -> Window:
    """A file's window; it reads ahead no further than the ``need`` bytes that are of use."""
    files, root = store(path)
    file = files.open_input_file(root)
    return Window(file, file.size(), None if need is None else min(need, WINDOW))


def _scan(rows) -> Iterator[tuple]:
    """(path, range, lo, hi, start, stop, packets) of ranges; a start of None is looked for."""
    for path, k, lo, hi, start in rows:
        w = opened(path, hi - lo + 15)
        with w.file:
            head = w.head()
            if not head.good:
                w.least = None
                n = count_blocks(w) if k == 0 and w.take(0, 4) == NG else 0
                yield path, k, lo, hi, None, None, n
                continue
            if start is None:
                start = 24 if k == 0 else synchronised(w, head, max(lo, 24), hi)
            if start is None:  # a record covers the whole range, or it has none
                yield path, k, lo, hi, None, None, 0
            else:
                n, stop = walk(w, head, start, hi)
                yield path, k, lo, hi, start, stop, n


def _scanned(ranges: DataFrame) -> DataFrame:
    import pyarrow as pa

    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        for b in batches:
            got = list(_scan(zip(*(c.to_pylist() for c in b.columns), strict=True)))
            cols = list(zip(*got, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["path", "range", "lo", "hi", "start", "stop", "packets"])

    return ranges.select("path", "range", "lo", "hi", "start").mapInArrow(run, INDEX)


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, bytes) of the captures under ``path``, listed without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"))


def by_ranges(path: str) -> bool:
    scheme = re.match(r"([a-z0-9]+):/", path)
    return scheme is None or scheme[1] in SCHEMES


def capture_index(spark: SparkSession, path: str, pattern: str = "*.{pcap,pcapng,cap}", range_bytes: int = RANGE) -> DataFrame:
    """(path, range, lo, hi, start, stop, packets, first_idx): every capture's ranges, where their records begin and end, and
    the number of the first one. Read from headers alone; the driver sees ranges that don't fit, no packets.

    Ranges without records start where the one before ends. A file that is no capture has one range of 0 packets;
    a pcapng capture is one range (its blocks are walked one after the other, also through a window).
    """
    files = listed(spark, path, pattern)
    step = F.lit(range_bytes).cast("long")
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), step)).alias("lo"))
    ranges = ranges.select("path", (F.col("lo") / step).cast("int").alias("range"), "lo", F.least(F.col("lo") + step, "bytes").alias("hi"), F.lit(None).cast("long").alias("start"))
    from ..functions.paths import work_path

    def kept(df):
        where = work_path(spark, "capture_ranges")
        df.write.parquet(where)
        return spark.read.schema(df.schema).parquet(where)

    index = kept(_scanned(ranges.repartition(spark.sparkContext.defaultParallelism * 4, "path", "range")))
    while True:
        proved = proofs(index)
        # Only the first range of a file that doesn't fit is known to be wrong; those behind it are looked at again then.
        wrong = proved.where("NOT fits").groupBy("path").agg(F.min(F.struct("range", "lo", "hi", F.col("due").alias("start"))).alias("r"))
        wrong = kept(wrong.select("path", "r.*"))
        if wrong.isEmpty():
            break
        again = _scanned(wrong)
        index = kept(index.join(wrong.select("path", "range"), ["path", "range"], "left_anti").unionByName(again))
    ahead = "coalesce(sum(packets) OVER (PARTITION BY path ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return index.withColumn("first_idx", F.expr(ahead))


def proofs(index: DataFrame) -> DataFrame:
    """``index`` with ``due``, where its ranges must start by the ranges before them, and ``fits``: a range starts there,
    or is covered by a record of an earlier one and has none itself."""
    due = F.expr("max(stop) OVER (PARTITION BY path ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    x = index.withColumn("due", due)
    covered = (F.col("packets") == 0) & (F.col("start").isNull() | (F.col("start") >= F.col("hi")))
    fits = F.when(F.col("due").isNull(), (F.col("range") == 0) | F.col("start").isNull()).when(F.col("due") >= F.col("hi"), covered).otherwise(F.coalesce(F.col("start") == F.col("due"), F.lit(False)))
    return x.withColumn("fits", fits)


def packets_of(w: Window, head: Header, start: int = 24) -> Iterator[tuple[int, int, int, bytes]]:
    """(ts_us, link, orig_len, data) of the records from ``start`` on, to the end or to a record that is cut short."""
    at = start
    while at + 16 <= w.size:
        sec, sub, size, orig = head.record.unpack(w.take(at, 16))
        if at + 16 + size > w.size:
            return
        yield sec * 10**6 + sub * 10**6 // head.units, head.link, orig, bytes(w.take(at + 16, size))
        at += 16 + size


def records_of(w: Window, head: Header, start: int, most: int):
    """``packets_of``, at most so many, a window at a time: Arrow arrays (ts_us, orig_len, data)."""
    at, size_at = start, struct.Struct(head.order + "8xI").unpack_from
    while most > 0 and at + 16 <= w.size:
        body = w.take(at, w.least or WINDOW)
        places, p, last = [], 0, len(body) - 16
        while p <= last:
            end = p + 16 + size_at(body, p)[0]
            if end > len(body):
                break
            places.append(p)
            p = end
        if not places:  # the record is longer than the window, or cut short by the file
            p = 16 + size_at(w.take(at, 16))[0]
            if at + p > w.size:
                return
            places, body = [0], w.take(at, p)
        if len(places) > most:
            p, places = places[most], places[:most]
        yield columns_of(body[:p], np.array(places), head)
        at, most = at + p, most - len(places)


def columns_of(body: bytes, places: np.ndarray, head: Header):
    """Arrow arrays (ts_us, orig_len, data) of the records that begin at ``places`` and fill ``body``."""
    import pyarrow as pa

    flat = np.frombuffer(body, np.uint8)
    at = places[:, None] + np.arange(16)
    sec, sub, size, orig = flat[at].view(head.order + "u4").astype(np.int64).T
    kept = np.ones(len(flat), bool)
    kept[at] = False
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat[kept])])
    return pa.array(sec * 10**6 + sub * 10**6 // head.units), pa.array(orig), data


def blocks(w: Window) -> Iterator[tuple[int, int, int, bytes]]:
    """(ts_us, link, orig_len, data) of a pcapng capture, block by block through the window."""
    at, order, faces = 0, "<", []
    while at + 12 <= w.size:
        head = w.take(at, 12)
        if head[:4] == NG:
            order, faces = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "II", head, 0)
        if size < 12 or at + size > w.size:
            return
        if kind == 1:
            body, units, p = w.take(at + 8, size - 12), 10**6, 8
            while p + 4 <= len(body):
                code, n = struct.unpack_from(order + "HH", body, p)
                if code == 0:
                    break
                if code == 9 and n:
                    units = 2 ** (body[p + 4] & 127) if body[p + 4] & 128 else 10 ** body[p + 4]
                p += 4 + n + -n % 4
            faces.append((struct.unpack_from(order + "H", body, 0)[0], units))
        elif kind == 6 and size >= 32:
            face, high, low, caught, orig = struct.unpack_from(order + "IIIII", w.take(at + 8, 20), 0)
            link, units = faces[face] if face < len(faces) else (0, 10**6)
            yield (high << 32 | low) * 10**6 // units, link, orig, bytes(w.take(at + 28, caught))
        at += size


def count_blocks(w: Window) -> int:
    """Packets of a pcapng capture, from the heads of its blocks alone."""
    at, order, n = 0, "<", 0
    while at + 12 <= w.size:
        head = w.take(at, 12)
        if head[:4] == NG:
            order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack_from(order + "II", head, 0)
        if size < 12 or at + size > w.size:
            return n
        n, at = n + (kind == 6 and size >= 32), at + size
    return n


def read_ranges(index: DataFrame, max_packets: int | None = None) -> DataFrame:
    """Packets of the captures of a ``capture_index``, each range by one task through a window; with ``max_packets``,
    ranges beyond a capture's first so many packets aren't opened and the last one is left early."""
    import pyarrow as pa

    names, kinds = [x.split(" ")[0] for x in SCHEMA.split(", ")], (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    left = F.col("packets") if max_packets is None else F.least("packets", F.greatest(F.lit(max_packets) - F.col("first_idx"), F.lit(0)))
    wanted = index.select("path", "start", "stop", left.cast("long").alias("n"), "first_idx").where("n > 0")

    def some(path, found, first):
        idx = first
        while True:
            rows, held = [], 0
            for p in itertools.islice(found, BATCH):
                rows.append((idx, *p))
                idx, held = idx + 1, held + len(p[3])
                if held >= BATCH_BYTES:
                    break
            if not rows:
                return
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *columns], names=names)

    def run(batches):
        for b in batches:
            for path, start, stop, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = opened(path, None if start is None else stop - start)
                with w.file:
                    if start is None:
                        yield from some(path, itertools.islice(blocks(w), n), first)
                        continue
                    head = w.head()
                    for ts, orig, data in records_of(w, head, start, n):
                        idx, link = pa.array(np.arange(first, first + len(data))), pa.repeat(pa.scalar(head.link, pa.int32()), len(data))
                        yield pa.RecordBatch.from_arrays([pa.repeat(path, len(data)), idx, ts, link, orig, data], names=names)
                        first += len(data)

    return wanted.repartition(index.sparkSession.sparkContext.defaultParallelism * 4, "path", "start").mapInArrow(run, SCHEMA)
