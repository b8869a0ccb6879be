"""Sessions in container files: many captures in one file, each found through an index by its session.

A container is a row of complete captures, so what lies at (offset, length) is a capture of its own. The index is a Parquet
table that Spark commits with the tasks that wrote the containers; it alone says what is there. Containers that
a lost or repeated task left behind are in no index row, and ``vacuum`` deletes them.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packed
from .pcap import BATCH, RAW, file_header, store
from .ranges import WINDOW, Header, Window, columns_of, opened, records_of

INDEX = "session string, first_idx long, file string, offset long, length long, packets long, first_us long, crc32 long"
#: A container is closed when it holds so many bytes.
ROLL = 256 << 20
#: Bytes of a container whose sessions one task looks up.
STRETCH = 8 << 20


class _Containers:
    """The containers that one task writes, one after the other."""

    def __init__(self, root: str, link: int, roll: int):
        self.files, self.root = store(root)
        self.header, self.roll, self.out, self.name, self.at = file_header(link), roll, None, "", 0
        self.header_crc, self.row = zlib.crc32(self.header), None
        self.mark, self.count = uuid.uuid4().hex[:12], 0

    def add(self, session, idx, ts_us, data):
        """Write Arrow arrays of packets, sorted by (session, idx); the index rows of sessions that ended with them."""
        for data, session, idx, ts_us in packed.slices(data, session, idx, ts_us):
            body, bounds = packed.records(ts_us, data)
            runs = packed.runs(session)
            first = pa.array([a for a, _ in runs])
            kept = []  # what isn't written yet
            for (a, end), key, i, ts in zip(runs, *(c.take(first).to_pylist() for c in (session, idx, ts_us)), strict=True):
                if self.row is None or key != self.row[0]:
                    if self.row is not None:
                        yield tuple(self.row)
                    if self.out is None or self.at >= self.roll:
                        if kept:
                            self.out.write(b"".join(kept))
                        kept = []
                        self.open()
                    self.row = [key, i, self.name, self.at, 24, 0, ts, self.header_crc]
                    self.at += 24
                    kept.append(self.header)
                piece = memoryview(body[bounds[a] : bounds[end]])
                kept.append(piece)
                self.at += len(piece)
                self.row[4], self.row[5], self.row[7] = self.row[4] + len(piece), self.row[5] + end - a, zlib.crc32(piece, self.row[7])
            self.out.write(b"".join(kept))

    def open(self):
        if self.out is not None:
            self.out.close()
        self.name = f"{self.mark}-{self.count:04d}.sessions"
        self.files.create_dir(self.root, recursive=True)
        self.out, self.at, self.count = self.files.open_output_stream(f"{self.root}/{self.name}"), 0, self.count + 1

    def close(self):
        """The last session's index row, if there is one."""
        if self.out is not None:
            self.out.close()
        return [] if self.row is None else [tuple(self.row)]


def write_sessions(packets: DataFrame, path: str, link: int = RAW, roll_bytes: int = ROLL) -> None:
    """Packets (session, idx, ts_us, data) as containers and an index under ``path``.

    Sorted by (session, idx) over range partitions: a task writes many sessions into few files, and a session with a third
    of all packets is spread over many tasks, each of which writes a segment of it. Packets without a session are left out.
    """
    rows = packets.where("session IS NOT NULL").select("session", "idx", "ts_us", "data").repartitionByRange("session", "idx").sortWithinPartitions("session", "idx")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [x.split(" ")[0] for x in INDEX.split(", ")]

    def run(batches):
        out = _Containers(path, link, roll_bytes)
        told = lambda some: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names=names)
        made = (r for b in batches for r in out.add(*b.columns))
        try:
            while some := list(itertools.islice(made, BATCH)):
                yield told(some)
        finally:
            last = out.close()
        if last:
            yield told(last)

    rows.mapInArrow(run, INDEX).write.parquet(f"{path}/index")


def session_index(spark: SparkSession, path: str) -> DataFrame:
    """The index; a session of several segments has them in order of first_idx."""
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_sessions(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """(session, packet, ts_us, link, orig_len, data) of the sessions in ``keys`` (session), or of all; packet counts from 0
    within the session. Only the segments that are asked for are read; each is checked against its checksum."""
    ahead = "coalesce(sum(packets) OVER (PARTITION BY session ORDER BY first_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    wanted = session_index(spark, path)
    if keys is not None:
        wanted = wanted.join(keys.select("session").distinct(), "session", "left_semi")
    wanted = wanted.withColumn("ahead", F.expr(ahead)).select("session", "ahead", "file", "offset", "length", "crc32")
    # a task reads whole stretches of containers, so that no part of one is read by several
    wanted = wanted.repartition(spark.sparkContext.defaultParallelism * 4, F.col("file"), F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    names = ["session", "packet", "ts_us", "link", "orig_len", "data"]

    def told(sessions, ahead, counts, head, columns):
        which, total = np.repeat(np.arange(len(counts)), counts), int(np.sum(counts))
        packet = np.arange(total) + np.repeat(np.array(ahead) - np.cumsum(counts) + counts, counts)
        ts, orig, data = columns
        return pa.RecordBatch.from_arrays([pa.array(sessions, pa.string()).take(pa.array(which)), pa.array(packet), ts, pa.repeat(pa.scalar(head.link, pa.int32()), total), orig, data], names=names)

    def long(w, session, ahead, offset, length, crc):
        """The packets of a segment that is longer than a window."""
        part, got, at = _Slice(w, offset, length), 0, 0
        while piece := part.take(at, WINDOW):
            got, at = zlib.crc32(piece, got), at + len(piece)
        check(got == crc, session, offset)
        head = Header(part.take(0, 24))
        for some in records_of(part, head, 24, length):
            yield told([session], [ahead], [len(some[0])], head, some)
            ahead += len(some[0])

    def check(good, session, offset):
        if not good:
            raise ValueError(f"the segment of {session} at {offset} isn't what the index says")

    def run(batches):
        each = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for name, group in itertools.groupby(each, key=lambda r: r[2]):
            w = opened(f"{path}/{name}")
            with w.file:
                start, bodies, size, places, done = None, [], 0, [], []  # segments with the same header, side by side
                for session, ahead, _, offset, length, crc in group:
                    body = w.take(offset, length) if length <= WINDOW else b""
                    if done and (length > WINDOW or body[:24] != start or size >= WINDOW or len(places) >= BATCH):
                        yield told(*zip(*done, strict=True), head, columns_of(b"".join(bodies), np.array(places), head))
                        bodies, size, places, done = [], 0, [], []
                    if length > WINDOW:
                        yield from long(w, session, ahead, offset, length, crc)
                        continue
                    check(len(body) == length >= 24 and zlib.crc32(body) == crc, session, offset)
                    if body[:24] != start:
                        start, head = body[:24], Header(body[:24])
                        size_at = struct.Struct(head.order + "8xI").unpack_from
                    p, before = 24, len(places)
                    while p + 16 <= length and (end := p + 16 + size_at(body, p)[0]) <= length:
                        places.append(size + p - 24)
                        p = end
                    bodies.append(body[24:p])
                    size += p - 24
                    done.append((session, ahead, len(places) - before))
                if done:
                    yield told(*zip(*done, strict=True), head, columns_of(b"".join(bodies), np.array(places), head))

    return wanted.mapInArrow(run, "session string, packet long, ts_us long, link int, orig_len long, data binary")


class _Slice:
    """A part of a window's file as a file of its own."""

    def __init__(self, whole: Window, offset: int, length: int):
        self.whole, self.offset, self.size, self.least = whole, offset, length, None

    def take(self, at: int, n: int) -> bytes:
        return self.whole.take(self.offset + at, max(0, min(n, self.size - at)))


def vacuum(spark: SparkSession, path: str) -> DataFrame:
    """Delete containers that no index row names, in tasks; their names."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.sessions").load(path).select(F.substring_index("path", "/", -1).alias("file"))
    left = there.join(session_index(spark, path).select("file").distinct(), "file", "left_anti")

    def run(batches):
        files, root = store(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                files.delete_file(f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["file"])

    rows = left.mapInArrow(run, "file string").collect()  # as many as tasks that were lost
    return spark.createDataFrame([(r["file"],) for r in rows], "file string")
