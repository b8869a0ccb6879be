"""Operator 10: WARC archives in which repeated payloads are revisit records."""

from __future__ import annotations

import hashlib
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pcap import store
from ..sources.ranges import opened
from .common import modest_batches, new_path, small_parts, table

_ID, _INDEX, _DATE = "<urn:spindrift:page:", "file string, records long, bytes long", "warc date"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive that are inflated at a time.
CHUNK = 1 << 16


def records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """One row per page: page_id, url, html, payload_digest, payload_bytes, refers_to.

    Only (page_id, digest) headers are shuffled by digest; among equal payloads of ``min_bytes`` or more the
    largest page_id stays the response and the rest get it in refers_to. Null html is an empty payload. Rows
    with a null page_id can be revisits but never the response others refer to; if all ids of a payload are
    null, all are responses. Repeated rows of the largest page_id are all responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"),
        F.sha1(html.cast("binary")).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"), *([F.col(_DATE)] if _DATE in pages.columns else []),
    )
    heads = base.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest")
    first = heads.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = heads.join(first, "payload_digest").where("refers_to IS NOT NULL AND NOT (page_id <=> refers_to)").distinct()
    r = revisits.select(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"), "refers_to")
    return base.join(r, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("payload_digest") == F.col("r_digest")), "left").drop("r_page", "r_digest")


class _Archives:
    """The archives that one task writes, one after the other; each record is a gzip member of its own."""

    def __init__(self, path: str, records: int, size: int):
        self.files, self.root = store(path)
        self.most, self.out, self.mark, self.made = (records, size), None, uuid.uuid4().hex[:12], []

    def add(self, record: bytes) -> None:
        if self.out is None or self.n >= self.most[0] or self.size >= self.most[1]:
            self.close()
            self.name, self.n, self.size = f"{self.mark}-{len(self.made):05d}.warc.gz", 0, 0
            self.files.create_dir(self.root, recursive=True)
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        body = pack.compress(record) + pack.flush()
        self.out.write(body)
        self.n, self.size = self.n + 1, self.size + len(body)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.made.append((self.name, self.n, self.size))
            self.out = None


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, date: str | Column = DATE, records_per_file: int = 1_000_000, bytes_per_file: int = 256 << 20) -> None:
    """Write WARC 1.1 files, each record a gzip member, closed at ``bytes_per_file`` or ``records_per_file``, and their names.

    ``date`` is the records' date as text, or a column with it (DATE where it is null). Tasks write archives under names of
    their own; path/index names those of the tasks that were committed, so what a lost task left doesn't count.
    """
    import pyarrow as pa

    when = F.coalesce(date.cast("string"), F.lit(DATE)) if isinstance(date, Column) else F.lit(date)
    recs = records(pages.withColumn(_DATE, when), min_bytes)
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: {_ID}"), own, F.lit(">\r\nWARC-Date: "), F.col(_DATE), F.lit("\r\nWARC-Target-URI: "),
        F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {_ID}"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"),
    )
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))

    def run(batches):
        out = _Archives(path, records_per_file, bytes_per_file)
        try:
            for b in small_parts(batches, "payload"):
                for first, body in zip(b.column(0), b.column(1), strict=True):
                    out.add(b"".join((first.as_py().encode(), body.as_py().encode(), b"\r\n\r\n")))
        finally:
            out.close()
        cols = list(zip(*out.made, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "records", "bytes"])

    modest_batches(pages.sparkSession)
    recs.select(F.concat(head, http).alias("head"), payload.alias("payload")).mapInArrow(run, _INDEX).write.parquet(f"{path}/index")


class Inflated:
    """The bytes of a file of gzip members, one after another, inflated as they are read."""

    def __init__(self, w):
        self.w, self.at, self.body, self.gz, self.rest = w, 0, b"", zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate some more; whether there was any."""
        while True:
            if not self.rest:
                self.rest = bytes(self.w.take(self.at, min(CHUNK, max(0, self.w.size - self.at))))
                self.at += len(self.rest)
                if not self.rest:
                    return False
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            got = self.gz.decompress(self.rest, 4 * CHUNK)
            self.rest = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if got:
                self.body += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next ``mark``, which is passed over; None at the end."""
        seen = 0
        while (k := self.body.find(mark, seen)) < 0:
            seen = max(0, len(self.body) - len(mark) + 1)
            if not self.more():
                return None
        out, self.body = self.body[:k], self.body[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.body], len(self.body)
        while have < n:
            self.body = b""
            if not self.more():
                raise ValueError("an archive ends within a record")
            parts.append(self.body)
            have += len(self.body)
        whole = b"".join(parts)
        self.body = whole[n:]
        return whole[:n]


def parse_archive(w):
    """(page_id, type, payload bytes, digest, refers_to, payload or None) of each record of one archive, however its records
    lie in gzip members; one record at a time is held."""
    number = lambda x: int(x) if (x := x[len(_ID) : -1]) else None
    stream = Inflated(w)
    while (first := stream.until(b"\r\n\r\n")) is not None:
        head = dict(x.split(": ", 1) for x in first.decode().split("\r\n")[1:])
        block = memoryview(stream.take(int(head["Content-Length"]) + 4))[:-4]
        cut = bytes(block[:4096]).index(b"\r\n\r\n") + 4
        stated = int(bytes(block[:cut]).split(b"Content-Length: ")[1].split(b"\r\n")[0])
        page, kind = number(head["WARC-Record-ID"]), head["WARC-Type"]
        if kind == "response":
            payload = block[cut:]
            yield page, kind, len(payload), hashlib.sha1(payload).hexdigest(), None, payload
        else:
            yield page, kind, stated, head["WARC-Payload-Digest"].removeprefix("sha1:"), number(head["WARC-Refers-To"]), None


def read_archives(spark: SparkSession, path: str, with_html: bool = False) -> DataFrame:
    """Read the archives that path/index names back: digests and sizes of responses are taken from the stored payload itself,
    those of revisits from the response they refer to (null when that response is missing). A task inflates and holds one
    record at a time, whatever the size of its files."""
    import pyarrow as pa

    fields = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", html string" * with_html
    names = [x.split(" ")[0] for x in fields.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names=names)

    def parse(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                w = opened(f"{path}/{name}")
                with w.file:
                    rows, held = [], 0
                    for r in parse_archive(w):
                        rows.append((*r[:5], bytes(r[5]).decode() if r[5] is not None else None) if with_html else r[:5])
                        held += with_html and r[2]
                        if len(rows) >= 1000 or held > 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                    if rows:
                        yield made(rows)

    files = spark.read.schema(_INDEX).parquet(f"{path}/index").select("file")
    return files.repartition(spark.sparkContext.defaultParallelism * 4, "file").mapInArrow(parse, fields)


def resolve(found: DataFrame) -> DataFrame:
    """Join revisit headers to their responses (headers only): ``resolved`` says that the response is there
    with the same digest; responses are resolved themselves."""
    there = found.where("record_type = 'response'").select(F.col("page_id").alias("t_page"), F.col("payload_digest").alias("t_digest")).distinct()
    return (
        found.join(there, (F.col("refers_to") == F.col("t_page")) & (F.col("payload_digest") == F.col("t_digest")), "left")
        .withColumn("resolved", (F.col("record_type") == "response") | F.col("t_page").isNotNull()).drop("t_page", "t_digest")
    )


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolve(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "resolved")


ORACLE_SQL = """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to,
       true AS resolved
FROM pages WINDOW w AS (PARTITION BY sha1(coalesce(html, '')))
"""
