"""Archives: members, sizes, dates, memory, what lost tasks leave."""

import glob
import gzip
import zlib

import pytest
from pyspark.sql import functions as F
from spindrift.llm import warc
from spindrift.sources.ranges import opened


def pages(spark, n=50, size=2000):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.md5((F.col("id") % 7).cast("string")), size // 32).alias("html"))


def test_each_record_is_a_member(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark), path, records_per_file=20)
    files = glob.glob(f"{path}/*.warc.gz")
    n = 0
    for name in files:
        rest = open(name, "rb").read()
        whole = gzip.decompress(rest)
        members = []
        while rest:
            d = zlib.decompressobj(31)
            members.append(d.decompress(rest))
            rest = d.unused_data
            assert members[-1].startswith(b"WARC/1.1\r\n") and members[-1].count(b"WARC-Type: ") == 1 and members[-1].endswith(b"\r\n\r\n")
        assert b"".join(members) == whole and len(members) <= 20
        n += len(members)
    assert n == 50 and len(files) >= 3
    got = warc.read_archives(spark, path, with_html=True).collect()
    assert sorted(r["page_id"] for r in got) == list(range(50)) and sum(r["record_type"] == "response" for r in got) == 7


def test_files_are_closed_by_size_and_lost_ones_dont_count(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, 200).coalesce(1), path, min_bytes=10**6, bytes_per_file=2000)
    index = spark.read.parquet(f"{path}/index").collect()
    assert len(index) > 3 and sum(r["records"] for r in index) == 200 and all(r["bytes"] < 2500 for r in index)
    with open(f"{path}/lost-00000.warc.gz", "wb") as f:
        f.write(gzip.compress(b"WARC/1.1\r\n"))
    assert warc.read_archives(spark, path).count() == 200


def test_dates_are_given(spark, tmp_path):
    x = pages(spark, 4).withColumn("seen", F.when(F.col("page_id") > 0, F.concat(F.lit("2025-01-0"), "page_id", F.lit("T00:00:00Z"))))
    warc.write_archives(x, str(tmp_path / "w"), date=F.col("seen"))
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/w/*.gz")).decode()
    assert sorted(line.split(": ")[1] for line in text.split("\r\n") if line.startswith("WARC-Date")) == [warc.DATE, *(f"2025-01-0{k}T00:00:00Z" for k in (1, 2, 3))]


def test_other_members_and_cut_files(tmp_path):
    """Archives whose members hold several records, or parts of one, read alike; one that is cut short is an error."""
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:spindrift:page:{i}>\r\nContent-Length: {len(body) + 40}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: {len(body):03d}\r\n\r\n".encode() + body + b"\r\n\r\n"
    assert len(b"HTTP/1.1 200 OK\r\nContent-Length: 003\r\n\r\n") == 40
    text = b"".join(record(i, b"x" * i) for i in range(1, 300))
    for name, cuts in (("one", [0]), ("many", range(0, len(text), 777)), ("uneven", [0, 5, 6, 20_000])):
        with open(tmp_path / name, "wb") as f:
            for a, b in zip(cuts, [*list(cuts)[1:], len(text)]):
                f.write(gzip.compress(text[a:b]))
        w = opened(f"{tmp_path}/{name}")
        with w.file:
            assert [(r[0], r[2]) for r in warc.parse_archive(w)] == [(i, i) for i in range(1, 300)]
    with open(tmp_path / "cut", "wb") as f:
        f.write(gzip.compress(text[:-10]))
    w = opened(f"{tmp_path}/cut")
    with w.file, pytest.raises(ValueError, match="ends within"):
        list(warc.parse_archive(w))


def test_one_record_at_a_time_is_held(tmp_path):
    """Thirty payloads of 4 MB that pack well: what is inflated ahead stays small."""
    body = b"y" * (4 << 20)
    with open(tmp_path / "big", "wb") as f:
        for i in range(30):
            f.write(gzip.compress(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:spindrift:page:{i}>\r\nContent-Length: {len(body) + 44}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"))
    w = opened(f"{tmp_path}/big")
    most, more = 0, warc.Inflated.more

    def watched(self):
        nonlocal most
        most = max(most, len(self.body))
        return more(self)

    warc.Inflated.more = watched
    try:
        with w.file:
            assert sum(1 for _ in warc.parse_archive(w)) == 30
    finally:
        warc.Inflated.more = more
    assert most <= 8 * warc.CHUNK


def test_columns_of_any_name(spark, tmp_path):
    x = pages(spark, 5).withColumns({c: F.lit("clash") for c in ("refers_to", "payload", "head", "date", "r_page", "payload_digest", "payload_bytes", "n")})
    warc.write_archives(x, str(tmp_path / "w"))
    assert warc.resolve(warc.read_archives(spark, str(tmp_path / "w"))).where("resolved").count() == 5
