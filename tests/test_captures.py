"""Captures by ranges, in rolled pieces and as sessions in containers."""

import glob
import os
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from spindrift.functions import packed
from spindrift.sources import containers, pcap, ranges

MAGICS = {("<", 10**6): b"\xd4\xc3\xb2\xa1", (">", 10**6): b"\xa1\xb2\xc3\xd4", ("<", 10**9): b"\x4d\x3c\xb2\xa1", (">", 10**9): b"\xa1\xb2\x3c\x4d"}


def capture(packets, order="<", units=10**6, link=1):
    out = MAGICS[order, units] + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link)
    for ts, data in packets:
        out += struct.pack(order + "IIII", ts // 10**6, ts % 10**6 * (units // 10**6), len(data), len(data)) + data
    return out


def random_packets(n, seed=1, largest=900):
    rnd = random.Random(seed)
    return [(10**15 + i * 1000, rnd.randbytes(rnd.choice([1, 40, 60, rnd.randint(1, largest)]))) for i in range(n)]


def rows(df):
    return sorted((r["path"].rpartition("/")[2], r["idx"], r["ts_us"], r["link"], r["orig_len"], bytes(r["data"])) for r in df.collect())


def want(name, content):
    return [(name, *p) for p in pcap.decode(content)]


@pytest.fixture
def captures(tmp_path):
    fake = struct.pack("<IIII", 10**9, 5, 24, 24) + bytes(24)
    files = {
        "plain.pcap": capture(random_packets(700)),
        "big_endian.pcap": capture(random_packets(300, 2), ">"),
        "nano.cap": capture(random_packets(300, 3), "<", 10**9, 101),
        # a payload that looks like forty records of its own, again and again
        "looks_like_records.pcap": capture([(10**15 + i, fake * 40 + b"x" * (i % 7)) for i in range(40)]),
        "zeros.pcap": capture([(10**15 + i, bytes(5000)) for i in range(40)]),
        "one_large.pcap": capture([(10**15, b"a" * 200_000), (10**15 + 1, b"b")]),
        "cut.pcap": capture(random_packets(200, 4))[:-3],
        "cut_far_ahead.pcap": capture(random_packets(50, 5)) + struct.pack("<IIII", 10**9, 0, 10**6, 10**6) + b"x" * 30_000,
        "tail.pcap": capture(random_packets(50, 6)) + b"rest",
        "empty.pcap": capture([]), "junk.pcap": b"junk" * 9000, "nothing.pcap": b"",
    }
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    return tmp_path, files


@pytest.mark.parametrize("range_bytes", [1 << 30, 4096, 700, 20_000])
def test_any_ranges_give_the_same_packets(spark, captures, range_bytes):
    path, files = captures
    got = rows(pcap.read_captures(spark, str(path), range_bytes=range_bytes))
    assert got == sorted(x for k, v in files.items() for x in want(k, v))


@pytest.mark.parametrize("pieces", [1, 2, 7, 64])
def test_pieces_of_one_capture(spark, tmp_path, pieces):
    content = capture(random_packets(2000, 9))
    (tmp_path / "x.pcap").write_bytes(content)
    index = ranges.capture_index(spark, str(tmp_path), range_bytes=-(-len(content) // pieces))
    assert index.count() == pieces and ranges.proofs(index.drop("first_idx")).where("NOT fits").isEmpty()
    assert rows(ranges.read_ranges(index)) == want("x.pcap", content)


def test_counts_and_early_stop(spark, captures):
    path, files = captures
    n = {r["path"].rpartition("/")[2]: r["packets"] for r in ranges.capture_index(spark, str(path), range_bytes=3000).groupBy("path").agg(F.sum("packets").alias("packets")).collect()}
    assert n == {k: len(want(k, v)) for k, v in files.items() if v}  # Spark's listing passes over files without a byte
    got = rows(pcap.read_captures(spark, str(path), max_packets=45, range_bytes=3000))
    assert got == sorted(x for k, v in files.items() for x in want(k, v)[:45])


def test_a_wrong_guess_is_walked_again(captures):
    """The payload's records look right, so ranges are guessed wrong; only the proof tells."""
    path, files = captures
    name = "looks_like_records.pcap"
    w = ranges.opened(f"{path}/{name}")
    with w.file:
        head = ranges.Header(w.take(0, 24))
        true = 24 + 16 + 40 * 40  # where the second record starts
        guess = ranges.synchronised(w, head, 100, true)
        assert guess is not None and guess < true


def test_windows_hold_little(monkeypatch, tmp_path):
    monkeypatch.setattr(ranges, "WINDOW", 4096)
    (tmp_path / "x.pcap").write_bytes(capture([(10**15 + i, bytes(3000)) for i in range(500)]))
    w, most = ranges.opened(f"{tmp_path}/x.pcap"), 0
    for _ in ranges.packets_of(w, ranges.Header(w.take(0, 24))):
        most = max(most, len(w.body))
    assert most <= 4096


def test_counting_passes_over_payloads(monkeypatch, tmp_path):
    monkeypatch.setattr(ranges, "WINDOW", 64)
    content = capture([(10**15 + i, bytes(30_000)) for i in range(100)])
    (tmp_path / "x.pcap").write_bytes(content)
    w = ranges.opened(f"{tmp_path}/x.pcap")
    read = []
    file = w.file

    class Counted:
        def seek(self, at):
            file.seek(at)

        def read(self, n):
            read.append(n)
            return file.read(n)

    w.file = Counted()
    assert ranges.walk(w, ranges.Header(w.take(0, 24)), 24, w.size) == (100, len(content)) and sum(read) < len(content) / 100


def counted(monkeypatch):
    """The sizes of all reads of captures from now on."""
    read, store = [], ranges.store

    class File:
        def __init__(self, file):
            self.file, self.seek, self.size = file, file.seek, file.size

        def read(self, n):
            read.append(len(got := self.file.read(n)))
            return got

        __enter__, __exit__ = lambda self: self, lambda self, *_: self.file.close()

    class Files:
        def __init__(self, path):
            self.files, self.root = store(path)

        def open_input_file(self, root):
            return File(self.files.open_input_file(root))

    monkeypatch.setattr(ranges, "store", lambda path: (Files(path), store(path)[1]))
    return read


def test_a_range_reads_its_own_bytes(monkeypatch, tmp_path):
    content, read = capture(random_packets(3000)), counted(monkeypatch)
    (tmp_path / "x.pcap").write_bytes(content)
    (*_, start, stop, n) = next(ranges._scan([(f"{tmp_path}/x.pcap", 5, 50_000, 60_000, None)]))
    assert 50_000 <= start < stop < 62_000 and n > 10 and sum(read) < 30_000


def test_records_of_a_batch():
    for some in (random_packets(50), [(0, b""), ((1 << 32) * 10**6 - 1, b"x")], []):
        body, bounds = packed.records(pa.array([t for t, _ in some], pa.int64()), pa.array([d for _, d in some], pa.binary()))
        assert pcap.file_header() + body.tobytes() == b"".join(pcap.encode(some)) and np.diff(bounds).tolist() == [16 + len(d) for _, d in some]
    with pytest.raises(ValueError, match="1970"):
        packed.records(pa.array([-1]), pa.array([b""]))
    with pytest.raises(ValueError, match="without"):
        packed.records(pa.array([1]), pa.array([None], pa.binary()))


def test_pcapng_through_a_window(spark, tmp_path, monkeypatch):
    head = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    face = struct.pack("<IIHHIHHB3xI", 1, 28, 101, 0, 0, 9, 1, 9, 28)
    one = lambda ts, d: struct.pack("<IIIIIII", 6, 32 + len(d) + -len(d) % 4, 0, ts >> 32, ts & 0xFFFFFFFF, len(d), len(d)) + d + bytes(-len(d) % 4) + struct.pack("<I", 32 + len(d) + -len(d) % 4)
    content = head + face + b"".join(one(10**18 + i, b"p" * i) for i in range(200))
    (tmp_path / "x.pcapng").write_bytes(content)
    assert rows(pcap.read_captures(spark, str(tmp_path), range_bytes=1000)) == want("x.pcapng", content)
    assert pcap.count_packets(spark, str(tmp_path)).first()["packets"] == 200
    assert spark.dataSource.register(pcap.CaptureSource) is None and spark.read.format("pcap").load(str(tmp_path)).count() == 200


def packets(spark, n=3000, keys=7):
    return spark.range(n).select(
        F.col("id").alias("idx"), (10**15 + F.col("id") * 10).alias("ts_us"), F.encode(F.repeat(F.md5(F.col("id").cast("string")), 3), "UTF-8").alias("data"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % keys).cast("string"))).alias("session"),
    )


def test_rolled_captures(spark, tmp_path):
    x = packets(spark).withColumn("file", F.concat("session", F.lit("/x.pcap")))
    pcap.write_captures(x, str(tmp_path / "a"), roll_bytes=20_000)
    made = glob.glob(f"{tmp_path}/a/hot/x-*.pcap")
    assert len(made) > 8 and max(map(os.path.getsize, made)) < 20_200 and not glob.glob(f"{tmp_path}/a/**/*.part", recursive=True)
    order = [r["ts_us"] for r in pcap.read_captures(spark, f"{tmp_path}/a/hot").orderBy("path", "idx").collect()]
    assert order == sorted(order) and len(order) == 2000
    assert pcap.read_captures(spark, str(tmp_path / "a")).select("ts_us", F.md5("data")).exceptAll(x.select("ts_us", F.md5("data"))).isEmpty()


def test_data_worked_out_by_the_writing_tasks(spark, tmp_path):
    x = packets(spark).withColumn("file", F.concat("session", F.lit("/x.pcap")))
    pcap.write_captures(x, str(tmp_path / "a"), roll_bytes=20_000)
    made = lambda rows: rows.withColumn("data", F.encode(F.repeat(F.md5(F.col("idx").cast("string")), 3), "UTF-8"))
    pcap.write_captures(x.drop("data"), str(tmp_path / "b"), roll_bytes=20_000, finish=made)
    a, b = (sorted(open(p, "rb").read() for p in glob.glob(f"{tmp_path}/{d}/**/*.pcap", recursive=True)) for d in "ab")
    assert a == b


def test_session_containers(spark, tmp_path):
    path, x = f"{tmp_path}/c", packets(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little comes to one task
    try:
        containers.write_sessions(x, path, roll_bytes=30_000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = containers.session_index(spark, path)
    assert index.where("session = 'hot'").count() > 1 and index.select("file").distinct().count() > 5  # a hot session has segments
    got = containers.read_sessions(spark, path).select("session", "packet", "ts_us", F.md5("data").alias("m"))
    number = (F.expr("row_number() OVER (PARTITION BY session ORDER BY idx)") - 1).alias("packet")
    plain = x.select("session", number.cast("long"), "ts_us", F.md5("data").alias("m"))
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    some = spark.createDataFrame([("s0",), ("s0",), ("none",)], "session string")
    assert containers.read_sessions(spark, path, some).select("session").distinct().collect() == [("s0",)]
    r = index.where("session = 's3'").first()  # what lies there is a capture of its own
    with open(f"{path}/{r['file']}", "rb") as f:
        f.seek(r["offset"])
        assert len(list(pcap.decode(f.read(r["length"])))) == r["packets"]


def test_long_and_short_segments(spark, tmp_path, monkeypatch):
    """Segments of several windows, and many in one, give the same packets."""
    path, x = f"{tmp_path}/c", packets(spark, 3000, 700)
    containers.write_sessions(x, path)
    number = (F.expr("row_number() OVER (PARTITION BY session ORDER BY idx)") - 1).cast("long").alias("packet")
    want = sorted(map(tuple, x.select("session", number, "ts_us", F.md5("data")).collect()))
    for window in (containers.WINDOW, 3000):
        monkeypatch.setattr(containers, "WINDOW", window)
        assert sorted(map(tuple, containers.read_sessions(spark, path).select("session", "packet", "ts_us", F.md5("data")).collect())) == want


def test_a_stretch_of_a_container_is_read_by_one_task(spark, tmp_path):
    path = f"{tmp_path}/c"
    containers.write_sessions(packets(spark, 3000, 700), path)
    files = containers.session_index(spark, path).select("file").distinct().count()
    assert containers.read_sessions(spark, path).select(F.spark_partition_id()).distinct().count() <= files


def test_what_lost_tasks_leave(spark, tmp_path):
    path = f"{tmp_path}/c"
    containers.write_sessions(packets(spark, 300), path)
    n = containers.read_sessions(spark, path).count()
    with open(f"{path}/lost-0000.sessions", "wb") as f:
        f.write(b"half a capture")
    assert containers.read_sessions(spark, path).count() == n
    assert [r["file"] for r in containers.vacuum(spark, path).collect()] == ["lost-0000.sessions"]
    assert containers.read_sessions(spark, path).count() == n and containers.vacuum(spark, path).isEmpty()


def test_a_damaged_segment_is_noticed(spark, tmp_path):
    path = f"{tmp_path}/c"
    containers.write_sessions(packets(spark, 30), path)
    name = glob.glob(f"{path}/*.sessions")[0]
    body = bytearray(open(name, "rb").read())
    body[60] ^= 1
    open(name, "wb").write(body)
    with pytest.raises(Exception, match="isn't what the index says"):
        containers.read_sessions(spark, path).count()


def test_no_packets(spark, tmp_path):
    containers.write_sessions(packets(spark, 0), f"{tmp_path}/c")
    assert containers.read_sessions(spark, f"{tmp_path}/c").count() == 0
