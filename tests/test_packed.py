"""Packets of a batch at once, against plain arithmetic packet by packet; what the plans of frame queries hold."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from spindrift.functions import addresses as A
from spindrift.functions import packed
from spindrift.operators import frames as R
from spindrift.operators import prefixes as X
from spindrift.sources import pcap


def words(data: bytes) -> int:
    data += b"\0" * (len(data) % 2)
    return sum(struct.unpack(f">{len(data) // 2}H", data))


def test_numbers_and_sums():
    rnd = random.Random(3)
    rows = [rnd.randbytes(rnd.randrange(12)) for _ in range(200)] + [None, b""]
    whole = pa.array([b"first", *rows], pa.binary())
    p = packed.Packed(whole.slice(1))  # places count from the slice on
    for size in (1, 2, 4):
        for at in (-1, 0, 3, 11):
            want = [int.from_bytes(r[at : at + size], "big") if r is not None and at >= 0 and at + size <= len(r) else -1 for r in rows]
            assert p.number(np.full(len(rows), at), size).tolist() == want
    for at, size in ((0, 99), (1, 5), (3, 4), (2, 0), (9, 9), (2, -4)):
        got = p.sums()(np.full(len(rows), at), size).tolist()
        assert got == [words((r or b"")[at : max(at, at + size)]) for r in rows]
    assert p.array().to_pylist() == rows


@pytest.mark.parametrize("slice_bytes", [1, 100, 1 << 20])
def test_slices_change_nothing(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(packed, "SLICE", slice_bytes)
    data = pa.array([b"x", *[bytes([i]) * (i % 40) for i in range(100)], None], pa.binary()).slice(1)
    assert packed.sliced(lambda d: packed.Packed(d).array(), data).to_pylist() == data.to_pylist()
    assert packed.sliced(lambda d: packed.Packed(d).array(), data.slice(0, 0)).to_pylist() == []


def hello(dummies: int, name: bytes) -> bytes:
    ext = struct.pack(">HH", 10, 0) * dummies + struct.pack(">HHHBH", 0, len(name) + 5, len(name) + 3, 0, len(name)) + name
    body = b"\x03\x03" + bytes(32) + b"\0" + b"\0\2\x13\1" + b"\1\0" + struct.pack(">H", len(ext)) + ext
    return b"\x16\3\1" + struct.pack(">H", (len(body) + 4) & 0xFFFF) + b"\1" + len(body).to_bytes(3, "big") + body


def test_hellos_of_any_length(spark):
    """Thousands of extensions before the name; before, each was a step of an interpreted fold with a list of as many numbers."""
    rows = [(i, struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(h), 1, 0, 64, 6, 0, b"\1" * 4, b"\2" * 4) + struct.pack(">HHIIBBHHH", 5, 443, 1, 2, 0x50, 24, 9, 0, 0) + h) for i, h in enumerate(hello(n, b"example.org") for n in (0, 150, 16000) for _ in range(200))]
    df = spark.createDataFrame(rows, "idx int, data binary").withColumn("link", F.lit(pcap.RAW))
    got = {r["idx"]: bytes(r["data"]) for r in R.zeroize_fields(df).collect()}
    for i, d in rows:
        g = got[i]
        assert g[-11:] == b"zeroedzeroe" and len(g) == len(d) and g[52:-11] == d[52:-11] and g[12:28] == bytes(16)
        assert words(g[:20]) % 65535 == 0 and (words(g[20:]) + words(g[12:20]) + 6 + len(g) - 20) % 65535 == 0


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_fold_a_packet(spark):
    """Fields, checksums and names are read batch by batch: no interpreted function of a row's list is left in the plans."""
    df = spark.createDataFrame([(1, 1, pcap.RAW, b"\x45")], "flow int, idx int, link int, data binary")
    for x in (pcap.layers(df), R.with_checksums(df), R.zeroize_fields(df), R.randomize_fields(df, ["flow", "idx"]), df.select(A.ipv6_text(F.col("data")))):
        assert "lambda" not in plan(x)


def test_ranges_are_read_once(spark):
    """Literal ranges become constants, tables of ranges are read batch by batch, and packets are compared by numbers."""
    keys = [bytes(16), bytes(10) + b"\xff\xff\x0a\x40\0\0", bytes(10) + b"\xff\xff\x0a\x80\0\0", bytes(15) + b"\1", b"\xff" * 16, b"\x80" + bytes(15), None]
    df = spark.createDataFrame(list(enumerate(keys)), "idx int, src binary").withColumn("dst", F.col("src"))
    near = df.where(X.within_any(F.col("src"), ["10.64.0.0/10", "::1", "8000::/1", "none", "1.2.3.4/33"]))
    assert sorted(r["idx"] for r in near.collect()) == [1, 3, 4, 5] and df.where(X.within_any(F.col("src"), [])).count() == 0
    t = spark.createDataFrame([(1, "::/0", "::/0"), (2, "8000::/1", "ffff::/16"), (3, "::/64", "::1"), (4, "10.0.0.0/x/9", "10.0.0.0/9"), (5, "fe80::1%eth0", "::/0")], "id int, src_cidr string, dst_cidr string")
    pairs = X.pair_join(df, t, "src", "dst")
    assert sorted((r["idx"], r["src_bits"], r["dst_bits"], r["pair_id"]) for r in pairs.collect()) == [(0, 0, 0, 1), (1, 105, 105, 4), (2, 0, 0, 1), (3, 64, 128, 3), (4, 1, 16, 2), (5, 0, 0, 1)]
    for x in (near, pairs, X.prefix_join(df, t.withColumnRenamed("src_cidr", "cidr"), "src")):
        assert "lambda" not in plan(x)
