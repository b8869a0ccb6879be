"""Addresses, prefixes, IPv6 header chains and server names, against Python's own arithmetic."""

import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F
from spindrift.functions import addresses as A
from spindrift.operators import frames as R
from spindrift.operators import prefixes as X
from spindrift.sources import pcap


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def out(df, expr):
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def sample(n=300, seed=4):
    rnd = random.Random(seed)
    for _ in range(n):
        yield b"".join(rnd.choice([b"\0\0", b"\0\0", struct.pack(">H", rnd.choice([1, 0xDB8, 0xFFFF, rnd.randrange(65536)]))]) for _ in range(8))


def test_text_and_back(spark):
    keys = [*sample(), bytes(16), bytes(15) + b"\1", bytes(10) + b"\xff\xff\x0a\0\0\1", None, b"short"]
    df = column(spark, keys, "binary")

    def rfc(k):
        if k is None or len(k) != 16:
            return None
        a = ipaddress.IPv6Address(k)
        return f"::ffff:{a.ipv4_mapped}" if a.ipv4_mapped else str(a)

    got = out(df, A.ipv6_text(F.col("v")))
    assert got == [rfc(k) for k in keys]
    back = out(column(spark, got, "string"), A.ipv6_bytes(F.col("v")))
    assert [b and bytes(b) for b in back] == [k if k is None or len(k) == 16 else None for k in keys]


TEXTS = ["::", "::1", "1::", "2001:DB8::10.0.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
NO_TEXTS = ["", ":", ":::", "1::2::3", "12345::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "g::", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "1.2.3", None]


def test_what_is_an_address(spark):
    texts = [*TEXTS, *NO_TEXTS, "10.0.0.1", "10.0.0.256"]

    def key(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        return a.packed if a.version == 6 else bytes(10) + b"\xff\xff" + a.packed

    got = out(column(spark, texts, "string"), A.address_key(F.col("v")))
    assert [g and bytes(g) for g in got] == [key(t) for t in texts]


def test_prefixes(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.randint(0, 128)) for k in sample(200)] + [(b"\xff" * 16, n) for n in range(129)]
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(rows)], "i int, v binary, n int")
    got = out(df, A.masked(F.col("v"), F.col("n")))
    assert [bytes(g) for g in got] == [ipaddress.ip_network((k, n), strict=False).network_address.packed for k, n in rows]
    texts = ["10.1.2.3/8", "10.1.2.3", "::/0", "2001:db8::ffff/33", "1.2.3.4/33", "::1/129", "::1/x", "/8", None, "10.0.0.0/"]
    got = out(column(spark, texts, "string"), A.cidr_key(F.col("v")))
    assert [g and (bytes(g["net"]).hex(), g["bits"]) for g in got] == [
        ("00000000000000000000ffff0a000000", 104), ("00000000000000000000ffff0a010203", 128), ("0" * 32, 0), ("20010db8" + "0" * 24, 33), None, None, None, None, None, None,
    ]


def test_joins_with_prefixes_against_every_pair(spark):
    rnd = random.Random(2)
    address = lambda: rnd.choice([ipaddress.ip_address(0x0A000000 + rnd.randrange(256) * 65536 + rnd.randrange(4)), ipaddress.ip_address((0x20010DB8 << 96) + (rnd.randrange(16) << 80) + rnd.randrange(4))])
    net = lambda: (lambda a: f"{a}/{rnd.choice((8, 12, 16, 32) if a.version == 4 else (32, 44, 48, 128))}")(address())
    ends = [(i, address(), address()) for i in range(150)]
    pairs = [(i, net(), net()) for i in range(60)] + [(60, "nothing", "10.0.0.0/8"), (61, "::/0", "::/0"), (61, "10.0.0.0/7", "10.0.0.0/7")]
    pack = lambda a: a.packed if a.version == 6 else bytes(10) + b"\xff\xff" + a.packed
    df = spark.createDataFrame([(i, pack(a), pack(b)) for i, a, b in ends] + [(999, None, pack(ends[0][1]))], "idx int, src binary, dst binary")
    t = spark.createDataFrame(pairs, "id int, src_cidr string, dst_cidr string")

    def six(text):
        n = ipaddress.ip_network(text, strict=False)
        return n if n.version == 6 else ipaddress.ip_network(f"::ffff:{n.network_address}/{96 + n.prefixlen}")

    nets = [(i, six(a), six(b)) for i, a, b in pairs if a != "nothing"]
    want = {}
    for i, a, b in ends:
        a, b = ipaddress.ip_address(pack(a)), ipaddress.ip_address(pack(b))
        hits = [(-s.prefixlen, -d.prefixlen, k) for k, s, d in nets if a in s and b in d]
        if hits:
            s, d, k = min(hits)
            want[i] = (-s, -d, k)
    x = X.pair_join(df, t, "src", "dst")
    assert {r["idx"]: (r["src_bits"], r["dst_bits"], r["pair_id"]) for r in x.collect()} == want
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    one = X.prefix_join(df, t.withColumnRenamed("src_cidr", "cidr"), "src")
    for r in one.collect():
        hits = [(-s.prefixlen, k) for k, s, _ in nets if ipaddress.ip_address(bytes(r["src"])) in s]
        assert min(hits) == (-r["range_bits"], r["range_id"])
    assert X.pair_join(df, t.limit(0), "src", "dst").count() == 0 and X.prefix_join(df.limit(0), t.withColumnRenamed("src_cidr", "cidr"), "src").count() == 0
    assert one.columns == ["idx", "src", "dst", "range_bits", "range_id"] and x.columns == ["idx", "src", "dst", "src_bits", "dst_bits", "pair_id"]


SRC, DST = ipaddress.ip_address("2001:db8::1").packed, ipaddress.ip_address("fe80::2:3").packed


def packet(l4, kind, extra=b"", first=None):
    return b"\x60\0\0\0" + struct.pack(">HBB", len(extra) + len(l4), kind if first is None else first, 64) + SRC + DST + extra + l4


def total(data):
    data += b"\0" * (len(data) % 2)
    t = sum(struct.unpack(f">{len(data) // 2}H", data))
    while t >> 16:
        t = (t & 0xFFFF) + (t >> 16)
    return t


UDP = struct.pack(">HHHH", 53, 5353, 8 + 5, 0) + b"hello"
OPTIONS = lambda kind, n=8: bytes([kind, n // 8 - 1]) + bytes(n - 2)
CASES = {  # data -> (protocol, where, whole, rerouted, source port)
    "plain": (packet(UDP, 17), (17, 40, True, False, 53)),
    "hop by hop": (packet(UDP, 17, OPTIONS(17), 0), (17, 48, True, False, 53)),
    "many": (packet(UDP, 17, OPTIONS(60) + OPTIONS(43, 16) + OPTIONS(44, 24) + b"\x11\0\0\0\0\0\0\1", 0), (17, 96, True, False, 53)),
    "authentication": (packet(UDP, 17, bytes([17, 4]) + bytes(22), 51), (17, 64, True, False, 53)),
    "first fragment": (packet(UDP, 17, b"\x11\0\0\1\0\0\0\1", 44), (17, 48, False, False, 53)),
    "later fragment": (packet(UDP, 17, b"\x11\0\0\x10\0\0\0\1", 44), (17, None, False, False, None)),
    "routed on": (packet(UDP, 17, b"\x11\0\2\1" + bytes(4), 43), (17, 48, True, True, 53)),
    "cut": (packet(b"", 60, b"\x11", 60), (60, 40, True, False, None)),
    "cut inside": (packet(b"", 60, bytes([17, 9]) + bytes(10), 60), (60, 40, True, False, None)),
    "nothing follows": (packet(b"", 59), (59, 40, True, False, None)),
    "long chain": (packet(UDP, 17, OPTIONS(60) * 60 + OPTIONS(17), 60), (17, 40 + 61 * 8, True, False, 53)),
}


def test_header_chains(spark):
    df = spark.createDataFrame([(k, pcap.RAW, d) for k, (d, _) in CASES.items()], "name string, link int, data binary")
    x = pcap.layers(df).collect()
    assert {r["name"]: (r["proto"], r["l4_at"], r["chain"]["whole"], r["chain"]["rerouted"], r["sport"]) for r in x} == {k: w for k, (_, w) in CASES.items()}
    assert {(r["src"], r["dst"], bytes(r["src_key"])) for r in x} == {("2001:db8::1", "fe80::2:3", SRC)}
    for r in R.with_checksums(df).collect():
        data, (d, w) = bytes(r["data"]), CASES[r["name"]]
        if w[0] == 17 and w[1] and w[2] and not w[3]:
            body = data[w[1] :]
            assert total(SRC + DST + struct.pack(">II", len(body), 17) + body) == 0xFFFF and data[: w[1]] == d[: w[1]]
        else:
            assert data == d  # what the checksum covers isn't there
    ping = packet(b"\x80\0\0\0\0\1\0\1", 58)
    r = R.with_checksums(spark.createDataFrame([(pcap.RAW, ping)], "link int, data binary")).first()
    assert total(SRC + DST + struct.pack(">II", 8, 58) + bytes(r["data"])[40:]) == 0xFFFF


def hello(names, dummies=0, session=b""):
    exts = struct.pack(">HH", 10, 0) * dummies
    for kind, name in names:
        exts += struct.pack(">HH", kind, len(name) + 5) + struct.pack(">HBH", len(name) + 3, 0, len(name)) + name if kind == 0 else struct.pack(">HH", kind, len(name)) + name
    body = b"\3\3" + bytes(32) + bytes([len(session)]) + session + b"\0\2\x13\1\1\0" + struct.pack(">H", len(exts)) + exts
    return b"\x16\3\1" + struct.pack(">H", len(body) + 4) + b"\1" + struct.pack(">I", len(body))[1:] + body


@pytest.mark.parametrize(("payload", "name"), [
    (hello([(0, b"a.example")]), b"a.example"), (hello([(5, b"xyz"), (0, b"b.example")], 200, b"\1" * 32), b"b.example"), (hello([(5, b"xyz")], 3), None), (hello([]) + b"\0\0\0\x0f\0\x0d\0\0\x0anot.within", None),
    (b"\x17" + hello([(0, b"a.example")])[1:], None), (b"", None), (b"\x16\3\1", None),
])
def test_server_names(spark, payload, name):
    r = spark.createDataFrame([(b"head" + payload,)], "d binary").select(R.server_name(F.col("d"), F.lit(4)).alias("x")).first()["x"]
    assert (r and (b"head" + payload)[r["at"] : r["at"] + r["size"]]) == name
