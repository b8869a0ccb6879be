import random
import struct

import pytest
from pyspark.sql import functions as F
from spindrift.functions.binary import cidr_bounds, clean_ip, clean_port, flag_names, ipv4_number, ipv4_text
from spindrift.operators import compliance as C
from spindrift.operators import encode as E
from spindrift.operators import genjson as G
from spindrift.operators import perturb as P
from spindrift.operators import saliency as A
from spindrift.operators import scoring as R
from spindrift.sources import files, pcap


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def packets(spark, times, flow=1):
    return spark.createDataFrame([(flow, i, t, 100, 1) for i, t in enumerate(times)], "flow long, idx long, ts_us long, len long, tuple long")


def test_tokens(spark):
    t = lambda b, **k: one(spark, E.sliding_tokens(F.lit(bytes.fromhex(b)), **k))
    assert t("aabbccdd") == ["aabb", "bbcc", "ccdd"] and t("aa") == [] and t("") == [] and len(t("00" * 64)) == 63
    assert t("aabbcc", window=3, stride=1) == ["aab", "abb", "bbc", "bcc"] and t("aabbccdd", limit=2) == ["aabb", "bbcc"]


def test_masks_and_slices(spark):
    assert one(spark, E.zeroize(F.lit(b"abcdef"), [(1, 2), (5, 9), (9, 1)])) == b"a\0\0de\0"
    assert one(spark, E.slice_bytes(F.lit(b"abcdef"), 4, 4, True)) == b"ef\0\0" and one(spark, E.normalized(F.lit(255))) == 1.0


def test_matrix_of_few_packets(spark):
    df = spark.createDataFrame([(1, i, bytes([i + 1]) * 90, bytes([9])) for i in range(2)], "flow long, idx long, header binary, payload binary")
    m = E.byte_matrix(df).first()["matrix"]
    assert len(m) == 1600 and m[:80] == b"\1" * 80 and m[80:82] == b"\x09\0" and m[320:400] == b"\2" * 80 and not any(m[640:])
    px = E.pixel_index(E.byte_matrix(df)).where("global_offset = 400").first()
    assert (px["packet_index"], px["region"], px["region_offset"], px["value"]) == (1, "payload", 0, 9)
    img = files.from_png(files.to_png(E.byte_matrix(df))).first()
    assert img["matrix"] == m and img["error"] is None
    assert files.from_png(spark.createDataFrame([(1, b"no")], "flow long, png binary")).first()["error"]


@pytest.mark.parametrize(("text", "want"), [("a1.2.3.4b", "1.2.3.4"), ("01.2.3.4", None), ("1.2.3", None), ("1.2.3.256", None), (None, None), ("", None)])
def test_clean_ip(spark, text, want):
    assert one(spark, clean_ip(F.lit(text).cast("string"))) == want


def test_addresses(spark):
    assert one(spark, ipv4_number(F.lit("10.0.0.1"))) == 167772161 and one(spark, ipv4_text(F.lit(167772161))) == "10.0.0.1"
    low, high = cidr_bounds(F.lit("10.1.2.3/8"))
    assert (one(spark, low), one(spark, high)) == (10 << 24, (11 << 24) - 1) and one(spark, cidr_bounds(F.lit("1.2.3.4/33"))[0]) is None
    assert [one(spark, clean_port(F.lit(t).cast("string"))) for t in (" 80 ", "80.0", "70000", "-1", None)] == [80, None, None, None, None]
    assert [one(spark, flag_names(F.lit(f).cast("long"))) for f in (0x12, 0, 0xC0, None)] == ["SYN,ACK", "NONE", "NONE", None]


GOOD = {"idx": 1, "flow": 1, "ip_version": 4, "ip_ihl": 5, "ip_ttl": 64, "src_ip": 167772161, "dst_ip": 167772162, "proto": 6, "sport": 1234, "dport": 80, "flags": 0x10, "tcp_ack": 5, "tcp_window": 100, "udp_len": None, "http_method": None, "http_version": None, "http_host": None, "dns_id": None, "dns_qr": None, "dns_rcode": None, "l3_len": 150}
UDP = {"proto": 17, "flags": None, "tcp_ack": None, "tcp_window": None, "udp_len": 8}
BREAKS = [
    {"ip_version": 6}, {"ip_ihl": 4}, {"ip_ttl": 0}, {"src_ip": 3758096385}, {"src_ip": 0}, {"dst_ip": 0}, {"src_ip": None}, {"sport": 0, "dport": 0}, {"flags": 5}, {"flags": 0x12, "tcp_ack": 0}, {"tcp_window": 0},
    UDP | {"sport": 0, "dport": 0}, UDP | {"udp_len": 7}, {"http_version": "HTTP/1.1", "http_method": "FETCH", "http_host": "h"}, {"http_version": "HTTP/2", "http_method": "GET", "http_host": "h"},
    {"http_version": "", "http_method": "", "http_host": ""}, {"dns_id": 0, "dns_qr": 0}, {"dns_id": 1, "dns_qr": 2}, {"dns_id": 1, "dns_qr": 1, "dns_rcode": 6},
]
HEADER = ", ".join(f"{k} {'string' if k.startswith('http') else 'long'}" for k in GOOD)


def test_each_rule_fires_alone(spark):
    df = spark.createDataFrame([tuple((GOOD | b).values()) for b in [{}, *BREAKS]], HEADER)
    got = [r["violations"] for r in C.violations(df.coalesce(1)).collect()]
    assert got[0] == [] and got[1:] == [[f"{p}: {m}"] for p, m, _ in C.RULES]
    assert C.compliance(df, []).first()["rate"] == 1 / 20 and C.compliance(df.limit(0), []).first()["rate"] == 1.0


def test_filters(spark):
    df = spark.createDataFrame([tuple((GOOD | {"idx": i, "src_ip": s}).values()) for i, s in enumerate([167772161, 167772416, None, 3232235777])], HEADER)
    ids = lambda x: sorted(r["idx"] for r in x.collect())
    assert ids(C.address_filter(df, ["10.0.0.0/24", "nonsense"])) == [0] and ids(C.address_filter(df)) == [0, 1, 3]
    assert ids(C.address_filter(df, pairs=[("10.0.0.0/8", "10.0.0.2")])) == [0, 1]
    with pytest.raises(ValueError, match="pair"):
        C.address_filter(df, pairs=[])
    ranges = spark.createDataFrame([("10.0.0.0/7",), ("bad",), ("192.168.1.0/24",), ("192.168.1.1",)], "cidr string")
    assert ids(C.address_join(df, ranges)) == [0, 1, 3]


def test_time_scale_and_tail(spark):
    got = [r["ts_us"] for r in P.time_scale(packets(spark, [0, 1, 3, 7]), 0.4).orderBy("idx").collect()]
    assert [round(x, 9) for x in got] == [0, 0.4, 1.2, 2.8]
    assert [r["iat_us"] for r in P.inter_arrival(packets(spark, [5, 3, 9])).orderBy("idx").collect()] == [None, -2, 6]
    tail = [r["ts_us"] for r in P.tail_shift(packets(spark, [0, 10, 20, 50]), 2, 0.5).orderBy("idx").collect()]
    assert tail == [0.0, 5.0, 15.0, 45.0]


def test_perturbations_keep_their_promises(spark):
    x = packets(spark, sorted(random.Random(1).sample(range(10**6), 40)))
    r = P.reorder(x, 4, 0.9, 0.2)
    assert r.where("ok").count() == 40 and sorted(i["ts_us"] for i in r.collect()) == sorted(i["ts_us"] for i in x.collect())
    assert P.retransmit(x, 0.1, 3).count() == 44
    f = P.frag_merge(x, 0.5, 0.5, 400, 20).collect()
    assert sum(i["len"] for i in f) == 4000 and len(f) != 40
    assert P.jitter_drop(x, 100.0, 1.1).count() == 1
    assert P.chain(x, [2, 2, 5]).count() == P.retransmit(x, 0.06, 5).count()
    bad = spark.createDataFrame([(1, 0, 5, None, 1), (1, 1, 6, None, 1)], "flow long, idx long, ts_us long, len long, tuple long")
    assert P.run_counts(P.frag_merge(bad, 1.0, 1.0, 10, 1)).first().asDict() == {"ok": 0, "failed": 2}
    assert P.run_id([1, 5, 1], "heavy", "first", 3) == "reorder+time_scale_heavy_first3"


def test_label_noise(spark):
    two = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "flow_id long, class string")
    moved = [r for r in P.label_noise(two, 0.1).collect() if r["class"] != r["new_class"]]
    assert len(moved) == 4
    assert all(r["class"] == r["new_class"] for r in P.label_noise(two.where("class = 'a'"), 0.5).collect())


@pytest.mark.parametrize(("text", "want"), [("0x", b""), ("12:34", b"\x12\x34"), ("123", b"123"), (None, b""), ('{"raw": "ff"}', b"\xff"), ('{"x": "ff"}', b""), ("zz", b"zz")])
def test_payloads(spark, text, want):
    assert bytes(one(spark, G.payload_bytes(F.lit(text).cast("string")))) == want


def test_zip_is_as_long_as_the_shorter_side(spark):
    h = spark.createDataFrame([("k", i, f"h{i}") for i in range(3)] + [("only", 0, "h")], "key string, pos long, value string")
    p = spark.createDataFrame([("k", i, f"p{i}") for i in range(2)], "key string, pos long, value string")
    assert sorted((r["pos"], r["header"], r["payload"]) for r in G.zip_pairs(h, p).collect()) == [(0, "h0", "p0"), (1, "h1", "p1")]


def test_saliency(spark):
    t = spark.createDataFrame([(1, "a", 0, 0, 2, 1.0), (1, "a", 0, 1, 3, 2.0), (2, "b", 1, 4, 4, 9.0)], "sample long, class string, packet long, byte_start long, byte_end long, score double")
    b = A.byte_scores(t)
    assert {r["byte"]: r["score"] for r in b.collect()} == {0: 1.0, 1: 3.0, 2: 2.0}
    m = A.mean_saliency(A.sample_bytes(b), spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "sample long, class string"))
    assert {(r["class"], r["byte"]): r["mean"] for r in m.collect()}[("a", 1)] == 1.5 and {(r["class"], r["byte"]): r["mean"] for r in m.collect()}[("ALL", 1)] == 1.0
    g = A.grid(b, 2, 3)
    assert g.count() == 6 and abs(A.colour_cap(g).first()["vmax"] - 2.95) < 1e-9


def test_scoring(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (2, 2)], "gold long, pred long")
    assert R.accuracy(df, "gold", "pred").first()["accuracy"] == 2 / 3 and R.accuracy(df.limit(0), "gold", "pred").first()["accuracy"] == 0.0
    c = R.BenchConfig().merged({"runs": 0, "seed": None}, {"other": 1})
    assert c.runs == 0 and c.seed == 42
    b = R.benchmark(spark.range(10), lambda d: d, R.BenchConfig(1, 1, 2))
    assert b.count() == 2 and R.timing_summary(b).first()["flows"] == 10


def capture(order, magic, link, rows, cut=0):
    units = 10**9 if magic == 0xA1B23C4D else 10**6
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for ts, d in rows:
        out += struct.pack(order + "IIII", ts // 10**6, ts % 10**6 * (units // 10**6), len(d), len(d)) + d
    return out[: len(out) - cut]


ROWS = [(1_700_000_000_000_001 + i, bytes([0x45]) + bytes(30 + i)) for i in range(5)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("magic", [0xA1B2C3D4, 0xA1B23C4D])
def test_capture_formats(order, magic):
    got = list(pcap.decode(capture(order, magic, 1, ROWS)))
    assert [(i, t, d) for i, t, _, _, d in got] == [(i, t, d) for i, (t, d) in enumerate(ROWS)] and {g[2] for g in got} == {1}
    assert len(list(pcap.decode(capture(order, magic, 1, ROWS, cut=3)))) == 4 and len(list(pcap.decode(capture(order, magic, 1, ROWS), 2))) == 2
    assert list(pcap.decode(b"")) == list(pcap.decode(b"junk" * 20)) == []


def test_pcapng():
    block = lambda k, b: struct.pack("<II", k, len(b) + 12) + b + struct.pack("<I", len(b) + 12)
    head = struct.pack("<IIIHHq", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1) + struct.pack("<I", 28)
    face = block(1, struct.pack("<HHI", 101, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    ts = 1_700_000_000_000_001_000
    pkt = block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, 5, 5) + b"hello\0\0\0")
    assert list(pcap.decode(head + face + pkt)) == [(0, ts // 1000, 101, 5, b"hello")]


def test_round_trip_through_the_source(spark, tmp_path):
    x = spark.createDataFrame([(f"c{i % 2}/f.pcap", i, 10**15 + i, 167772161 + i % 2, 167772162 - i % 2, 1000 + i % 2, 1001 - i % 2, b"x" * i, 6) for i in range(5)], "file string, idx long, ts_us long, s long, d long, sp long, dp long, payload binary, proto long")
    pcap.write_captures(x.withColumn("data", pcap.build_packet("s", "d", "sp", "dp", "payload")), str(tmp_path))
    y = pcap.layers(spark.read.format("pcap").load(str(tmp_path)))
    assert sorted((r["ts_us"], len(r["payload"]), r["ip_ttl"], r["flag_names"], r["l3_len"]) for r in y.collect()) == [(10**15 + i, i, 64, "PSH,ACK", 40 + i) for i in range(5)]
    s = C.sessions(y.withColumn("flow", F.lit(1)))
    assert s.count() == 1 and s.first()["packets"] == 5
    assert pcap.read_captures(spark, str(tmp_path)).count() == 5
    listed = files.list_files(spark, str(tmp_path), "*.pcap", ("class",), (".PCAP",))
    assert {r["class"] for r in listed.collect()} == {"c0", "c1"} and files.list_files(spark, str(tmp_path / "none")).count() == 0


def test_text_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'aabb "q" c'), (0, "dd")], "label int, text_a string")
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted((r["label"], r["text_a"]) for r in files.read_tsv(spark, str(tmp_path / "t")).collect()) == [("0", "dd"), ("1", 'aabb "q" c')]
    files.write_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), df.schema).count() == 2
    (tmp_path / "a.json").write_text('{"k": ["x", {"p": 1}], "m": "y"}')
    got = {r["key"]: r["items"] for r in files.read_json_lists(spark, str(tmp_path / "a.json")).collect()}
    assert got == {"k": ["x", '{"p":1}'], "m": ["y"]}
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_json_lists(spark, str(tmp_path / "b.json")).collect()
    assert one(spark, files.literal_dicts(F.lit("{'a': 'b'}"))) == {"a": "b"}


def test_registry(spark):
    from spindrift.plans.registry import Registry, Task

    def good(spark, sf):
        """Counts."""
        return spark.range(3)

    def bad(spark, sf):
        """Fails."""
        raise RuntimeError("no")

    r = Registry([Task("b", "g", bad), Task("a", "g", good, "x")])
    assert [t.name for t in r.list(group="g")] == ["a", "b"] and [t.name for t in r.search("COUNT")] == ["a"] and r.show("a")["sql"] == "yes" and all(r.doctor().values())
    assert r.run_group("g", spark, "", keep_going=True)["a"] == 3
    with pytest.raises(RuntimeError):
        r.run_group("g", spark, "")


def test_merges_go_pair_by_pair_from_the_first_packet(spark):
    x = packets(spark, [10, 20, 30, 40, 50])
    f = P.frag_merge(x, 0.0, 1.1, 400, 20).orderBy("idx").collect()
    assert [(r["ts_us"], r["len"]) for r in f] == [(15, 200), (35, 200), (50, 100)]


def test_merges_sort_payloads_twice_at_most(spark):
    """All windows before the new places share one order; null flows and flows with holes are handed on as they were."""
    rows = [(1, i, 10 * i, 100, 5, bytes([i]) * 100) for i in range(40)] + [(None, i, 10 * i, 100, 5, b"n" * 100) for i in range(4)] + [(2, i, None if i else 5, 100, 5, b"x" * 100) for i in range(3)]
    f = P.frag_merge(spark.createDataFrame(rows, "flow int, idx long, ts_us long, len long, tuple long, payload binary"), 0.3, 0.5, 400, 20)
    got = f.collect()
    assert all(r["len"] == len(r["payload"]) for r in got) and sum(r["flow"] == 1 for r in got) < 60
    assert sorted(b"".join(bytes(r["payload"]) for r in got)) == sorted(b"".join(r[5] for r in rows))
    assert sorted((r["idx"], r["ok"], r["error"]) for r in got if r["flow"] == 2) == [(i, False, "null ts_us") for i in range(3)]
    plan = f._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum(" Sort [" in f" {line.lstrip('+-: *()0123456789')}" for line in plan.split("\n")) <= 2 and "Join" not in plan
