"""Queries over frames, datasets on disk and index tables; what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import work_path
from ..operators import compliance as C
from ..operators import datasets as D
from ..operators import frames as R
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators.encode import byte_matrix
from ..sources import containers, files, jsonlists, manifest, pcap
from .lenses import CATEGORICAL, FEATURES_SQL, FLOWS_SQL, PACKETS_SQL, features, flows, load, packets
from .sampling_queries import _F, _split
from .score_queries import _CHK


#: Bytes of the pieces in which queries write captures.
ROLL = 64 << 20


def _frames(spark, sf, hosts=65536, payload=None):
    """Packets as Ethernet frames: IPv4 with TCP or UDP, every eleventh an ARP frame of 28 zero bytes."""
    return _framed_rows(packets(spark, sf), hosts, payload).drop("file")


def _framed_rows(x, hosts=65536, payload=None):
    """Packets (flow, idx, ts_us, class) as such frames; ``file`` stays, null where there is none."""
    file = F.col("file") if "file" in x.columns else F.lit(None).cast("string").alias("file")
    x = x.withColumn("src", F.lit(167772160) + F.col("flow")).withColumn("dst", F.lit(3232235520) + F.col("idx") % hosts)
    x = x.withColumn("sport", 1024 + F.col("flow") % 5000).withColumn("dport", F.lit(443)).withColumn("proto", F.when(F.col("idx") % 2 == 0, 6).otherwise(17))
    x = x.withColumn("payload", F.encode(F.concat("class", F.lit("-"), F.col("idx").cast("string")), "UTF-8") if payload is None else payload)
    macs = F.concat(R.number(F.col("idx") % 65536 + 0x020000000000, 6), R.number(F.col("flow") % 65536 + 0x020000000000, 6))
    ip = F.concat(macs, R.number(0x0800, 2), pcap.build_packet("src", "dst", "sport", "dport", "payload"))
    data = F.when(F.col("idx") % 11 == 0, F.concat(macs, R.number(0x0806, 2), F.lit(bytes(28)))).otherwise(ip)
    return x.select("flow", "idx", "ts_us", "class", F.lit(pcap.ETHERNET).alias("link"), data.alias("data"), file)


def packet_checksums(spark, sf):
    """Frames with checksums, written as captures and read back: their IPv4 and TCP or UDP checksums."""
    path = work_path(spark, "frames")
    x = R.with_checksums(_frames(spark, sf)).withColumn("file", F.concat(F.lit("g"), (F.col("flow") % 16).cast("string"), F.lit("/"), F.col("class"), F.lit(".pcap")))
    pcap.write_captures(x, path, pcap.ETHERNET, ROLL)
    y = pcap.layers(pcap.read_captures(spark, path))
    u = lambda at: F.conv(F.hex(F.substring("data", (at + 1).cast("int"), F.lit(2))), 16, 10).cast("long")
    at = F.when(F.col("proto") == 6, F.col("l4_at") + 16).when(F.col("proto") == 17, F.col("l4_at") + 6)
    return y.select("ts_us", F.md5("data").alias("frame_md5"), F.when(F.col("ip_version") == 4, u(F.col("l3_at") + 10)).alias("ip_sum"), F.when(at.isNotNull(), u(at)).alias("l4_sum"))


def zeroize_fields(spark, sf):
    """Frames with MAC addresses, addresses, ids, ports and sequence numbers zero: their md5."""
    return R.zeroize_fields(_frames(spark, sf)).select("idx", F.md5("data").alias("frame_md5"))


def randomize_fields(spark, sf):
    """Frames with the same fields drawn by hashes: their md5."""
    return R.randomize_fields(_frames(spark, sf), ["flow", "idx"]).select("idx", F.md5("data").alias("frame_md5"))


def frame_matrix(spark, sf):
    """1600 bytes of the first five IP frames of each flow that has some."""
    return R.frame_matrix(_frames(spark, sf)).select("flow", F.md5("matrix").alias("matrix_md5"))


def ip_frames(spark, sf):
    """IP frames of every class."""
    return R.ip_only(_frames(spark, sf)).groupBy("class").agg(F.count("*").alias("frames"))


def png_roundtrip(spark, sf):
    """Matrices of pages as PNGs and back; shapes are checked."""
    p = load(spark, sf, "pages").select(F.floor(F.col("page_id") / 10).cast("long").alias("flow"), F.col("page_id").alias("idx"), F.encode("url", "UTF-8").alias("header"), F.encode("html", "UTF-8").alias("payload"))
    back = files.from_png(files.to_png(byte_matrix(p)))
    return back.select("flow", F.md5("matrix").alias("matrix_md5"), F.col("error").isNull().alias("good"))


def png_files(spark, sf):
    """Matrices of pages written as PNG files in folders by number, and read back from there."""
    path = work_path(spark, "pngs")
    p = load(spark, sf, "pages").select(F.floor(F.col("page_id") / 10).cast("long").alias("flow"), F.col("page_id").alias("idx"), F.encode("url", "UTF-8").alias("header"), F.encode("html", "UTF-8").alias("payload"))
    images = files.to_png(byte_matrix(p))
    files.write_pngs(images.select(F.concat_ws("/", (F.col("flow") % 7).cast("string"), F.concat(F.col("flow").cast("string"), F.lit(".png"))).alias("name"), "png"), path)
    back = files.from_png(files.read_pngs(spark, path))
    return back.select(F.col("flow").alias("name"), F.md5("matrix").alias("matrix_md5"), F.col("error").isNull().alias("good"))


def pixel_integrity(spark, sf):
    """Matrices that are whole, of some that are cut short or too long."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("flow"), F.encode("text", "UTF-8").alias("t"))
    cut = F.when(F.col("flow") % 3 == 0, F.substring("t", 1, 1600)).otherwise(F.substring(F.rpad("t", 1600, F.lit(bytes(1))), F.lit(1), (1600 - F.col("flow") % 2).cast("int")))
    return R.whole_matrices(d.select("flow", cut.alias("matrix"))).select("flow")


def _named(spark, sf):
    x = S.stratified_split(flows(spark, sf))
    return x.withColumn("name", F.concat(F.lit("f"), (F.col("flow_id") % 50).cast("string"), F.lit(".pcap")))


def flow_materialize(spark, sf):
    """Flows written by split and class under safe names, and read back from there."""
    path = work_path(spark, "flows")
    D.materialize_flows(_named(spark, sf), path)
    return spark.read.parquet(path).select("flow_id", "split", "class", "out_name")


def packet_materialize(spark, sf):
    """Packets written by split and class, and counted from there."""
    path = work_path(spark, "packets")
    x = S.stratified_split(flows(spark, sf)).select("class", "split", "flow_id", F.explode(F.sequence(F.lit(1), F.col("pkts"))).alias("line"))
    D.materialize_packets(x.withColumn("packet_id", F.concat_ws("-", "flow_id", "line")), path)
    return spark.read.parquet(path).groupBy("split", "class").agg(F.count("*").alias("packets"), F.count_distinct("packet_id").alias("ids"))


def subset_write_roundtrip(spark, sf):
    """Low-label subsets written by percentage; the manifest of what lies there."""
    path = work_path(spark, "subsets")
    D.write_subsets(S.low_label_subsets(flows(spark, sf).select("flow_id", "class")), path)
    return spark.read.parquet(path).groupBy(F.col("pct").cast("long").alias("pct"), "class").agg(F.count("*").alias("flows"), F.sum("flow_id").alias("ids"))


def capture_merge_cap(spark, sf):
    """One capture per class of 300 packets at most, read back: packets and their times."""
    path = work_path(spark, "merged")
    x = _frames(spark, sf)
    D.merge_captures(x, x.select("class").distinct().withColumn("target", F.lit(300).cast("long")), path)
    y = pcap.read_captures(spark, path)
    return y.groupBy(F.regexp_extract("path", r"([^/]+)\.pcap$", 1).alias("class")).agg(F.count("*").alias("packets"), F.sum("ts_us").cast("decimal(38,0)").cast("string").alias("times"))


def capture_ranges(spark, sf):
    """Frames of each class, in rolled captures that are read back by ranges of 100,000 bytes: every packet."""
    path = work_path(spark, "ranges")
    x = packets(spark, sf).select("flow", "idx", "ts_us", "class", F.concat("class", F.lit("/all.pcap")).alias("file"))
    pcap.write_captures(x, path, pcap.ETHERNET, ROLL, finish=lambda rows: R.with_checksums(_framed_rows(rows)))
    y = pcap.read_captures(spark, path, range_bytes=100_000)
    return y.select(_class_folder(), "ts_us", "orig_len", F.md5("data").alias("frame_md5"))


def session_containers(spark, sf):
    """Sessions written into containers; those of every twentieth packet are looked up by their key: their packets."""
    path = work_path(spark, "containers")
    x = C.header_features(pcap.layers(_frames(spark, sf, 7)).where("ip_version IN (4, 6)")).select("session", "idx", "ts_us", "data")
    containers.write_sessions(x, path, pcap.ETHERNET)
    keys = x.where("idx % 20 = 0").select("session")
    return containers.read_sessions(spark, path, keys).select("session", "packet", "ts_us", F.md5(F.substring("data", 35, 4)).alias("ports_md5"))


def _class_folder():
    return F.element_at(F.split("path", "/"), -2).alias("class")


def captures_if_any(spark, sf):
    """Captures are written only for classes that have packets left: which there are, and their packets."""
    path = work_path(spark, "some")
    x = _frames(spark, sf)
    x = x.where("class <> 'click' AND idx % 7 = 0").withColumn("file", F.concat("class", F.lit("/left.pcap")))
    pcap.write_captures(x, path, pcap.ETHERNET, ROLL)
    there = files.list_files(spark, path, "*.pcap", ("class",))
    n = pcap.read_captures(spark, path).groupBy(F.col("path").alias("p")).agg(F.count("*").alias("packets"))
    return there.join(n, there["path"] == n["p"]).groupBy("class").agg(F.sum("packets").alias("packets"))


def raw_packet_counts(spark, sf):
    """Records of each class's captures counted from headers; files that are none count 0."""
    path = work_path(spark, "counted")
    x = _frames(spark, sf).withColumn("file", F.concat("class", F.lit("/all.pcap")))
    pcap.write_captures(x, path, pcap.ETHERNET, ROLL)
    load(spark, sf, "region").select(F.col("r_name").alias("value")).coalesce(1).write.text(f"{path}/broken")
    return pcap.count_packets(spark, path, "*").select(_class_folder().alias("name"), "packets").groupBy("name").agg(F.sum("packets").alias("packets"))


def class_listing(spark, sf):
    """Captures in folders of two levels: listed by both, and by the last one."""
    path = work_path(spark, "tree")
    x = _frames(spark, sf).withColumn("file", F.concat(F.lit("split"), (F.col("flow") % 2).cast("string"), F.lit("/"), F.col("class"), F.when(F.col("flow") % 3 == 0, "/a.PCAP").otherwise("/b.pcap")))
    pcap.write_captures(x, path, pcap.ETHERNET)
    return files.list_files(spark, path, "*", ("split", "class"), (".pcap",)).groupBy("split", "class").agg(F.count("*").alias("captures"))


def tsv_roundtrip(spark, sf):
    """Labels and token texts as tab-separated lines and back."""
    path = work_path(spark, "tsv")
    d = load(spark, sf, "documents").select(F.length("text").alias("label"), F.md5("text").alias("a"), F.coalesce("lang", F.lit("")).alias("b"))
    files.write_tsv(d.select("label", F.concat_ws(" ", "a", "b").alias("text_a")), path)
    x = files.read_tsv(spark, path)
    return x.groupBy(F.substring_index("text_a", " ", -1).alias("lang")).agg(F.count("*").alias("rows"), F.sum(F.col("label").cast("long")).alias("labels"))


def jsonl_roundtrip(spark, sf):
    """Whole records as JSON lines and back."""
    path = work_path(spark, "jsonl")
    d = load(spark, sf, "documents").select("doc_id", "lang", "text")
    files.write_jsonl(d, path)
    return files.read_jsonl(spark, path, d.schema).select("doc_id", "lang", F.md5("text").alias("text_md5"))


def json_lists(spark, sf):
    """All conversations as files of a thousand, each an object of lists, among files that are cut short or no object: every
    item by key and position, and the files that were passed over."""
    path = work_path(spark, "lists")
    c = load(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    c = c.select(F.floor(F.col("conv_id") / 1000).alias("file"), F.concat_ws("-", "conv_id", "role").alias("key"), F.transform("x", lambda v: v["text"]).alias("v"))
    whole = c.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "v")))).alias("value"))
    r = load(spark, sf, "region")
    bad = r.select((-1 - F.col("r_regionkey")).alias("file"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit('{"cut": ["'), "r_name", F.lit('", "'))).otherwise(F.concat(F.lit('["'), "r_name", F.lit('"]'))).alias("value"))
    day = F.concat(F.lit("day"), F.pmod("file", F.lit(7)).cast("string")).alias("day")
    whole.unionByName(bad).select("value", day).write.partitionBy("day").option("maxRecordsPerFile", 1).text(path)
    items, errors = jsonlists.scan_json_lists(spark, path, "*.txt")
    text = F.get(F.from_json(F.concat(F.lit("["), "item", F.lit("]")), "array<string>"), F.lit(0))
    items = jsonlists.merged_items(items).select("key", F.col("pos").cast("long").alias("pos"), F.md5(text).alias("item_md5"))
    kind = F.when(F.contains("error", F.lit("too early")) | F.contains("error", F.lit("no JSON")), "cut short").otherwise("no object").alias("key")
    return items.unionByName(errors.groupBy(kind).agg(F.count("*").alias("pos")).withColumn("item_md5", F.lit(None).cast("string")))


def zip_report(spark, sf):
    """Turns of conversations as headers and payloads: pairs attempted, and produced where the header is an object."""
    c = load(spark, sf, "conversations")
    kind = F.when(F.col("turn") % 5 == 0, F.to_json(F.struct("text"))).when(F.col("turn") % 5 == 1, F.to_json(F.array("text"))).when(F.col("turn") % 5 == 2, F.concat(F.lit('"{\'turn\': \''), F.col("turn").cast("string"), F.lit('\'}"')))
    place = (F.row_number().over(W.partitionBy("folder", "key").orderBy("turn")) - 1).cast("long").alias("pos")
    x = c.withColumn("folder", F.concat(F.lit("f"), (F.col("conv_id") % 5).cast("string"))).withColumn("key", F.col("conv_id").cast("string"))
    side = lambda role, item: x.where(F.col("role") == role).select("folder", "key", place, item.alias("item"))
    return jsonlists.pair_counts(jsonlists.zip_items(side("user", F.coalesce(kind, F.lit("7"))), side("assistant", F.to_json(F.array("text")))))


def dataset_manifest(spark, sf):
    """Flows with their split written as one committed dataset: what its manifest, its records and its lists say of each class."""
    path = work_path(spark, "dataset")
    manifest.write_split(S.stratified_split(flows(spark, sf)), path)
    stats = [(s, c, n) for s, d in manifest.read_manifest(path)["stats"]["label_dist"].items() for c, n in d.items()]
    told = spark.createDataFrame(stats, "split string, class string, told long")
    records = manifest.read_split(spark, path, "flow_id long, class string, split string, path string")
    n = records.groupBy("split", "class").agg(F.count("*").alias("records"), F.sum("flow_id").alias("ids"))
    lists = None
    for s in manifest.SPLITS:
        one = manifest.read_list(spark, path, s).groupBy(F.lit(s).alias("split"), F.substring_index("path", "/", 1).alias("class")).agg(F.count("*").alias("listed"))
        lists = one if lists is None else lists.unionByName(one)
    good = manifest.checked(spark, path).agg(F.min("ok").alias("good"))
    x = told.join(n, ["split", "class"], "left").join(lists, ["split", "class"], "left").crossJoin(good)  # one row
    return x.select("split", "class", "told", "records", "ids", "listed", "good")


def index_join_by_row(spark, sf):
    """Orders joined to customers by their row numbers."""
    o, c = load(spark, sf, "orders").select("o_orderkey"), load(spark, sf, "customer").select("c_custkey")
    return D.join_by_row(o, c, "o_orderkey", "c_custkey").select("row", "o_orderkey", "c_custkey")


def index_join_by_name(spark, sf):
    """Nations joined to the last customer of theirs."""
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("name"), "n_name")
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("name"), "c_custkey", "c_mktsegment")
    return D.join_by_name(n, c, "name", "c_custkey").select("name", "n_name", "c_custkey", "c_mktsegment")


def png_index_join(spark, sf):
    """Images joined to index rows on their path, either separator."""
    d = load(spark, sf, "documents").select("doc_id", "lang")
    images = d.select("doc_id", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"))
    sep = F.when(F.col("doc_id") % 3 == 0, "\\").otherwise("/")
    index = d.where("doc_id % 5 <> 0").select(F.concat("lang", sep, F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") * 2).alias("record"))
    return D.join_by_path(images, index).select("doc_id", "record")


def png_source_lookup(spark, sf):
    """The capture that each image comes from, .pcap before .pcapng."""
    d = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("stem"), "doc_id")
    a = d.where("doc_id % 3 = 0").select("stem", F.lit(".pcap").alias("ending"))
    b = d.where("doc_id % 2 = 0").select("stem", F.lit(".PCAPNG").alias("ending"))
    captures = a.unionByName(b).withColumn("capture", F.concat("stem", "ending"))
    return D.source_capture(d, captures).select("doc_id", "capture")


def random_packets(spark, sf):
    """Three random packets of every flow, in the order drawn."""
    return D.random_packets(packets(spark, sf), 3).select("flow", "idx", "draw")


def random_ids(spark, sf):
    """A hundredth of all documents' ids, rounded up."""
    return D.random_ids(load(spark, sf, "documents"), "doc_id", ratio=0.01)


def dataset_roots(spark, sf):
    """Two roots (documents and pages) as one table with a tag."""
    a = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("class"))
    b = load(spark, sf, "pages").select(F.col("page_id").alias("id"))
    return D.dataset_roots(spark, {"text": a, "web": b}).groupBy("dataset", "class").agg(F.count("*").alias("rows"))


def column_intersection(spark, sf):
    """Columns that real and generated tables have in common, and their values."""
    a, b = load(spark, sf, "orders"), load(spark, sf, "orders").drop("o_orderdate").withColumn("extra", F.lit(1))
    names = D.common_columns(a.select("o_orderkey", "o_orderdate", "o_custkey"), b)
    return a.select(*names)


def diversity_means(spark, sf):
    """Means of entropy, coverage and novelty over the categorical features."""
    return M.diversity_means(features(spark, sf), "side", CATEGORICAL).select(*[F.round(c, 8).alias(c) for c in ("entropy_real", "entropy_gen", "coverage", "novelty")])


def outcome_report(spark, sf):
    """Header rows attempted and produced, and errors by class with OTHER."""
    from ..operators import genjson as G
    from .score_queries import _dirty

    return G.outcome_report(G.checked_headers(_dirty(spark, sf)))


def percent_strings(spark, sf):
    """Shares of the classes as percent strings of two decimals."""
    return M.percent_strings(M.per_class_share(flows(spark, sf), "class")).select("class", "percent")


def _h(e, n):
    return f"lpad(lower(to_hex(({e})::BIGINT)), {2 * n}, '0')"


def _sum(h):
    return f"coalesce(list_sum(list_transform(range(0, (length({h}) + 3) // 4), lambda i: ('0x' || rpad(substring({h}, (i * 4 + 1)::BIGINT, 4), 4, '0'))::BIGINT)), 0)::BIGINT"


def _fold(e):
    t = f"(({e}) % 65536 + ({e}) // 65536)"
    return f"(65535 - ({t} % 65536 + {t} // 65536))"


def _framed(mac, src, dst, ident, sport, dport, seq, ack, body="lower(hex(encode(class || '-' || idx)))"):
    """CTEs g (fields as hex) and w (frames with checksums): flow, idx, ts_us, class, eth, ip, l4, body, is_ip."""
    return f"""g AS MATERIALIZED (SELECT *, idx % 11 <> 0 AS is_ip, idx % 2 = 0 AS tcp, {body} AS body, {mac[0]} || {mac[1]} AS macs, {src} AS sip, {dst} AS dip, {ident} AS ident, {sport} || {dport} AS ports, {seq} || {ack} AS nums FROM ({PACKETS_SQL})),
b AS (SELECT *, length(body) // 2 AS n, '4500' || {_h('CASE WHEN tcp THEN 40 ELSE 28 END + length(body) // 2', 2)} || ident || '0000' || '40' || CASE WHEN tcp THEN '06' ELSE '11' END AS ip1, sip || dip AS ip2,
 ports || CASE WHEN tcp THEN nums || '50182000' ELSE {_h('8 + length(body) // 2', 2)} END AS l1, CASE WHEN tcp THEN '0000' ELSE '' END AS l2 FROM g),
c AS (SELECT *, {_sum("(ip1 || ip2)")} AS s1, {_sum("(ip2 || l1 || l2 || body)")} + CASE WHEN tcp THEN 6 + 20 ELSE 17 + 8 END + n AS s2 FROM b),
k AS (SELECT *, {_fold('s1')} AS ip_sum, CASE WHEN NOT tcp AND {_fold('s2')} = 0 THEN 65535 ELSE {_fold('s2')} END AS l4_sum FROM c),
w AS MATERIALIZED (SELECT *, CASE WHEN is_ip THEN macs || '0800' || ip1 || {_h('ip_sum', 2)} || ip2 || l1 || {_h('l4_sum', 2)} || l2 ELSE macs || '0806' || repeat('00', 28) END AS head, CASE WHEN is_ip THEN body ELSE '' END AS load FROM k)"""


_NULLS = ("'000000000000'", "'000000000000'"), "'00000000'", "'00000000'", "'0000'", "'0000'", "'0000'", "'00000000'", "'00000000'"
_PLAIN = _framed((_h("idx % 65536 + 2199023255552", 6), _h("flow % 65536 + 2199023255552", 6)), _h("167772160 + flow", 4), _h("3232235520 + idx % 65536", 4), "'0000'", _h("1024 + flow % 5000", 2), "'01bb'", "'00000000'", "'00000000'")
_ZERO = _framed(*_NULLS)
_D = lambda f, n: f"substr(md5('{f}42|' || flow || '|' || idx), 1, {2 * n})"
_DRAWN = (f"('0200' || {_D('mac_dst', 4)})", f"('0200' || {_D('mac_src', 4)})"), _D("src", 4), _D("dst", 4), _D("ip_id", 2), _D("sport", 2), _D("dport", 2), _D("seq", 4), _D("ack", 4)
_RANDOM = _framed(*_DRAWN)
_FREQ = f"f AS MATERIALIZED (SELECT * FROM ({FEATURES_SQL}) UNPIVOT (value FOR feature IN ({', '.join(CATEGORICAL)})))"
SQL = {
    "packet_checksums": f"WITH {_PLAIN} SELECT ts_us, md5(unhex(head || load)) AS frame_md5, CASE WHEN is_ip THEN ip_sum END AS ip_sum, CASE WHEN is_ip THEN l4_sum END AS l4_sum FROM w",
    "zeroize_fields": f"WITH {_ZERO} SELECT idx, md5(unhex(head || load)) AS frame_md5 FROM w",
    "randomize_fields": f"WITH {_RANDOM} SELECT idx, md5(unhex(head || load)) AS frame_md5 FROM w",
    "frame_matrix": f"""WITH {_PLAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY idx) AS r FROM w WHERE is_ip)
SELECT flow, md5(unhex(rpad(string_agg(rpad(substring(head, 1, 160), 160, '0') || rpad(substring(load, 1, 480), 480, '0'), '' ORDER BY r), 3200, '0'))) AS matrix_md5 FROM r WHERE r <= 5 GROUP BY flow""",
    "ip_frames": f"SELECT class, count(*) AS frames FROM ({PACKETS_SQL}) WHERE idx % 11 <> 0 GROUP BY class",
    "png_roundtrip": """SELECT flow, md5(unhex(rpad(string_agg(rpad(substring(lower(hex(encode(url))), 1, 160), 160, '0') || rpad(substring(lower(hex(encode(html))), 1, 480), 480, '0'), '' ORDER BY page_id), 3200, '0'))) AS matrix_md5, true AS good
FROM (SELECT *, page_id // 10 AS flow, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS r FROM pages) WHERE r <= 5 GROUP BY flow""",
    "png_files": """SELECT (flow % 7) || '/' || flow || '.png' AS name, md5(unhex(rpad(string_agg(rpad(substring(lower(hex(encode(url))), 1, 160), 160, '0') || rpad(substring(lower(hex(encode(html))), 1, 480), 480, '0'), '' ORDER BY page_id), 3200, '0'))) AS matrix_md5, true AS good
FROM (SELECT *, page_id // 10 AS flow, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS r FROM pages) WHERE r <= 5 GROUP BY flow""",
    "pixel_integrity": "SELECT doc_id AS flow FROM documents WHERE CASE WHEN doc_id % 3 = 0 THEN strlen(text) >= 1600 ELSE doc_id % 2 = 0 END",
    "flow_materialize": f"""WITH {_F}, {_split('s', 'f')} SELECT flow_id, split, class, CASE WHEN row_number() OVER (PARTITION BY split, class, flow_id % 50 ORDER BY path) > 1 THEN 'f' || flow_id % 50 || '_h' || substr(sha1(path), 1, 8) || '.pcap' ELSE 'f' || flow_id % 50 || '.pcap' END AS out_name FROM s""",
    "packet_materialize": f"WITH {_F}, {_split('s', 'f')} SELECT split, class, sum(pkts)::BIGINT AS packets, sum(pkts)::BIGINT AS ids FROM s GROUP BY split, class",
    "subset_write_roundtrip": f"""SELECT pct, class, count(*) AS flows, sum(flow_id)::BIGINT AS ids FROM (SELECT flow_id, class, pct::BIGINT AS pct, count(*) OVER (PARTITION BY class, pct) AS n, row_number() OVER (PARTITION BY class, pct ORDER BY md5('42|' || pct || '|' || flow_id), pct || '|' || flow_id) AS rk
FROM ({FLOWS_SQL}), unnest([1, 5, 10, 20, 50, 75]) u(pct)) WHERE rk <= greatest(1, round_even(n * pct / 100.0::DOUBLE, 0)) GROUP BY pct, class""",
    "capture_merge_cap": f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY class, flow) AS pkts, row_number() OVER (PARTITION BY class, flow ORDER BY idx) AS place FROM ({PACKETS_SQL})),
f AS (SELECT class, flow, coalesce(sum(pkts) OVER (PARTITION BY class ORDER BY md5('merge42|' || flow), flow ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT DISTINCT class, flow, pkts FROM p))
SELECT class, count(*) AS packets, sum(ts_us)::VARCHAR AS times FROM p JOIN f USING (class, flow) WHERE before + place <= 300 GROUP BY class""",
    "capture_ranges": f"WITH {_PLAIN} SELECT class, ts_us, length(head || load) // 2 AS orig_len, md5(unhex(head || load)) AS frame_md5 FROM w",
    "session_containers": f"""WITH p AS (SELECT idx, ts_us, (1024 + flow % 5000) AS sport, concat_ws('-', CASE WHEN idx % 2 = 0 THEN 'tcp' ELSE 'udp' END, (167772160 + flow) || ':' || (1024 + flow % 5000), (3232235520 + idx % 7) || ':443') AS session FROM ({PACKETS_SQL}) WHERE idx % 11 <> 0)
SELECT session, row_number() OVER (PARTITION BY session ORDER BY idx) - 1 AS packet, ts_us, md5(unhex({_h('sport', 2)} || '01bb')) AS ports_md5 FROM p WHERE session IN (SELECT session FROM p WHERE idx % 20 = 0)""",
    "captures_if_any": f"SELECT class, count(*) AS packets FROM ({PACKETS_SQL}) WHERE class <> 'click' AND idx % 7 = 0 GROUP BY class",
    "raw_packet_counts": f"SELECT class AS name, count(*) AS packets FROM ({PACKETS_SQL}) GROUP BY class UNION ALL SELECT 'broken', 0",
    "class_listing": f"SELECT 'split' || flow % 2 AS split, class, count(DISTINCT flow % 3 = 0) AS captures FROM ({PACKETS_SQL}) GROUP BY 1, 2",
    "tsv_roundtrip": "SELECT coalesce(lang, '') AS lang, count(*) AS rows, sum(length(text))::BIGINT AS labels FROM documents GROUP BY 1",
    "jsonl_roundtrip": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "json_lists": """SELECT conv_id || '-' || role AS key, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1 AS pos, md5(text) AS item_md5 FROM conversations
UNION ALL SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'cut short' ELSE 'no object' END, count(*), NULL FROM region GROUP BY 1""",
    "zip_report": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS pos FROM conversations)
SELECT 'f' || h.conv_id % 5 AS folder, count(*) AS attempted, count(*) FILTER (h.turn % 5 IN (0, 2)) AS produced FROM c h JOIN c p ON h.conv_id = p.conv_id AND h.pos = p.pos WHERE h.role = 'user' AND p.role = 'assistant' GROUP BY 1""",
    "dataset_manifest": f"""WITH {_F}, {_split('s', 'f')}, n AS (SELECT split, class, count(*) AS n, sum(flow_id)::BIGINT AS ids FROM s GROUP BY split, class)
SELECT split, class, n AS told, n AS records, ids, n AS listed, true AS good FROM n UNION ALL SELECT 'class_total', class, sum(n)::BIGINT, NULL, NULL, NULL, true FROM n GROUP BY class""",
    "index_join_by_row": "SELECT row, o_orderkey, c_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM customer) USING (row)",
    "index_join_by_name": "SELECT n_nationkey AS name, n_name, c_custkey, c_mktsegment FROM nation JOIN (SELECT c_nationkey, max(c_custkey) AS c_custkey, arg_max(c_mktsegment, c_custkey) AS c_mktsegment FROM customer GROUP BY 1) ON n_nationkey = c_nationkey",
    "png_index_join": "SELECT doc_id, doc_id * 2 AS record FROM documents WHERE doc_id % 5 <> 0",
    "png_source_lookup": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id || '.pcap' WHEN doc_id % 2 = 0 THEN doc_id || '.PCAPNG' END AS capture FROM documents",
    "random_packets": f"SELECT flow, idx, draw FROM (SELECT flow, idx, row_number() OVER (PARTITION BY flow ORDER BY md5('random42|' || flow || '|' || idx), idx) AS draw FROM ({PACKETS_SQL})) WHERE draw <= 3",
    "random_ids": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('ids42|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= ceil(n * 0.01::DOUBLE)",
    "dataset_roots": "SELECT 'text' AS dataset, lang AS class, count(*) AS rows FROM documents GROUP BY lang UNION ALL SELECT 'web', NULL, count(*) FROM pages",
    "column_intersection": "SELECT o_orderkey, o_custkey FROM orders",
    "diversity_means": f"""WITH {_FREQ}, c AS (SELECT feature, value, count(*) FILTER (side = 'real')::DOUBLE AS r, count(*) FILTER (side = 'gen')::DOUBLE AS g FROM f GROUP BY 1, 2), t AS (SELECT *, sum(r) OVER w AS rn, sum(g) OVER w AS gn FROM c WINDOW w AS (PARTITION BY feature)),
e AS (SELECT feature, -sum(CASE WHEN r > 0 THEN r / rn * ln(r / rn) ELSE 0 END) AS er, -sum(CASE WHEN g > 0 THEN g / gn * ln(g / gn) ELSE 0 END) AS eg, count(*) FILTER (r > 0 AND g > 0) / count(*) FILTER (r > 0) AS cov, count(*) FILTER (g > 0 AND r = 0) / count(*) FILTER (g > 0) AS nov FROM t GROUP BY feature)
SELECT round(avg(er), 8) AS entropy_real, round(avg(eg), 8) AS entropy_gen, round(avg(cov), 8) AS coverage, round(avg(nov), 8) AS novelty FROM e""",
    "outcome_report": f"""WITH {_CHK}, n AS (SELECT coalesce(error, 'OK') AS outcome, count(*) AS rows FROM e GROUP BY 1)
SELECT * FROM n UNION ALL SELECT 'OTHER', 0 UNION ALL SELECT 'ATTEMPTED', count(*) FROM e UNION ALL SELECT 'PRODUCED', count(*) FROM e WHERE error IS NULL""",
    "percent_strings": "SELECT lang AS class, printf('%.2f%%', round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6)) AS percent FROM documents GROUP BY lang",
}
QUERIES = {
    f.__name__: f
    for f in (
        packet_checksums, zeroize_fields, randomize_fields, frame_matrix, ip_frames, png_roundtrip, png_files, pixel_integrity, flow_materialize, packet_materialize, subset_write_roundtrip,
        capture_merge_cap, capture_ranges, session_containers, captures_if_any, raw_packet_counts, class_listing, tsv_roundtrip, jsonl_roundtrip, json_lists, zip_report, dataset_manifest, index_join_by_row, index_join_by_name, png_index_join,
        png_source_lookup, random_packets, random_ids, dataset_roots, column_intersection, diversity_means, outcome_report, percent_strings,
    )
}
