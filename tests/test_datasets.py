"""Committed datasets and JSON lists that may be broken."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F
from spindrift.sources import jsonlists as J
from spindrift.sources import manifest as M


def rows(n=200):
    return [(M.SPLITS[i * i % 3], f"c{i % 5}", f"c{i % 5}/f{i}.pcap", i, "é\n" if i % 7 else None) for i in range(n)]


FIELDS = "split string, class string, path string, n long, note string"


def tree(path):
    return sorted(os.path.relpath(f, path) for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f))


def test_round_trip(spark, tmp_path):
    df, path = spark.createDataFrame(rows(), FIELDS).repartition(4), str(tmp_path / "d")
    M.write_split(df, path, 7)
    m = M.read_manifest(path)
    assert m["seed"] == "7" and m["stats"]["counts"]["total"] == 200 and sum(m["stats"]["label_dist"]["class_total"].values()) == 200
    assert tree(path) == sorted([M.MANIFEST, *(f["file"] for f in m["files"])])  # nothing else is left
    assert M.read_split(spark, path, df.schema).exceptAll(df).isEmpty() and M.read_split(spark, path, df.schema).count() == 200
    for s in M.SPLITS:
        assert sorted(r["path"] for r in M.read_list(spark, path, s).collect()) == sorted(r[2] for r in rows() if r[0] == s)
        assert m["stats"]["counts"][s] == sum(r[0] == s for r in rows())
    assert {r["ok"] for r in M.checked(spark, path).collect()} == {True}
    with open(f"{path}/{m['files'][0]['file']}", "a") as f:
        f.write("more")
    assert [r["file"] for r in M.checked(spark, path).collect() if not r["ok"]] == [m["files"][0]["file"]]


def writer(spark, path):
    return M.SplitWriter(spark.createDataFrame([], FIELDS).schema, {"path": str(path)})


def test_a_task_that_ran_twice_counts_once(spark, tmp_path):
    """Whether a task fails half way and runs again, or runs twice: the manifest is the same."""

    def half():
        yield from rows(50)
        raise RuntimeError("lost")

    w = writer(spark, tmp_path / "a")
    w.commit([w.write(iter(rows()))])
    again = writer(spark, tmp_path / "b")
    with pytest.raises(RuntimeError):
        again.write(half())
    assert tree(tmp_path / "b") == []
    again.write(iter(rows()))  # its message never reached the driver
    again.commit([again.write(iter(rows())), None])
    assert M.read_manifest(str(tmp_path / "a")) == M.read_manifest(str(tmp_path / "b")) and tree(tmp_path / "a") == tree(tmp_path / "b")


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    w = writer(spark, tmp_path / "a")
    w.abort([w.write(iter(rows())), None])
    assert tree(tmp_path / "a") == []
    with pytest.raises(Exception):
        bad = spark.createDataFrame(rows(), FIELDS).withColumn("note", F.when(F.col("n") == 150, F.raise_error(F.lit("bad"))).otherwise(F.col("note")))
        M.write_split(bad, str(tmp_path / "b"))
    assert tree(tmp_path / "b") == []


def test_columns_and_empty_tables(spark, tmp_path):
    with pytest.raises(Exception, match="needs the columns class, path"):
        M.write_split(spark.createDataFrame([("train",)], "split string"), str(tmp_path / "a"))
    M.write_split(spark.createDataFrame([], FIELDS), str(tmp_path / "b"))
    assert M.read_manifest(str(tmp_path / "b"))["stats"]["counts"] == {"train": 0, "valid": 0, "test": 0, "total": 0}
    assert M.read_split(spark, str(tmp_path / "b"), FIELDS).count() == 0 == M.read_list(spark, str(tmp_path / "b"), "train").count()


VALUES = {"a": [1, 2.5, -3e10, None, True, "x", "é\n\"", {"k": [1, {"z": "]"}]}, [], [[1], "y"]], "b": [], "c": "alone", "": [""], "d": 12}


def read(text, size):
    return list(J.items_of(iter([text[i : i + size] for i in range(0, len(text), size)])))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_items_whatever_the_pieces(size, indent):
    text = json.dumps(VALUES, indent=indent) + "\n "
    got = {}
    for key, turn, pos, listed, item in read(text, size):
        got.setdefault(key, [] if listed else None)
        if not listed:
            got[key] = json.loads(item)
        elif pos >= 0:
            assert pos == len(got[key])
            got[key].append(json.loads(item))
    assert got == VALUES and read("{}", size) == [] and read(" { } ", size) == []


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_whatever_is_cut_off_is_an_error(size):
    text = json.dumps({"a": [1, "x", {"b": [2]}], "c": []})
    for n in range(len(text)):
        with pytest.raises(ValueError):
            read(text[:n], size)
    for bad in ("[1]", "1", '"x"', "{} {}", '{"a": [1,]}', '{"a": [1 2]}', '{"a" [1]}', "{1: [2]}", '{"a": [1],}', '{"a": nope}', "null"):
        with pytest.raises(ValueError):
            read(bad, size)


def test_a_long_list_passes_through_a_small_window():
    most = 0

    def chunks():
        nonlocal most
        yield '{"a": ['
        for i in range(20_000):
            most = max(most, len(t.body))
            yield f'{"," if i else ""}"{"x" * 50}{i}"'
        yield "]}"

    t = J._Text(iter(()))
    made = J._Text
    try:
        J._Text = lambda c: (setattr(t, "chunks", c), t)[1]
        assert sum(1 for _ in J.items_of(chunks())) == 20_000 and most < 1000
    finally:
        J._Text = made


def test_bad_files_cost_only_themselves(spark, tmp_path):
    files = {
        "one/a.json": json.dumps({"k": [1, {"h": 2}], "again": [1]}), "one/b.json": '{"k": ["x"], "again": ["first", "time"], "again": ["last"]}', "two/a.json": json.dumps({"k": [], "e": "alone"}),
        "one/cut.json": '{"k": [1, 2, ', "one/list.json": "[1, 2]", "two/bytes.json": b'{"k": ["\xff"]}', "two/junk.json": "junk", "two/other.txt": "not asked for",
    }
    for name, text in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    items, errors = J.scan_json_lists(spark, str(tmp_path))
    assert sorted((r["folder"], r["file"].rpartition("/")[2]) for r in errors.collect()) == [("one", "cut.json"), ("one", "list.json"), ("two", "bytes.json"), ("two", "junk.json")]
    got = sorted((r["folder"], r["key"], r["pos"], r["item"]) for r in J.merged_items(items).collect())
    assert got == [("one", "again", 0, "1"), ("one", "again", 1, '"last"'), ("one", "k", 0, "1"), ("one", "k", 1, '{"h": 2}'), ("one", "k", 2, '"x"'), ("two", "e", 0, '"alone"')]


def test_zip_counts_what_was_attempted(spark):
    heads = ['{"a": 1}', '"{\'a\': \'1\'}"', "[1]", "7", "null", '"plain"', '"{broken"', "{}"]
    h = spark.createDataFrame([("f", "k", i, x) for i, x in enumerate(heads)] + [("g", "k", 0, "1")], "folder string, key string, pos long, item string")
    p = spark.createDataFrame([("f", "k", i, f'"{i}"') for i in range(12)] + [("g", "k", 0, "2"), ("g", "other", 0, "2")], "folder string, key string, pos long, item string")
    x = J.zip_items(h, p)
    assert sorted(r["pos"] for r in x.where("good").collect()) == [0, 1, 7]
    assert sorted(map(tuple, J.pair_counts(x).collect())) == [("f", 8, 3), ("g", 1, 0)]
