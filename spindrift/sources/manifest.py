"""Split datasets whose lists, records and counts are committed at once: ``df.write.format("split_dataset")``.

Each task writes its rows as JSON lines and, split by split, as lists of paths, under names of its own. With its commit
it tells the driver what it wrote: files, rows, bytes, checksums, and rows by split and class. When all tasks are done
the driver gives the files their names and writes one manifest by a rename; what the manifest doesn't name isn't part of the dataset.
A task that fails deletes its files, a job that fails deletes those of all tasks, and a task that ran twice is in
the manifest once, with the same names, counts and checksums.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .pcap import store

SPLITS = ("train", "valid", "test")
MANIFEST = "manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """One task's files as (temporary name, name, rows, bytes, crc32), and its rows by (split, class)."""

    files: list
    counts: dict


class _Open:
    """A file being written, with its rows, bytes and checksum."""

    def __init__(self, files, root: str, temporary: str, name: str):
        self.temporary, self.name, self.rows, self.bytes, self.crc = temporary, name, 0, 0, 0
        files.create_dir(f"{root}/{temporary}".rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(f"{root}/{temporary}")

    def line(self, text: str) -> None:
        data = (text + "\n").encode()
        self.out.write(data)
        self.rows, self.bytes, self.crc = self.rows + 1, self.bytes + len(data), zlib.crc32(data, self.crc)

    def told(self) -> tuple:
        self.out.close()
        return self.temporary, self.name, self.rows, self.bytes, self.crc


class SplitWriter(DataSourceWriter):
    """Rows need ``split``, ``class`` and ``path``; all columns go into the records."""

    def __init__(self, schema, options):
        self.names, self.path, self.seed = schema.names, options["path"].rstrip("/"), options.get("seed", "42")
        missing = {"split", "class", "path"} - set(self.names)
        if missing:
            raise ValueError(f"a split dataset needs the columns {', '.join(sorted(missing))}")

    def write(self, rows):
        from pyspark import TaskContext

        files, root = store(self.path)
        context = TaskContext.get()
        part, mark = context.partitionId() if context else 0, uuid.uuid4().hex[:12]
        made: dict[str, _Open] = {}
        counts: dict[tuple, int] = {}

        def opened(folder: str, ending: str) -> _Open:
            if folder not in made:
                made[folder] = _Open(files, root, f"_writing/{mark}/{folder}.{ending}", f"{folder}/part-{part:05d}.{ending}")
            return made[folder]

        try:
            for r in rows:
                record = dict(zip(self.names, r, strict=True))
                opened("records", "jsonl").line(json.dumps(record, ensure_ascii=False, default=str))
                opened(f"lists/{record['split']}", "txt").line(str(record["path"]))
                key = record["split"], record["class"]
                counts[key] = counts.get(key, 0) + 1
            return Written([f.told() for f in made.values()], counts)
        except BaseException:
            for f in made.values():
                f.out.close()
            _gone(files, f"{root}/_writing/{mark}")
            raise

    def commit(self, messages):
        files, root = store(self.path)
        listed, counts = [], {}
        for m in messages:
            if m is None:
                continue
            for temporary, name, rows, size, crc in m.files:
                files.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                files.move(f"{root}/{temporary}", f"{root}/{name}")
                listed.append({"file": name, "rows": rows, "bytes": size, "crc32": crc})
            for key, n in m.counts.items():
                counts[key] = counts.get(key, 0) + n
        manifest = {"seed": self.seed, "files": sorted(listed, key=lambda f: f["file"]), "stats": stats_of(counts)}
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/_{MANIFEST}") as f:
            f.write(json.dumps(manifest, indent=1, ensure_ascii=False).encode())
        files.move(f"{root}/_{MANIFEST}", f"{root}/{MANIFEST}")
        _gone(files, f"{root}/_writing")

    def abort(self, messages):
        files, root = store(self.path)
        _gone(files, f"{root}/_writing")


def _gone(files, folder: str) -> None:
    from pyarrow import fs

    if files.get_file_info(folder).type == fs.FileType.Directory:
        files.delete_dir(folder)


def stats_of(counts: dict[tuple, int]) -> dict:
    """Rows by split and in total, by split and class, and by class."""
    by_split = {s: sum(n for (x, _), n in counts.items() if x == s) for s in dict.fromkeys([*SPLITS, *sorted({str(x) for x, _ in counts})])}
    dist = {s: {str(c): n for (x, c), n in sorted(counts.items(), key=str) if x == s} for s in by_split}
    total: dict[str, int] = {}
    for (_, c), n in counts.items():
        total[str(c)] = total.get(str(c), 0) + n
    return {"counts": by_split | {"total": sum(counts.values())}, "label_dist": dist | {"class_total": dict(sorted(total.items()))}}


class SplitDataset(DataSource):
    @classmethod
    def name(cls):
        return "split_dataset"

    def writer(self, schema, overwrite):
        return SplitWriter(schema, self.options)


def write_split(rows: DataFrame, path: str, seed: int = 42) -> None:
    """Rows (split, class, path, ...) as a dataset under the new folder ``path``. The driver holds one entry for each file (a
    task writes four at most) and the counts of each class."""
    rows.sparkSession.dataSource.register(SplitDataset)
    rows.write.format("split_dataset").option("seed", seed).mode("append").save(path)


def read_manifest(path: str) -> dict:
    files, root = store(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_split(spark: SparkSession, path: str, schema, split: str | None = None) -> DataFrame:
    """The records of the files that the manifest names."""
    found = [f"{path.rstrip('/')}/{f['file']}" for f in read_manifest(path)["files"] if f["file"].startswith("records/")]
    rows = spark.read.schema(schema).json(found) if found else spark.createDataFrame([], schema)
    return rows if split is None else rows.where(F.col("split") == split)


def read_list(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(path) of one split's list."""
    found = [f"{path.rstrip('/')}/{f['file']}" for f in read_manifest(path)["files"] if f["file"].startswith(f"lists/{split}/")]
    return (spark.read.text(found) if found else spark.createDataFrame([], "value string")).select(F.col("value").alias("path"))


def checked(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, ok): whether each file is there with the rows, bytes and checksum that the manifest tells; read in tasks."""
    import pyarrow as pa

    listed = [(f["file"], f["rows"], f["bytes"], f["crc32"]) for f in read_manifest(path)["files"]]
    given = spark.createDataFrame(listed, "file string, rows long, bytes long, crc32 long").repartition(max(1, min(len(listed), spark.sparkContext.defaultParallelism * 4)))

    def look(name):
        files, root = store(path)
        n = size = crc = 0
        try:
            with files.open_input_stream(f"{root}/{name}") as f:
                while piece := f.read(1 << 20):
                    n, size, crc = n + piece.count(b"\n"), size + len(piece), zlib.crc32(piece, crc)
        except OSError:
            return None
        return n, size, crc

    def run(batches):
        for b in batches:
            ok = [look(name) == tuple(rest) for name, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], names=["file", "rows", "ok"])

    return given.mapInArrow(run, "file string, rows long, ok boolean")
