"""Objects of lists in JSON files of any size, item by item; a file that is no such object costs only itself."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import by_ranges, opened

#: Characters read at a time, and items handed on at a time.
CHUNK, BATCH = 1 << 20, 4096
_BLANK = re.compile(r"[ \t\r\n]*")
#: First characters of values whose end is known from themselves, and what may follow a number.
_NOT_NUMBER, _AFTER = '"[{tfn', tuple(",]} \t\r\n")


class _Text:
    """A file's text through a window that moves on as it is read."""

    def __init__(self, chunks: Iterator[str]):
        self.chunks, self.body, self.at, self.ended = chunks, "", 0, False

    def more(self) -> bool:
        piece = next(self.chunks, None)
        if piece is None:
            self.ended = True
            return False
        self.body, self.at = self.body[self.at :] + piece, 0
        return True

    def peek(self) -> str:
        """The next character that isn't blank, '' at the end."""
        while True:
            self.at = _BLANK.match(self.body, self.at).end()
            if self.at < len(self.body):
                return self.body[self.at]
            if not self.more():
                return ""

    def take(self, char: str) -> None:
        if (found := self.peek()) != char:
            raise ValueError(f"{char!r} expected, not {found!r}" if found else "the file ends too early")
        self.at += 1

    def value(self):
        """The JSON value that comes next; the window grows until it's whole."""
        first = self.peek()
        if not first:
            raise ValueError("the file ends too early")
        while True:
            try:
                found, end = _DECODER.raw_decode(self.body, self.at)
            except ValueError as e:
                broken = e
            else:
                if first in _NOT_NUMBER or self.ended or self.body[end : end + 1] in _AFTER:
                    self.at = end
                    return found
                broken = None  # a number may go on
            want = 2 * (len(self.body) - self.at)  # twice as much each time: a value is parsed few times
            grown = self.more()
            while grown and len(self.body) < want:
                grown = self.more()
            if not grown and broken is not None:
                try:
                    found, self.at = _DECODER.raw_decode(self.body, self.at)
                except ValueError as e:
                    raise ValueError(f"no JSON value: {e}") from None
                return found


_DECODER = json.JSONDecoder()


def items_of(chunks: Iterator[str]) -> Iterator[tuple[str, int, int, bool, str]]:
    """(key, turn, position, listed, item as JSON) of an object of lists; a value that is no list is one item, not ``listed``.
    An empty list is one row at position -1 without an item. Turn numbers the keys, as a key may come again. Raises ValueError
    where the text isn't one object."""
    t = _Text(chunks)
    t.take("{")
    turn = 0
    if t.peek() == "}":
        t.at += 1
    else:
        while True:
            key = t.value()
            if not isinstance(key, str):
                raise ValueError("a key is no string")
            t.take(":")
            if t.peek() != "[":
                yield key, turn, 0, False, json.dumps(t.value(), ensure_ascii=False)
            else:
                t.at += 1
                n = 0
                if t.peek() == "]":
                    yield key, turn, -1, True, None
                else:
                    while True:
                        yield key, turn, n, True, json.dumps(t.value(), ensure_ascii=False)
                        n += 1
                        if t.peek() != ",":
                            break
                        t.at += 1
                t.take("]")
            turn += 1
            if t.peek() != ",":
                break
            t.at += 1
        t.take("}")
    if t.peek():
        raise ValueError("something follows the object")


def _chunks(path: str) -> Iterator[str]:
    """A UTF-8 file, piece by piece."""
    import codecs

    decoder, w, at = codecs.getincrementaldecoder("utf-8")(), opened(path), 0
    with w.file:
        while piece := w.take(at, min(CHUNK, max(0, w.size - at))):
            at += len(piece)
            yield decoder.decode(piece)
        decoder.decode(b"", True)


def scan_json_lists(spark: SparkSession, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(items, errors) of the JSON files under ``path``: items (file, folder, key, pos, listed, item), item being JSON text, and errors
    (file, folder, error) of files that are no object, broken or not UTF-8, of which no item counts.

    Files are read item by item, so a list of any length passes through a task that holds one item. As where a key comes
    again in a file only its last list counts, rows are written once before they are told apart.
    """
    import pyarrow as pa

    from ..functions.paths import work_path

    if not by_ranges(path):
        raise ValueError("executors must be able to open the files' store")
    fields = "file string, key string, turn long, pos long, listed boolean, item string, error string"
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string())

    def rows_of(name):
        try:
            for r in items_of(_chunks(name)):
                yield (name, *r, None)
        except (ValueError, OSError) as e:  # UnicodeDecodeError and JSONDecodeError are ValueErrors
            yield name, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        held = []
        for b in batches:
            for name in b.column(0).to_pylist():
                for r in rows_of(name):
                    held.append(r)
                    if len(held) >= BATCH or len(r[5] or "") > CHUNK:
                        yield made(held)
                        held = []
        if held:
            yield made(held)

    def made(held):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    where = work_path(spark, "json_items")
    scanned = files.repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInArrow(run, fields)
    scanned.write.parquet(where)
    found = spark.read.schema(fields).parquet(where)
    folder = F.try_element_at(F.split("file", "/"), F.lit(-2)).alias("folder")
    bad = found.where("error IS NOT NULL")
    turns = found.where("error IS NULL").groupBy("file", "key").agg(F.max("turn").alias("last"), F.min("turn").alias("first")).where("first < last").select(F.col("file").alias("f2"), F.col("key").alias("k2"), "last")
    good = found.where("error IS NULL").join(bad.select("file"), "file", "left_anti")
    good = good.join(turns, (F.col("file") == F.col("f2")) & (F.col("key") == F.col("k2")), "left").where("last IS NULL OR turn = last")
    return good.select("file", folder, "key", "pos", "listed", "item"), bad.select("file", folder, "error")


def merged_items(items: DataFrame) -> DataFrame:
    """(folder, key, pos, item): each folder's lists of one key, one after the other in order of the files; empty lists add
    nothing. Positions come from the lists' lengths, so no list is gathered."""
    sizes = items.groupBy("folder", "key", "file").agg(F.max("pos").alias("most"))
    ahead = F.expr("coalesce(sum(most + 1) OVER (PARTITION BY folder, key ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    sizes = sizes.withColumn("ahead", ahead).drop("most")
    return items.where("pos >= 0").join(sizes, ["folder", "key", "file"]).select("folder", "key", (F.col("ahead") + F.col("pos")).alias("pos"), "item")


def zip_items(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(folder, key, pos, header, payload, good) of merged items of both sides at the same folder, key and position; ``good``
    says that the header is an object, or a string that holds one. Others were attempted, too, but are passed over."""
    is_object = lambda c: F.coalesce(F.startswith(F.trim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), F.lit(False))
    inner = F.when(F.startswith("header", F.lit('"')), F.get(F.from_json(F.concat(F.lit("["), F.col("header"), F.lit("]")), "array<string>"), F.lit(0)))
    quoted = F.from_json(inner, "map<string,string>", {"allowSingleQuotes": "true"})
    x = headers.withColumnRenamed("item", "header").join(payloads.withColumnRenamed("item", "payload"), ["folder", "key", "pos"])
    return x.withColumn("good", is_object(F.col("header")) | (F.startswith(F.trim(inner), F.lit("{")) & quoted.isNotNull() & (F.size(quoted) > 0)))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(folder, attempted, produced)."""
    return pairs.groupBy("folder").agg(F.count("*").alias("attempted"), F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("produced"))
