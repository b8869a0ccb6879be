"""Listings of class trees, JSON, TSV and JSONL readers and writers, and PNG matrices."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*", levels: tuple[str, ...] = ("class",), endings: tuple[str, ...] = (), must_have: bool = False) -> DataFrame:
    """(path, bytes, <levels>): files under ``root``; the last directories name the levels. Sizes are read without
    the contents. ``endings`` keeps names that end so, in either case; a missing root gives no rows, unless there
    ``must_have`` been some."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(["path string", "bytes long", *(f"`{c}` string" for c in levels)]))
    parts = F.split("path", "/")
    out = files.select("path", F.col("length").alias("bytes"), *[F.try_element_at(parts, F.lit(-(len(levels) + 1 - i))).alias(c) for i, c in enumerate(levels)])
    for_any = [F.endswith(F.lower("path"), F.lit(e.lower())) for e in endings]
    if for_any:
        keep = for_any[0]
        for e in for_any[1:]:
            keep = keep | e
        out = out.where(keep)
    if must_have and out.isEmpty():
        raise ValueError(f"no class has a file under {root}")
    return out


def read_json_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, folder, key, items) of JSON files that hold one object of lists each; a value that is no list is a list of
    one. A file that isn't an object raises."""
    x = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    kind = F.when(F.startswith(F.trim("value"), F.lit("{")), F.from_json("value", "map<string,string>"))
    x = x.withColumn("folder", F.try_element_at(F.split("file", "/"), F.lit(-2))).select("file", "folder", F.explode(F.when(kind.isNotNull(), kind).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("file"))))).alias("key", "text"))
    items = F.coalesce(F.when(F.startswith(F.trim("text"), F.lit("[")), F.from_json("text", "array<string>")), F.array("text"))
    return x.select("file", "folder", "key", items.alias("items"))


def literal_dicts(column: Column) -> Column:
    """A map of strings from JSON or single-quoted dictionary text, else null."""
    return F.from_json(column, "map<string,string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})


def write_tsv(df: DataFrame, path: str) -> None:
    """Columns label and text_a, tab-separated with a header line."""
    df.select("label", "text_a").write.option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def png(matrix: bytes, width: int) -> bytes:
    """A grey 8-bit PNG of the matrix."""
    height = len(matrix) // width
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + matrix[i * width : (i + 1) * width] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def unpng(content: bytes) -> tuple[int, int, bytes]:
    """(width, height, bytes) of a grey 8-bit PNG with any line filters; anything else raises."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(content):
        n, kind = struct.unpack_from(">I4s", content, at)
        part = content[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    width, height, depth, colour, _, _, interlace = head
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only plain grey PNGs of 8 bits are read")
    raw, out, before = zlib.decompress(body), bytearray(), bytes(width)
    for r in range(height):
        f, line = raw[r * (width + 1)], bytearray(raw[r * (width + 1) + 1 : (r + 1) * (width + 1)])
        for i in range(width if f else 0):
            a, b, c = (line[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[i] = (line[i] + (0, a, b, (a + b) // 2, near)[f]) & 255
        out += line
        before = bytes(line)
    return width, height, bytes(out)


def to_png(matrices: DataFrame, width: int = 40) -> DataFrame:
    """(flow, png) of (flow, matrix), encoded where the rows are."""
    import pyarrow as pa

    kind = matrices.schema["flow"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([png(m, width) for m in b.column(1).to_pylist()], pa.binary())], names=["flow", "png"])

    return matrices.select("flow", "matrix").mapInArrow(run, f"flow {kind}, png binary")


def from_png(images: DataFrame, width: int = 40, height: int = 40) -> DataFrame:
    """(flow, matrix, error) of (flow, png): pictures of another shape or kind have no matrix but an error."""
    import pyarrow as pa

    kind = images.schema["flow"].dataType.simpleString()

    def one(content):
        try:
            w, h, data = unpng(content)
        except Exception as e:
            return None, str(e)
        return (data, None) if (w, h) == (width, height) else (None, f"shape {w}x{h}")

    def run(batches):
        for b in batches:
            got = [one(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], names=["flow", "matrix", "error"])

    return images.select("flow", "png").mapInArrow(run, f"flow {kind}, matrix binary, error string")


def write_pngs(images: DataFrame, path: str) -> None:
    """Images (name, png) as files under ``path``; names may hold folders. A file is written beside its place and then moved
    there, so a repeated task writes the same file again; path/_index names what the committed tasks wrote."""
    import pyarrow as pa

    from .pcap import store

    def run(batches):
        files, root = store(path)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = f"{root}/{name}"
                files.create_dir(target.rpartition("/")[0], recursive=True)
                with files.open_output_stream(f"{target}.part") as f:
                    f.write(content)
                files.move(f"{target}.part", target)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["name"])

    images.where("name IS NOT NULL AND png IS NOT NULL").select("name", "png").mapInArrow(run, "name string").write.parquet(f"{path}/_index")


def read_pngs(spark: SparkSession, path: str) -> DataFrame:
    """(flow, png) of the files under ``path``, flow being the name below it."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path)
    return x.select(F.element_at(F.split("path", F.lit("/" + path.rstrip("/").rpartition("/")[2] + "/"), 2), 2).alias("flow"), F.col("content").alias("png"))
