"""Helpers that the operators of this subpackage share: written tables, components, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and \t \n \v \f \r. Fixed by the contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a folder of our own on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text):
    """Native: the words ``[^\\x20\\x09-\\x0D]+`` of a text column, null text giving none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def let(value, body):
    """Bind an expensive expression once, so that ``body`` can use it several times in one row."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node.

    ``edges`` has two long columns a and b. Large-star and small-star rounds, each written out; a hub's
    neighbours are never gathered, only their minimum is taken, so a third of all nodes may share one hub.
    Nodes without an edge (or with a loop only) don't appear. Before each round a task replaces the edges that it has,
    whichever they are, by links to the roots that they give, so few rounds are left.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialize(_contracted(now), "edges")
    before = _state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        few = max(1, int(2 * before[0]) // ROWS_A_TASK + 1)  # small graphs don't need a task for each shuffle partition
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(few)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct()
        large = materialize(large.coalesce(few), "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few)
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(few)
        now = moved.union(low.select("u", F.col("m").alias("v"))).coalesce(few).distinct().coalesce(few)
        now = materialize(_contracted(now), "small_star")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: Rows of a small graph that one task of ``components`` takes, and edges that a task contracts at a time.
ROWS_A_TASK = 200_000


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n items' component under the links a[i] - b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u > v) with the same components: within each run of a partition every node is linked to its root."""
    import pyarrow as pa

    def stars(held):
        u, v = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
        some = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], names=["u", "v"])

    def run(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS_A_TASK:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return edges.mapInArrow(run, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of a graph's edges: equal after a round that changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


# --- word hashes over whole Arrow batches -------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher (public domain constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1; the longest run so far is kept until ``release_memory``."""
    out = _POWERS.get(int(base))
    if out is None or len(out) < n:
        out = np.full(n, base, np.uint64)
        if n:
            out[0] = 1
        out = _POWERS[int(base)] = np.multiply.accumulate(out)
    return out[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts at once, and how many words each text has."""
    return word_spans(data, offsets, lower)[:2]


#: Bytes of text hashed at a time (a longer word is hashed whole).
BLOCK = 1 << 19


#: By byte: whether it parts words, in the contracts that split at the six spaces.
SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
#: The same where words are runs of ASCII letters, digits and other than ASCII characters.
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes``, and each word's first byte and end, counted from the first text's start.

    ``data`` holds the texts' UTF-8 bytes, ``offsets`` (n + 1) their bounds. A word is a maximal run without
    the bytes of ``gaps`` (the six spaces); ``lower`` maps A-Z to a-z. Bytes are taken in blocks of about BLOCK that end at a space or a
    text's bound, so working memory grows neither with the batch nor with a text.
    """
    data = data[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    a, parts = 0, [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while a < len(data):
        b = _block_end(data, offsets, a + BLOCK, gaps)
        bounds = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a
        h, start, end = _word_spans(data[a:b], bounds, lower, gaps)
        parts.append((h, start + a, end + a))
        a = b
    h, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, np.diff(np.searchsorted(start, offsets)), start, end


def _block_end(data: np.ndarray, offsets: np.ndarray, at: int, gaps: np.ndarray) -> int:
    """The first gap or text's bound at ``at`` or after it."""
    if at >= len(data):
        return len(data)
    bound = int(offsets[np.searchsorted(offsets, at)])
    while at < bound:
        piece = data[at : min(at + 4096, bound)]
        found = np.flatnonzero(gaps[piece])
        if len(found):
            return at + int(found[0])
        at += len(piece)
    return bound


def _word_spans(data: np.ndarray, bounds: np.ndarray, lower: bool, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of a block's words; ``bounds`` are those of texts. Everything is array arithmetic."""
    n = len(data)
    space = gaps[data]
    inner = np.zeros(n + 1, bool)
    inner[bounds] = True  # a text's bound also ends a word
    word = ~space
    start = np.flatnonzero(word & (np.concatenate(([True], space[:-1])) | inner[:n]))
    end = np.flatnonzero(word & (np.concatenate((space[1:], [True])) | inner[1:])) + 1
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5) if lower else data
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix_bytes(low) * _powers(_BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(_INV, n)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, end


_BYTE = None


def mix_bytes(b: np.ndarray) -> np.ndarray:
    global _BYTE
    if _BYTE is None:
        _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _BYTE[b]


_STEP = np.uint64(0xFF51AFD7ED558CCD)


def shingles(h: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in turn (with repeats), and how many each text has.

    A text of 1 to k - 1 words has its whole sequence as one shingle; one without words has none.
    """
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    into = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    every = np.zeros(len(h), np.uint64)  # the shingle that starts at each word, across texts too
    for j in range(k):
        every = every * _STEP
        every[: max(len(h) - j, 0)] += h[j:]
    at = np.arange(int(sizes.sum()), dtype=np.int64)
    at += np.repeat(first - into, sizes)
    out = every[at]
    for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        whole = int(counts[i])
        for x in h[first[i] : first[i] + counts[i]].tolist():
            whole = (whole * int(_STEP) + x) % (1 << 64)
        out[into[i]] = whole
    return mix(out), sizes


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the bounds of an Arrow string array; null counts as empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)), offsets


def split_batches(batch, column: str, limit: int = 16 << 20):
    """Cut an Arrow batch where its texts pass ``limit`` bytes, so that array work stays bounded."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def small_parts(batches, column: str, limit: int = 4 << 20):
    """A task's rows in parts of about ``limit`` bytes of text, whatever batches they come in. At the task's end freed
    memory goes back to the system: Spark uses the same workers for later stages, beside the executor's own heap."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, filled = [], 0

    def whole():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), np.int64)
        part = (filled + np.cumsum(sizes) - sizes) // limit
        fresh = np.flatnonzero(np.diff(part, prepend=0)).tolist()
        for a, b in zip([0, *fresh], [*fresh, batch.num_rows], strict=True):
            if a in fresh and held:
                yield whole()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        filled += int(sizes.sum()) - int(part[-1]) * limit
    if held:
        yield whole()
    held = []
    release_memory()


#: Rows of an Arrow batch where the session sets none: texts come to the workers some megabytes at a time.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Lower the session's rows a batch from Spark's own default; a value that the user has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def release_memory() -> None:
    """Drop what outgrew its use and hand freed memory back to the system."""
    import ctypes

    import pyarrow as pa

    for base, kept in list(_POWERS.items()):
        if len(kept) > 2 * BLOCK:
            del _POWERS[base]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
