"""Operator 3: quality by nearest-neighbour votes in a latent-semantic space."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, modest_batches, shingles, small_parts, table, text_bytes, word_hashes
from .labelled import held_out, sample_labels

#: Hashed dimensions of character-class trigrams, of words and as many of word pairs; terms that say how a text repeats
#: itself and how short it is, and their weight.
TRIGRAMS, WORDS, EXTRA, EXTRA_WEIGHT = 1016, 512, 4, 0.3
DIM, RANK, NEIGHBOURS = TRIGRAMS + 2 * WORDS + EXTRA, 48, 25


def _classes() -> np.ndarray:
    """Byte -> character class: a letter's case, digit, space, line end, or the sign itself."""
    c = np.full(256, 1, np.int64)  # lower-case letters and all bytes of non-ASCII letters
    c[65:91], c[48:58], c[9:14], c[32], c[10] = 2, 3, 4, 4, 5
    signs = [b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]
    c[signs] = 6 + np.arange(len(signs))
    return c


CLASS = _classes()


def term_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term frequencies (texts x DIM, float32) of whole texts: what words and word pairs there are, how characters follow
    each other, and how much repeats. Texts without words or characters have zeros there."""
    n = len(offsets) - 1
    data, offsets = data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
    lengths = np.diff(offsets)
    out = np.zeros((n, DIM), np.float32)
    count = lambda row, dim, size: np.bincount(row * size + dim, minlength=n * size).reshape(n, size)
    if len(data) >= 3:
        c = CLASS[data]
        code = (c[:-2] * 64 + c[1:-1]) * 64 + c[2:]
        dim = (mix(np.arange(64**3, dtype=np.uint64)) % np.uint64(TRIGRAMS)).astype(np.int64)
        row = np.repeat(np.arange(n), lengths)
        same = row[:-2] == row[2:]  # no trigram across texts
        out[:, :TRIGRAMS] = count(row[:-2][same], dim[code[same]], TRIGRAMS)
    h, counts = word_hashes(data, offsets)
    of = np.repeat(np.arange(n), counts)
    size = np.maximum(counts, 1)
    next_to = of[1:] == of[:-1]
    bucket = lambda x: ((x >> np.uint64(20)) % np.uint64(WORDS)).astype(np.int64)
    out[:, TRIGRAMS : TRIGRAMS + WORDS] = count(of, bucket(h), WORDS)
    out[:, TRIGRAMS + WORDS : TRIGRAMS + 2 * WORDS] = count(of[1:][next_to], bucket(mix(h[:-1] * np.uint64(3) + h[1:])[next_to]), WORDS)

    def again(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Per text, how many hashes repeat an earlier one."""
        order = np.lexsort((hashes, owner))
        a, b = hashes[order], owner[order]
        return np.bincount(b[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])], minlength=n)

    follows = np.bincount(of[1:][next_to & (h[1:] == h[:-1])], minlength=n)
    s, sizes = shingles(h, counts, 4)
    levels = [follows / size, again(s, np.repeat(np.arange(n), sizes)) / size, np.minimum(again(h, of) / size, 0.9), 30 / (30 + counts)]
    out[:, TRIGRAMS + 2 * WORDS :] = np.stack(levels, 1) * np.maximum(lengths, 1)[:, None] * EXTRA_WEIGHT
    return out


class NeighbourModel:
    """Weights and projection of the latent space, and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.y = y.astype(np.float32)
        if len(x):
            self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.2
            w = self.weigh(x).astype(np.float64)
            values, vectors = np.linalg.eigh(w.T @ w)  # right singular vectors of the term matrix
            keep = np.argsort(values)[::-1][:RANK]
            self.project = vectors[:, keep].astype(np.float32)
            self.points = self.latent(x)

    def weigh(self, x: np.ndarray) -> np.ndarray:
        x = np.sqrt(x) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = self.weigh(x) @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Similarity-weighted votes of the NEIGHBOURS nearest labelled vectors; all cosines are exact."""
        k = min(NEIGHBOURS, len(self.y))
        if not k:
            return np.full(len(x), self.prior)
        out = np.empty(len(x))
        for a in range(0, len(x), block):
            cos = self.latent(x[a : a + block]) @ self.points.T
            near = np.argpartition(cos, len(self.y) - k, axis=1)[:, len(self.y) - k :]
            w = np.maximum(np.take_along_axis(cos, near, 1), 0) ** 16
            total = w.sum(1)
            vote = (w * self.y[near]).sum(1)
            out[a : a + block] = (vote + 0.05 * self.prior) / (total + 0.05)
        return np.clip(out, 0, 1)


def _matrices(batches):
    for part in small_parts(batches, "text"):
        for a in range(0, part.num_rows, 1024):
            piece = part.slice(a, 1024)
            yield piece, term_matrix(*text_bytes(piece.column(piece.schema.get_field_index("text"))))


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000) -> NeighbourModel:
    """Fit on about ``max_labelled`` labelled rows at most (crc32(doc_id) mod 3 = 1 is never read).

    That bound also bounds what the driver gathers and what is broadcast: DIM and RANK floats a row.
    """
    import pyarrow as pa

    modest_batches(docs.sparkSession)
    chosen = sample_labels(labels, "quality", 3, 1, max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # one text an id, so the bound holds

    def run(batches):
        for piece, x in _matrices(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    got = sorted(rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary").collect(), key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, DIM)
    return NeighbourModel(x, np.array([r["y"] > 0 for r in got], np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Every document is compared with all labelled vectors, in blocks. Null and empty texts are scored as texts
    without terms, very long ones whole; repeated rows get equal scores; of neighbours at equal distance those that are
    taken depend on the order of their ids alone; with no labels the score is 0.5; an empty table gives none.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    modest_batches(spark)
    model = spark.sparkContext.broadcast(fit_quality(docs, labels, max_labelled))

    def run(batches):
        for piece, x in _matrices(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(model.value.score(x), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
