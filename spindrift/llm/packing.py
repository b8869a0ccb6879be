"""Operator 5: lexical retrieval packing with a BM25 index in shards of related documents."""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pcap import store
from .common import materialize, modest_batches, new_path, small_parts, table, text_bytes, word_spans

LENGTH, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
K1, B = 1.2, 0.75
#: Bytes of text in a shard, and words of documents that a task counts before it hands them on.
SHARD_BYTES, COUNTED_TERMS = 4 << 20, 4_000_000
#: Terms in a file of document frequencies; a task sorts so many.
TERMS_A_FILE = 1 << 18

#: Ranges of related documents at most, and documents sampled for each to find its bounds: what the driver gathers.
MOST_RANGES, SAMPLED = 20_000, 64

#: Characters for which the tokenizer's normalizer is lower-casing alone; texts with others are encoded whole.
_PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-įĲ-ɏ‐-‧€]")
#: The tokenizer's own split into pieces, fixed by its file.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Bytes that send a text to the exact test below: controls, and what begins characters beyond U+0240 or C2, C4.
_RARE = np.zeros(256, bool)
_RARE[[*range(9), *range(14, 32), 127, 0xC2, 0xC4, *range(0xC9, 256)]] = True


class _Table:
    """Growing runs of ids, by number."""

    def __init__(self):
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs ``at`` one after another, and where each run begins (and the last ends)."""
        size = self.sizes[at]
        bounds = np.concatenate(([0], np.cumsum(size)))
        where = np.repeat(self.starts[at] - bounds[:-1], size)
        where += np.arange(len(where))
        return self.ids[where], bounds


class _Numbers:
    """The number of each 64-bit hash met so far, in one open-addressed array: no Python object per word."""

    def __init__(self, capacity: int):
        self.bits = max(10, int(2 * capacity).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.size = 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the hashes, -1 for new ones."""
        out = np.full(len(h), -1, np.int64)
        slot, left = self._slots(h), np.arange(len(h))
        while len(left):
            there = self.keys[slot]
            same = there == h[left]
            out[left[same]] = self.values[slot[same]]
            on = ~same & (there != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """Number distinct new hashes in turn."""
        slot, left, value = self._slots(h), h, self.size + np.arange(len(h), dtype=np.int32)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = left[free]
            won = free & (self.keys[slot] == left)
            self.values[slot[won]] = value[won]
            left, value, slot = left[~won], value[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)
        self.size += len(h)


class Tokens:
    """Ids of many texts at once. Words are told apart by 64-bit hashes, looked up, and encoded when they are new;
    texts with characters that the tokenizer's normalizer changes beyond lower-casing are encoded whole."""

    def __init__(self, path: str, capacity: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.fast = Tokenizer.from_file(path)
        self.fast.normalizer = normalizers.Sequence([])
        self.fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.fast.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.split = regex.compile(_PIECES).findall
        self.capacity = capacity
        self.reset()

    def reset(self):
        self.numbers = _Numbers(self.capacity)
        self.pieces: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.word_ids, self.piece_ids = _Table(), _Table()

    def _cut(self, low: str) -> list[str]:
        """The pieces of a lower-case word that isn't letters alone."""
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.split(low)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        cut = self._cut
        parts = [(w,) if w.isalpha() else cut(w) for w in words]
        flat = list(itertools.chain.from_iterable(parts))
        new = [p for p in dict.fromkeys(flat) if p not in self.pieces]
        if new:
            # the batch's call keeps no track of places in the text, which takes half the time
            ids = np.array(self.fast.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1  # each piece ends with one such token
            self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new)), strict=True))
            self.piece_ids.add(np.diff(ends, prepend=0), ids)
        at = np.fromiter(map(self.pieces.__getitem__, flat), np.int64, len(flat))
        ids, bounds = self.piece_ids.get(at)
        cut = bounds[np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))]
        self.numbers.add(hashes)
        self.hashes = np.concatenate((self.hashes, hashes))
        self.word_ids.add(np.diff(cut), ids)

    def encode(self, column) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids with the end id, word numbers) of each text of an Arrow column; numbers hold within this call."""
        data, offsets = text_bytes(column)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        h, counts, start, end = word_spans(data, offsets, lower=False)
        h += h == 0  # 0 marks a free place
        word = self.numbers.find(h)
        if len(missing := np.flatnonzero(word < 0)):
            fresh, first = np.unique(h[missing], return_index=True)
            if self.numbers.size + len(fresh) > self.capacity:
                self.reset()
                word[:] = -1
                missing = np.arange(len(h))
                fresh, first = np.unique(h, return_index=True)
                self.numbers = _Numbers(max(self.capacity, len(fresh)))
            body = data.tobytes()
            spans = zip(start[missing[first]].tolist(), end[missing[first]].tolist(), strict=True)
            # decoded and lower-cased all at once: no word holds a line break
            self._learn(fresh, b"\n".join([body[a:b] for a, b in spans]).decode("utf-8", "replace").lower().split("\n"))
            word[missing] = self.numbers.find(h[missing])
        ids, bounds = self.word_ids.get(word)
        first = np.concatenate(([0], np.cumsum(counts)))
        cut = bounds[first]
        signs = np.flatnonzero(_RARE[data])
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # may begin a special token
        odd = set((np.searchsorted(offsets, np.concatenate((signs, marks)), "right") - 1).tolist())
        out = []
        for i in range(len(counts)):
            own = ids[cut[i] : cut[i + 1]]
            if i in odd and (_PLAIN.search(t := column[i].as_py()) or "<|" in t):
                own = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32)
            out.append(np.append(own, np.int32(END_ID)))
        return out, [word[first[i] : first[i + 1]] for i in range(len(counts))]


_OPEN: dict[tuple[str, int], Tokens] = {}


def open_tokens(path: str, capacity: int) -> Tokens:
    """The tokenizer with the words that earlier tasks of this worker have met."""
    if (path, capacity) not in _OPEN:
        _OPEN.clear()
        _OPEN[path, capacity] = Tokens(path, capacity)
    return _OPEN[path, capacity]


def term_counts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow column of texts: text, hash and count of each word of each text, text by text, and the texts'
    lengths in words."""
    h, sizes, _, _ = word_spans(*text_bytes(column), lower=False)
    h += h == 0
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(fresh)
    return np.repeat(np.arange(len(sizes)), sizes)[at], h[at], np.diff(at, append=len(h)), sizes


def _weights(df, tf, sizes, n, mean):
    """BM25 of each posting: document frequency, count and length of the document; n and mean are of all documents."""
    return np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes / max(mean, 1)))


class Corpus:
    """Number, mean length and document frequencies of all documents. The frequencies above 1 lie in files sorted by hash, one
    for each range of hashes, which executors fetch once from the shared folder; their workers map them, so they share
    the memory. ``files`` are (name, first hash, terms) in order; 12 bytes a term on each executor's disk."""

    def __init__(self, n: int, words: int, chars: int, files: list[tuple[str, int, int]]):
        self.n, self.mean, self.files, self.chars = n, words / max(n, 1), files, chars
        self.shard_docs = max(2, n * SHARD_BYTES // max(chars, 1))

    def frequencies(self, hashes: np.ndarray) -> np.ndarray:
        """In how many documents each word occurs, 1 for words that are not in the files."""
        some, back = np.unique(hashes.view(np.int64), return_inverse=True)  # ascending: neighbours in the file too
        out = np.ones(len(some), np.int64)
        cuts = np.searchsorted(some, [first for _, first, _ in self.files])
        for (name, _, terms), a, b in zip(self.files, cuts, np.append(cuts[1:], len(some)), strict=True):
            if a < b:
                keys, counts = _mapped(name, terms)
                at = np.searchsorted(keys, some[a:b]).clip(0, terms - 1)
                out[a:b] = np.where(keys[at] == some[a:b], counts[at], 1)
        return out[back] if len(hashes) else out


_MAPPED: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _mapped(name: str, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and counts of one file."""
    from pyspark import SparkFiles

    if name not in _MAPPED:
        prefix = name.rpartition("-")[0]
        for k in [k for k in _MAPPED if k.rpartition("-")[0] != prefix]:  # of an earlier corpus
            del _MAPPED[k]
        path = SparkFiles.get(name)
        _MAPPED[name] = np.memmap(path, "<i8", "r", 0, (terms,)), np.memmap(path, "<u4", "r", 8 * terms, (terms,))
    return _MAPPED[name]


def corpus_of(docs: DataFrame) -> Corpus:
    """The statistics of ``docs``, by one aggregate over all its rows."""
    import pyarrow as pa

    def count(batches):
        held, most, total = [], 0, np.zeros(3, np.int64)

        def merged():
            words = np.concatenate(held)
            words.sort()
            at = np.flatnonzero(np.concatenate((np.ones(min(len(words), 1), bool), words[1:] != words[:-1])))
            none = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(words[at].view(np.int64)), pa.array(np.diff(at, append=len(words))), none, none], names=["h", "df", "words", "chars"])

        for part in small_parts(batches, "text", SHARD_BYTES):
            _, words, _, sizes = term_counts(part.column(0))
            held.append(words)
            most += len(words)
            total += (len(sizes), sizes.sum(), np.diff(text_bytes(part.column(0))[1]).sum())
            if most > COUNTED_TERMS:
                yield merged()
                held, most = [], 0
        if held:
            yield merged()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([int(x)]) for x in total)], names=["h", "df", "words", "chars"])

    spark = docs.sparkSession
    found = docs.select("text").mapInArrow(count, "h long, df long, words long, chars long").groupBy("h").agg(*(F.sum(c).alias(c) for c in ("df", "words", "chars")))
    found = materialize(found.where("h IS NULL OR df > 1"), "frequencies")
    n, words, chars = next((tuple(x or 0 for x in r) for r in found.where("h IS NULL").select("df", "words", "chars").collect()), (0, 0, 0))
    return Corpus(n, words, chars, _frequency_files(spark, found.where("h IS NOT NULL").select("h", "df")))


def _frequency_files(spark: SparkSession, terms: DataFrame) -> list[tuple[str, int, int]]:
    """Sort (h, df) rows into files of the shared folder, one a task, and have executors fetch them; (name, first, terms).

    Tasks write the files, the driver sees their names alone. A repeated task writes under another name, and only what the
    committed one wrote is named.
    """
    import pyarrow as pa

    tag, folder = uuid.uuid4().hex[:12], new_path(spark, "frequency-files")
    pieces = max(1, -(-terms.count() // TERMS_A_FILE))

    def write(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            h, df = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1))
            order = np.argsort(h)
            files, root = store(folder)
            files.create_dir(root, recursive=True)
            name = f"terms-{tag}-{uuid.uuid4().hex[:12]}"
            with files.open_output_stream(f"{root}/{name}") as f:
                f.write(h[order].astype("<i8").tobytes())
                f.write(np.minimum(df[order], 2**32 - 1).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(h.min())]), pa.array([len(h)])], names=["name", "first", "terms"])

    made = materialize(terms.repartitionByRange(pieces, "h").mapInArrow(write, "name string, first long, terms long"), "frequency_names")
    found = sorted(((r["name"], r["first"], r["terms"]) for r in made.collect()), key=lambda x: x[1])
    for name, _, _ in found:
        spark.sparkContext.addFile(f"{folder}/{name}")
    return found


def shelf_marks(column, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """Two words of each text, as hashes, by which related texts come to lie together: its heaviest of those that
    would fill a shard, and its heaviest that any other text has. 0 where there is none."""
    doc, words, tf, sizes = term_counts(column)
    df = corpus.frequencies(words)
    weight = _weights(df, tf, sizes[doc], corpus.n, corpus.mean)
    out = []
    for least in (corpus.shard_docs, 2):
        use = np.flatnonzero(df >= least)  # by document, then word
        begins = np.flatnonzero(np.diff(doc[use], prepend=-1))
        best = np.maximum.reduceat(weight[use], begins) if len(use) else weight[use]
        use = use[weight[use] == np.repeat(best, np.diff(begins, append=len(use)))]
        first = use[np.diff(doc[use], prepend=-1) > 0]
        mark = np.zeros(len(sizes), np.int64)
        mark[doc[first]] = words[first].view(np.int64)
        out.append(mark)
    return out[0], out[1]


def ranges_of(keys: tuple[np.ndarray, ...], bounds: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many of the bounds are at or before each key; keys and bounds are compared column by column."""
    at = np.lexsort(tuple(np.concatenate((b, k)) for k, b in zip(keys, bounds, strict=True))[::-1])
    known = len(bounds[0])
    out = np.empty(known + len(keys[0]), np.int64)
    out[at] = np.cumsum(at < known)
    return out[known:]


class Shard:
    """BM25 over the documents of one shard: posting lists in array form. ``frequencies`` gives the document
    frequency in the whole corpus of each term, ``n`` and ``mean`` are the corpus's; else they are the shard's own."""

    def __init__(self, terms: list[np.ndarray], frequencies=None, n: int | None = None, mean: float | None = None):
        self.n = len(terms)
        sizes = np.fromiter(map(len, terms), np.int64, self.n)
        flat = np.concatenate(terms).astype(np.int64) if self.n else np.zeros(0, np.int64)
        key, tf = np.unique(flat * self.n + np.repeat(np.arange(self.n), sizes), return_counts=True)
        term, self.doc = key // max(self.n, 1), key % max(self.n, 1)
        self.terms, here = np.unique(term, return_counts=True)
        self.ends = np.cumsum(here)
        self.begins = self.ends - here
        slot = np.repeat(np.arange(len(here)), here)
        df = frequencies(self.terms) if frequencies else here
        self.weight = _weights(df[slot], tf, sizes[self.doc], self.n if n is None else n, (sizes.mean() if self.n else 1) if mean is None else mean)
        # by document: its terms that others of the shard have too
        use = np.flatnonzero(here[slot] > 1)
        use = use[np.argsort(self.doc[use], kind="stable")]
        self.own, self.own_ends = slot[use], np.cumsum(np.bincount(self.doc[use], minlength=self.n))

    def neighbours(self, d: int, first: int = 64, wanted: np.ndarray | None = None):
        """Documents that share terms with d (of those that are ``wanted``, by number), best BM25 score first; all terms of d
        count. The ``first`` best are put in order at once, the others when they are asked for."""
        slots = self.own[self.own_ends[d - 1] if d else 0 : self.own_ends[d]]
        if not len(slots):
            return
        size = self.ends[slots] - self.begins[slots]
        at = np.repeat(self.ends[slots] - np.cumsum(size), size)
        at += np.arange(len(at))
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        found = np.flatnonzero(score if wanted is None else (score != 0) & wanted)
        least = np.partition(score[found], -first)[-first] if len(found) > first else 0.0
        for some in (found[score[found] >= least], found[score[found] < least]):
            yield from some[np.argsort(-score[some], kind="stable")].tolist()


def pack(sizes: list[int], shard: Shard | None, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (doc, start, size, sequence, offset) of one shard; every id lies in exactly one piece.

    Documents fill whole windows by themselves first. What remains of them is packed greedily: the longest rest is
    the seed, its unused neighbours follow in order of score, the last one is cut where the window ends and its
    own rest stays in the pool; if the neighbours run out, the next longest rests follow. The final window that
    can't be filled is cut into sequences whose lengths are powers of two, so no sequence needs padding.
    """
    out, rest, sequence = [], {}, 0
    for d, n in enumerate(sizes):
        for k in range(n // length):
            out.append((d, k * length, length, sequence, 0))
            sequence += 1
        if n % length:
            rest[d] = n - n % length
    pool = sorted(rest, key=lambda d: (rest[d] - sizes[d], d))
    left_over = np.zeros(len(sizes), bool)
    left_over[pool] = True
    at = 0
    while at < len(pool):
        if pool[at] not in rest:
            at += 1
            continue
        seed, room, window = pool[at], length, []
        ahead = at
        candidates = itertools.chain([seed], shard.neighbours(seed, wanted=left_over) if shard else ())
        while room:
            d = next(candidates, None)
            if d is None:  # the neighbours are used up
                while ahead < len(pool) and pool[ahead] not in rest:
                    ahead += 1
                if ahead == len(pool):
                    break
                d = pool[ahead]
            if d not in rest:
                continue
            start = rest[d]
            take = min(room, sizes[d] - start)
            window.append((d, start, take))
            room -= take
            if start + take == sizes[d]:
                del rest[d]
                left_over[d] = False
            else:
                rest[d] = start + take
        lengths = [length] if not room else [1 << b for b in range(length.bit_length(), -1, -1) if (length - room) >> b & 1]
        parts = iter(window)
        d, start, left = next(parts)
        for n in lengths:
            offset = 0
            while offset < n:
                if not left:
                    d, start, left = next(parts)
                take = min(left, n - offset)
                out.append((d, start, take, sequence, offset))
                offset, start, left = offset + take, start + take, left - take
            sequence += 1
    return out


def packed(docs: DataFrame, tokenizer: str | None = None, cache_words: int = 300_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows and null ids are packed like others; an empty table
    gives no pieces. Document frequencies and mean length are those of all documents. Rows are dealt by ranges of two
    of their heavy words (``shelf_marks``), a hash and a row number, with bounds from a sample, so related documents lie together and
    a large group of copies spreads over tasks; shards are runs of SHARD_BYTES of text in that order (a longer text is a
    shard of its own), within which all terms are scored. Neighbours on other shards are not found: README.md says how
    many. A worker remembers the ids of ``cache_words`` words (about 250 bytes each), which only saves time. Sequence
    numbers hold the partition's number in their upper bits and count within it.
    """
    import pyarrow as pa

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        from pyspark import TaskContext

        import public_tokenizers

        tokens = open_tokens(tokenizer or public_tokenizers.path(TOKENIZER), cache_words)
        base = TaskContext.get().partitionId() << 36
        for part in small_parts(batches, "text", SHARD_BYTES):
            ids, terms = tokens.encode(part.column(1))
            sizes = [len(x) for x in ids]
            pieces = pack(sizes, Shard(terms, lambda x: corpus.frequencies(tokens.hashes[x]), corpus.n, corpus.mean))
            if not pieces:
                continue
            doc, start, size, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            crc = [zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes()) for d, a, n, _, _ in pieces]
            arrays = [part.column(0).take(pa.array(doc)), start, size, crc, np.array(sizes, np.int64)[doc], sequence + base, offset]
            base += int(sequence[-1]) + 1
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, pa.int64()) for a in arrays], names=names)

    def marks(batches, bounds):
        for part in small_parts(batches, "text", SHARD_BYTES):
            own = [*shelf_marks(part.column(1), corpus), *(np.asarray(part.column(k), np.int64) for k in (2, 3))]
            columns = part.columns[:2] if bounds else []
            at = [ranges_of(tuple(own), bounds)] if bounds else []
            arrays = [*columns, *map(pa.array, own), *(pa.array(x.astype(np.int32)) for x in at)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", *order, "range"] if bounds else order)

    modest_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    corpus = corpus_of(rows)
    order, longs = ["shelf", "mark", "salt", "row"], "shelf long, mark long, salt long, row long"
    rows = rows.withColumn("salt", F.xxhash64("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())  # parts rows that are equal in both
    # ranges of about two shards, between quantiles of a sample of marks
    parallel = min(docs.sparkSession.sparkContext.defaultParallelism, -(-corpus.chars // SHARD_BYTES))
    parts = min(MOST_RANGES, max(1, parallel, corpus.chars // (2 * SHARD_BYTES)))
    some = rows.sample(min(1.0, SAMPLED * parts / max(corpus.n, 1)), seed=5).mapInArrow(lambda b: marks(b, None), longs).toArrow()
    some = [np.asarray(some.column(c), np.int64) for c in order]
    at = np.lexsort(some[::-1])[np.arange(1, parts) * len(some[0]) // parts] if len(some[0]) else np.zeros(0, np.int64)
    bounds = tuple(x[at] for x in some)
    ranged = rows.mapInArrow(lambda b: marks(b, bounds), f"doc_id long, text string, {longs}, range int")
    return ranged.repartitionById(parts, F.col("range")).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), cache_words=1_200_000)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the documents that are left."""
    return packed(docs)
