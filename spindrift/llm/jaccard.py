"""Operator 6: similarity join of documents on five-word shingles, Jaccard 0.8 and more, heavy-light.

Documents with equal shingle sets are one class, so copies cost nothing more. Light classes (few shingles) are
joined through enumerated subsets: two sets of sizes a and b are similar exactly if they share a subset of the
size that a and b require. Heavy classes scan inverted lists over the rarest fifth of their shingles. The
boundary between light and heavy is the cheapest one for the table at hand. Only links that can change a
component are verified, and all of these are.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, mix, modest_batches, release_memory, shingles, small_parts, split_batches, table, text_bytes, word_hashes

WORDS = 5
#: 100 * intersection >= 80 * union, in whole numbers.
LARGEST_LIGHT = 12
#: Rows shuffled for a posting whatever its list holds.
POSTING_COST = 2.0
CHUNK = 2 << 20
#: The first pairs come from one list in so many; later rounds take every list that is still apart.
FIRST_LISTS, ROUNDS = 4, 3
#: Bits of the bitmaps that travel with postings. They tell sets of a few hundred shingles apart; for larger ones the
#: wider bitmaps of ``_open_pairs`` do.
NARROW = 512
#: Pairs of a list from which on bitmaps travel with its postings.
CROWDED = 256
#: Pairs a posting up to which no further round of few pairs is worth while.
EASY = 16


def required(a, b):
    """The least intersection of sets of sizes a and b that reaches the threshold."""
    return -(-4 * (a + b) // 9)


def partners(n: int) -> range:
    """Sizes that a set similar to one of n can have."""
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def prefix_size(n):
    return n - -(-4 * n // 5) + 1


def enumerations(n: int) -> int:
    """Subsets that a light set of n enumerates."""
    import math

    return sum(math.comb(n, required(n, m)) for m in partners(n))


def boundary(histogram: dict[int, int], list_length: float) -> int:
    """The largest light size: least total cost of enumerating light sets and scanning lists for the others."""
    best, at, gain = 0.0, 0, 0.0
    for n in range(1, LARGEST_LIGHT + 1):
        gain += histogram.get(n, 0) * (prefix_size(n) * (POSTING_COST + list_length) - enumerations(n))
        if gain >= best:
            best, at = gain, n
    return at


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow text column: the distinct shingles by text, the text of each, set sizes, set hashes."""
    h, counts = word_hashes(*text_bytes(column))
    s, sizes = shingles(h, counts, WORDS)
    of = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key = (of << np.uint64(44)) | (s >> np.uint64(20))
    order = np.argsort(key)
    s, key = s[order], key[order]
    if ((key[1:] == key[:-1]) & (s[1:] != s[:-1])).any():  # hashes that agree in 44 bits: order them in full
        s = s[np.lexsort((s, key >> np.uint64(44)))]
    of = of.astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[first], of[first]
    n = np.bincount(of, minlength=len(sizes))
    whole = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))))
    ends = np.cumsum(n)
    cls = mix(whole[ends] - whole[ends - n] + n.astype(np.uint64))
    return s, of, n, cls


def _survey(docs: DataFrame, local: int = 4) -> DataFrame:
    """(kind, key, n): kind 0 shingles frequent within a chunk, 1 sizes of sets, 2 the lists' lengths there."""
    import pyarrow as pa

    def run(batches):
        for part in small_parts(batches, "text", CHUNK):
            s, of, n, cls = shingle_sets(part.column(0))
            fresh = np.zeros(len(n), bool)
            fresh[np.unique(cls, return_index=True)[1]] = True
            small = np.bincount(n[(n > 0) & (n <= LARGEST_LIGHT) & fresh], minlength=LARGEST_LIGHT + 1)
            key, df = np.unique(s[fresh[of]], return_counts=True)
            often = df >= local
            cost = [int((df * df).sum()), int(df.sum())]
            kind = np.concatenate((np.zeros(often.sum(), np.int32), np.ones(len(small), np.int32), np.full(2, 2, np.int32)))
            keys = np.concatenate((key[often].view(np.int64), np.arange(len(small)), np.arange(2)))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys), pa.array(np.concatenate((df[often], small, cost)))], names=["kind", "key", "n"])

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _subset_keys(s: np.ndarray) -> list[tuple[int, int]]:
    """(key, side) of the subsets that a light set enumerates; side 0 is the smaller partner of a size pair, 1 the
    larger, 2 both (equal sizes)."""
    n, out = len(s), []
    for m in partners(n):
        side = 2 if n == m else int(n > m)
        for sub in itertools.combinations(s.tolist(), required(n, m)):
            out.append((hash((min(n, m), max(n, m), *sub)), side))
    return out


def _sets(docs: DataFrame, hot: np.ndarray, hot_n: np.ndarray, light: int) -> DataFrame:
    """A row per document: doc_id, th (its text's hash), cls, n, its prefix (rarest first) if it scans lists, its subset
    keys if light, and its bitmaps: one as wide as its size asks and one of NARROW bits."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast((hot, hot_n))
    listed = -(-4 * (light + 1) // 5)

    def run(batches):
        often, often_n = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(often >> np.uint64(44)).astype(np.int64)] = True
        for part in small_parts(batches, "text", CHUNK):
            s, of, n, cls = shingle_sets(part.column(2))
            rank = np.zeros(len(s), np.int64)
            at = np.flatnonzero(maybe[(s >> np.uint64(44)).astype(np.int64)])
            where = np.minimum(np.searchsorted(often, s[at]), max(len(often) - 1, 0))
            if len(often):
                rank[at] = np.where(often[where] == s[at], often_n[where], 0)
            starts = np.concatenate(([0], np.cumsum(n)))[:-1]
            light_at = np.flatnonzero((n > 0) & (n <= light))
            subs = [[] for _ in range(len(n))]
            for i in light_at.tolist():
                subs[i] = _subset_keys(s[starts[i] : starts[i] + n[i]])
            again = np.zeros(len(n), bool)
            again[of[rank > 0]] = True
            if again.any():  # texts with frequent shingles: these go last
                mine = again[of]
                s[mine] = s[mine][np.lexsort((s[mine], rank[mine], of[mine]))]
            take = np.where(n >= listed, prefix_size(n), 0) * (n > 0)
            pos = np.arange(int(take.sum())) + np.repeat(starts - np.concatenate(([0], np.cumsum(take)))[:-1], take)
            offsets = np.concatenate(([0], np.cumsum(take))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s[pos].view(np.int64)))
            keys = pa.array([[{"key": k, "side": e} for k, e in x] for x in subs], pa.list_(pa.struct([("key", pa.int64()), ("side", pa.int32())])))
            sketch = pa.array(bitmaps(s, of, n), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(cls.view(np.int64)), pa.array(n.astype(np.int64)), prefix, keys, sketch, parities(s, of, len(n))], names=["doc_id", "th", "cls", "n", "prefix", "subs", "sketch", "narrow"])

    kinds = "doc_id long, th long, cls long, n long, prefix array<long>, subs array<struct<key: long, side: int>>, sketch binary, narrow array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, kinds)


def parities(s: np.ndarray, of: np.ndarray, sets: int):
    """Arrow lists with each set's bitmap of NARROW bits, as longs. Like ``bitmaps``: two differ in no more bits than
    their sets in shingles."""
    import pyarrow as pa

    at = of * NARROW + (s & np.uint64(NARROW - 1)).astype(np.int64)
    longs = np.packbits((np.bincount(at, minlength=sets * NARROW) & 1).astype(np.uint8), bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.arange(sets + 1, dtype=np.int32) * (NARROW // 64)), pa.array(longs))


def bitmaps(s: np.ndarray, of: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A set's bitmap of 2 to 4 bits a shingle: each bit is the parity of the shingles that fall on it, so two
    bitmaps differ in no more bits than the sets in shingles."""
    width = np.int64(1) << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)
    ends = np.cumsum(width)
    bit = (ends - width)[of] + (s & (width[of] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(bit, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[(b - w) // 8 : b // 8] for b, w in zip(ends.tolist(), width.tolist(), strict=True)]


def may_be_similar(sa: list[bytes], sb: list[bytes], na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether bitmaps leave it open that two sets reach the threshold (never false for those that do)."""
    la, lb = np.fromiter(map(len, sa), np.int64, len(sa)), np.fromiter(map(len, sb), np.int64, len(sb))
    apart = np.zeros(len(sa), np.int64)
    for x, y in {*zip(la.tolist(), lb.tolist(), strict=True)}:
        rows = np.flatnonzero((la == x) & (lb == y))
        a, b = (np.frombuffer(b"".join(t[r] for r in rows.tolist()), np.uint8).reshape(len(rows), w) for t, w in ((sa, x), (sb, y)))
        while a.shape[1] != b.shape[1]:  # fold the wider one: parities add up
            if a.shape[1] < b.shape[1]:
                a, b = b, a
            half = a.shape[1] // 2
            a = a[:, :half] ^ a[:, half:]
        apart[rows] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return 9 * apart <= na + nb


def _light_edges(sets: DataFrame) -> DataFrame:
    """Classes that share a subset of the required size, each linked to the least class with it: exact, no check."""
    rows = sets.select("cls", F.explode("subs").alias("x")).select("cls", "x.key", "x.side").distinct()
    group = rows.groupBy("key").agg(
        F.min("cls").alias("low"), F.max("cls").alias("high"), F.max(F.expr("side <> 1")).alias("smaller"), F.max(F.expr("side <> 0")).alias("larger"),
    ).where("low < high AND smaller AND larger")
    return rows.join(group, "key").where("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct()


def _open_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps don't rule out."""
    import pyarrow as pa

    a = sketches.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches):
        for t in batches:
            good = pa.array(may_be_similar(t.column(2).to_pylist(), t.column(3).to_pylist(), np.asarray(t.column(4)), np.asarray(t.column(5))))
            yield pa.RecordBatch.from_arrays([t.column(0).filter(good), t.column(1).filter(good)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold: those that their bitmaps leave open are decided
    on both whole texts."""
    import pyarrow as pa

    pairs = materialize(_open_pairs(pairs, sketches), "open_pairs")
    a = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            for part in split_batches(batch, "ta", CHUNK // 2):
                for piece in split_batches(part, "tb", CHUNK // 2):
                    at = {k: piece.column(piece.schema.get_field_index(k)) for k in ("a", "b", "ta", "tb")}
                    sa, oa, na, _ = shingle_sets(at["ta"])
                    sb, ob, nb, _ = shingle_sets(at["tb"])
                    s, o = np.concatenate((sa, sb)), np.concatenate((oa, ob))
                    order = np.lexsort((s, o))
                    s, o = s[order], o[order]
                    both = np.bincount(o[1:][(s[1:] == s[:-1]) & (o[1:] == o[:-1])], minlength=len(na))
                    good = pa.array(100 * both >= 80 * (na + nb - both))
                    yield pa.RecordBatch.from_arrays([at["a"].filter(good), at["b"].filter(good)], names=["a", "b"])
        release_memory()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _fits(n1: str, p1: str, n2: str, p2: str) -> str:
    """Sizes fit, and what follows the shared shingle can still reach the required intersection."""
    return f"5 * least({n1}, {n2}) >= 4 * greatest({n1}, {n2}) AND 9 * (1 + least({n1} - {p1} - 1, {n2} - {p2} - 1)) >= 4 * ({n1} + {n2})"


def _near_pairs(postings: DataFrame, light: int, salt: int, size: int = 8) -> DataFrame:
    """At most one pair per posting: the classes of a list and size band are dealt into buckets of about ``size``, anew
    for every list and ``salt``, and paired with one of their bucket, of the component with the smallest name there: names
    are the least of members' hashes, so that is mostly the largest one. Classes that share many rare shingles so meet
    many different partners, which connects large groups of copies without looking at all their pairs."""
    banded = postings.withColumn("band", F.floor(F.log("n") / float(np.log(1.25))))
    lengths = banded.groupBy("shingle", "band").agg(F.count("*").alias("len")).where("len > 1")
    dealt = banded.join(lengths, ["shingle", "band"]).withColumn("bucket", F.expr(f"pmod(xxhash64(shingle, cls, {salt}), ceil(len / {size}))"))
    lead = dealt.groupBy("shingle", "band", "bucket").agg(F.min(F.struct("comp", F.xxhash64("shingle", "cls", F.lit(salt)).alias("o"), "n", "cls", "pos")).alias("l"))
    pairs = dealt.join(lead, ["shingle", "band", "bucket"]).where(f"comp <> l.comp AND greatest(n, l.n) > {light} AND {_fits('n', 'pos', 'l.n', 'l.pos')}")
    return pairs.select(F.least("cls", "l.cls").alias("a"), F.greatest("cls", "l.cls").alias("b")).distinct()


def _list_pairs(postings: DataFrame, folds: DataFrame, light: int, block: int) -> DataFrame:
    """All pairs of a list's classes that lie in different components and may be similar.

    Each such pair has a class outside the list's most frequent component, so only these are held against the whole
    list. In lists of more than CROWDED such pairs bitmaps travel with the postings, so that a pair which they rule out
    is never a row; and where the classes outside are more than ``block``, they are cut into blocks, each of which meets
    the list in a task of its own.
    """
    parts = postings.groupBy("shingle", "comp").agg(F.count("*").alias("k"))
    lists = parts.groupBy("shingle").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"), (F.sum("k") - F.max("k")).alias("others"), F.sum("k").alias("len")).where("others > 0")
    rows = postings.select("shingle", "cls", "n", "pos", "comp").join(lists, "shingle")
    small = rows.where(f"others * len <= {CROWDED}").withColumn("blocks", F.lit(1))
    crowded = rows.where(f"others * len > {CROWDED}").withColumn("blocks", F.ceil(F.col("others") / block).cast("int")).join(folds, "cls")
    crowded = materialize(crowded, "crowded_postings")
    apart = " + ".join(f"bit_count(fa[{i}] ^ fb[{i}])" for i in range(NARROW // 64))
    found = []
    for some, fold, more in ((small, F.lit(None), "true"), (crowded, F.col("narrow"), f"9 * ({apart}) <= na + nb")):
        side = lambda part, x: [F.col("shingle").alias(f"s{x}"), part.alias(f"p{x}"), F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p_{x}"), F.col("comp").alias(f"c{x}"), fold.alias(f"f{x}")]  # noqa: E731, B023
        left = some.where("comp <> top").select(*side(F.expr("cast(pmod(xxhash64(cls), blocks) as int)"), "a"))
        right = some.select(*side(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "b"), "top")
        fits = f"sa = sb AND pa = pb AND ca <> cb AND (cb = top OR a < b) AND greatest(na, nb) > {light} AND {_fits('na', 'p_a', 'nb', 'p_b')} AND {more}"
        found.append(left.join(right, F.expr(fits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found[0].union(found[1]).distinct()


def _labelled(postings: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of lists that hold more than one component, with their component; and the components."""
    comp = components(links)
    x = postings.select("shingle", "cls", "n", "pos").join(comp, postings.cls == comp.node, "left").select("shingle", "cls", "n", "pos", F.coalesce("component", "cls").alias("comp"))
    mixed = x.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("shingle")
    return materialize(x.join(mixed, "shingle"), "mixed_postings"), comp


def _apart(postings: DataFrame) -> tuple[int, bool]:
    """In how many list places a class lies outside its list's largest component, and whether all pairs of these with
    their lists are few: EASY a posting at most."""
    parts = postings.groupBy("shingle", "comp").agg(F.count("*").alias("k"))
    lists = parts.groupBy("shingle").agg((F.sum("k") - F.max("k")).alias("others"), F.sum("k").alias("len"))
    others, pairs, places = lists.agg(F.sum("others"), F.sum(F.col("others") * F.col("len")), F.sum("len")).first()
    return others or 0, (pairs or 0) <= EASY * (places or 0)


def similar_documents(docs: DataFrame, max_hot: int = 200_000, block: int = 1024, broadcast_ids: int = 500_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Null texts, empty ones and those without words have no shingles and are linked with nothing. Repeated rows, and
    rows of one id with different texts, are links like others (each row's component is that of its own text); rows with
    a null id take part, also as bridges, but can't name a component: one of null ids only has the component null. An
    empty table gives an empty result. Shingles are compared by 64-bit hashes. ``max_hot`` bounds the list of frequent
    shingles that is broadcast: these come last in the order of prefixes, which changes the cost but never the result.
    """
    modest_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(_survey(docs), "survey")
    hot = found.where("kind = 0 AND n >= 8").orderBy(F.col("n").desc(), "key").limit(max_hot).select("key", "n").toArrow()
    key, often = np.asarray(hot.column("key"), np.int64).view(np.uint64), np.asarray(hot.column("n"), np.int64)
    order = np.argsort(key)
    small = {(r["kind"], r["key"]): r["n"] for r in found.where("kind > 0").collect()}
    light = boundary({k: n for (kind, k), n in small.items() if kind == 1}, small.get((2, 0), 0) / max(small.get((2, 1), 0), 1))
    sets = materialize(_sets(docs, key[order], often[order], light), "sets")

    # classes on a list with others
    flat = sets.select("cls", "n", F.posexplode("prefix").alias("pos", "shingle"))
    shared = flat.groupBy("shingle").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("shingle")
    postings = materialize(flat.join(shared, "shingle").select("shingle", "cls", "n", "pos").distinct(), "postings")

    # one text and set of bitmaps per class that is on such a list: of one of its rows, known by id and text
    first = sets.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("r"))
    reps = first.join(postings.select("cls").distinct(), "cls").select("cls", F.col("r.doc_id").alias("r_id"), F.col("r.th").alias("r_th"))
    reps = materialize(reps, "representatives")
    reps = F.broadcast(reps) if reps.count() <= broadcast_ids else reps
    own = lambda d, th: d.join(reps.withColumnRenamed("cls", "r_cls"), F.col("doc_id").eqNullSafe(F.col("r_id")) & (th == F.col("r_th"))).dropDuplicates(["r_cls"])
    texts = materialize(own(docs, F.xxhash64("text")).select(F.col("r_cls").alias("cls"), "text"), "texts")
    sketches = materialize(own(sets, F.col("th")).select("cls", "n", "sketch", "narrow"), "sketches")
    folds, sketches = sketches.select("cls", "narrow"), sketches.select("cls", "n", "sketch")

    # rounds of few pairs, first of some lists, then of all that hold several components: they connect most of large groups
    now = postings.where(F.pmod(F.xxhash64("shingle"), F.lit(FIRST_LISTS)) == 0).withColumn("comp", F.col("cls"))
    links = materialize(_light_edges(sets).union(_verify(_near_pairs(now, light, 0), sketches, texts)), "links")
    now, comp = _labelled(postings, links)
    before, easy = _apart(now)
    for k in range(1, ROUNDS):
        if easy:
            break
        more = materialize(_verify(_near_pairs(now, light, k), sketches, texts), "more_links")
        links = links.union(more)
        now, comp = _labelled(now, links)
        after, easy = _apart(now)
        if before - after < 0.2 * before:
            break
        before = after

    # then all pairs of each list that are still in different components
    rest = materialize(_verify(_list_pairs(now, folds, light, block), sketches, texts), "last_links")
    if not rest.isEmpty():
        comp = components(links.union(rest))

    grouped = materialize(sets.join(comp, sets.cls == comp.node, "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("grp")), "grouped")
    least = materialize(grouped.where("grp IS NOT NULL").groupBy("grp").agg(F.min("doc_id").alias("least")), "least_ids")
    out = grouped.join(least, "grp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of similar documents the one with the smallest doc_id stays (rows with a
    null id stay), with the columns it came with."""
    gone = similar_documents(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""
