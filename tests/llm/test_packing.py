import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from spindrift.llm.packing import LENGTH, Shard, Tokens, corpus_of, pack, packed, ranges_of
from tokenizers import Tokenizer

ODD = [None, "", "   ", "it's THE end, I'm 42 years.\n\nÀ côté", "naïve 日本語 テスト", "a b", "x<|endoftext|>y", "Σίσυφος ΣΑΣ", "été", "\x1cab\x1d", "İstanbul", "ſ K Å ﬁ", "..!!'s 's don't WE'LL", "word " * 5000]


def expected(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_ids_equal_the_tokenizers():
    t = Tokens(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):
        got, _terms = t.encode(pa.array(ODD))
        assert [g.tolist() for g in got] == expected(ODD)


def test_ids_of_documents(docs001):
    texts = [r["text"] for r in docs001.select("text").collect()]
    t = Tokens(public_tokenizers.path("word_bpe_49k.json"), capacity=2000)
    got = [g.tolist() for i in range(0, len(texts), 20) for g in t.encode(pa.array(texts[i : i + 20]))[0]]
    assert got == expected(texts)


@pytest.mark.parametrize("sizes", [[], [1], [2048], [5000, 3, 3], [1000] * 7, [2047, 1, 2049]])
def test_pack_covers_every_id_once(sizes):
    rng = np.random.default_rng(1)
    shard = Shard([rng.integers(0, 30, 20) for _ in sizes])
    check([(d, a, n, s, o) for d, a, n, s, o in pack(sizes, shard)], dict(enumerate(sizes)))


def check(pieces, sizes):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, a, n, s, o in pieces:
        assert n > 0
        by_doc[d].append((a, n))
        by_seq[s].append((o, n))
    assert set(by_doc) == {d for d, n in sizes.items() if n}
    for d, x in by_doc.items():
        at = 0
        for a, n in sorted(x):
            assert a == at
            at += n
        assert at == sizes[d]
    for x in by_seq.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= LENGTH and at & (at - 1) == 0  # full, or a power of two


def test_round_trip(spark, docs001):
    rows = packed(docs001).collect()
    ids = dict(zip([r["doc_id"] for r in docs001.collect()], expected([r["text"] for r in docs001.collect()]), strict=True))
    check([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in rows], {d: len(x) for d, x in ids.items()})
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])


def test_neighbours_share_rare_terms():
    shard = Shard([np.array([1, 2, 3]), np.array([9, 8]), np.array([3, 2, 7]), np.array([3, 6])])
    assert list(shard.neighbours(0))[:2] == [0, 2] and 1 not in list(shard.neighbours(0))
    assert list(shard.neighbours(0)) == list(shard.neighbours(0, first=1)) == list(shard.neighbours(0, first=2))


def test_edges(spark):
    df = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "x y", "c"), (1, "x y", "c")], "doc_id long, text string, offset string")
    rows = packed(df).collect()
    assert sum(r["length"] for r in rows) == 8 and packed(df.limit(0)).count() == 0


def test_all_terms_of_a_seed_query():
    shared = np.array([500] * 3)
    shard = Shard([np.concatenate((np.repeat(np.arange(40), 4), shared[:1])), np.repeat(np.arange(40), 4), shared])
    assert 2 in list(shard.neighbours(0))


def test_statistics_are_of_all_documents(spark):
    rows = [(i, f"common w{i % 7} w{i % 7} only{i}") for i in range(70)] + [(70, None), (71, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    corpus = corpus_of(df)
    t = Tokens(public_tokenizers.path("word_bpe_49k.json"))
    t.encode(pa.array(["common w3 only5 absent"]))
    assert corpus.frequencies(t.hashes).tolist() == [{"common": 70, "w3": 10}.get(w, 1) for w in sorted("common w3 only5 absent".split(), key=lambda w: t.hashes.tolist().index(hash_of(w)))]
    assert (corpus.n, corpus.mean) == (72, 280 / 72)


def hash_of(word):
    from spindrift.llm.common import text_bytes, word_spans

    return int(word_spans(*text_bytes(pa.array([word])), lower=False)[0][0])


def test_related_documents_meet_across_storage(spark):
    """Pairs that lie in different partitions of the input share a window, though each partition has enough of its own."""
    rng = np.random.default_rng(3)
    noise = lambda: " ".join(f"n{k}" for k in rng.integers(0, 400, 300))
    topic = [" ".join(f"topic{p}x{k}" for k in range(60)) for p in range(40)]
    rows = [(p, f"{topic[p]} {noise()}") for p in range(40)] + [(1000 + i, noise()) for i in range(400)] + [(100 + p, f"{topic[p]} {noise()}") for p in range(40)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    at = defaultdict(set)
    for r in packed(df).collect():
        at[r["doc_id"]].add(r["sequence_id"])
    assert sum(bool(at[p] & at[100 + p]) for p in range(40)) >= 30


def test_scores_and_order_against_plain_bm25():
    """Neighbours come in the order of BM25 sums over all terms of the seed that are worked out word by word."""
    rng = np.random.default_rng(9)
    terms = [rng.integers(0, 60, rng.integers(1, 50)) for _ in range(80)]
    df = {t: sum(t in set(x.tolist()) for x in terms) for t in range(60)}
    mean = sum(map(len, terms)) / len(terms)
    shard = Shard(terms)
    for d in (0, 7, 79):
        want = {}
        for k, x in enumerate(terms):
            score = 0.0
            for t in set(terms[d].tolist()):
                if df[t] > 1 and (tf := int((x == t).sum())):
                    score += np.log(1 + (len(terms) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
            if score:
                want[k] = score
        got = list(shard.neighbours(d, first=5))
        assert set(got) == set(want) and all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_greedy_filling_against_a_plain_loop():
    rng = np.random.default_rng(10)
    sizes = rng.integers(1, 900, 40).tolist()
    shard = Shard([rng.integers(0, 40, 20) for _ in sizes])
    order = {d: list(shard.neighbours(d)) for d in range(40)}
    left, want = dict(enumerate(sizes)), []
    while left:
        seed = min(left, key=lambda d: (-sizes[d], d))
        room, line = LENGTH, []
        for d in [seed, *order[seed], *sorted(range(40), key=lambda d: (-sizes[d], d))]:
            if room and d in left:
                take = min(room, left[d])
                line.append((d, sizes[d] - left[d], take))
                room -= take
                left[d] -= take
                if not left[d]:
                    del left[d]
        want.append(line)
    got = defaultdict(list)
    for d, a, n, s, o in pack(sizes, shard):
        got[s].append((o, d, a, n))
    full = [[(d, a, n) for _, d, a, n in sorted(x)] for _, x in sorted(got.items()) if sum(k[3] for k in x) == LENGTH]
    assert full == [x for x in want if sum(n for *_, n in x) == LENGTH]


def test_ranges_against_a_plain_count():
    rng = np.random.default_rng(2)
    keys = tuple(rng.integers(-3, 3, 200) for _ in range(3))
    bounds = [tuple(x) for x in sorted(rng.integers(-3, 3, (7, 3)).tolist())]
    got = ranges_of(keys, tuple(np.array(c) for c in zip(*bounds, strict=True)))
    assert got.tolist() == [sum(b <= k for b in bounds) for k in zip(*(x.tolist() for x in keys), strict=True)]
    assert ranges_of(keys, (np.zeros(0, np.int64),) * 3).tolist() == [0] * 200


def test_equal_rows_spread_over_tasks(spark, monkeypatch):
    """Rows equal in id and text fill shards of several tasks, not of one."""
    from spindrift.llm import packing

    monkeypatch.setattr(packing, "SHARD_BYTES", 20_000)
    df = spark.createDataFrame([(None, "the same words in every one of these rows")] * 4000, "doc_id long, text string").repartition(4)
    rows = packed(df).select("sequence_id", "length", "doc_tokens").collect()
    parts = {}
    for r in rows:
        parts[r["sequence_id"] >> 36] = parts.get(r["sequence_id"] >> 36, 0) + r["length"]
    assert sum(parts.values()) == 4000 * rows[0]["doc_tokens"] and len(parts) >= 4 and max(parts.values()) < 0.5 * sum(parts.values())


def test_frequencies_in_several_files(spark, monkeypatch):
    from spindrift.llm import packing

    monkeypatch.setattr(packing, "TERMS_A_FILE", 50)
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 30))) for i in range(300)], "doc_id long, text string")
    corpus = corpus_of(df)
    assert len(corpus.files) > 3 and [f for _, f, _ in corpus.files] == sorted(f for _, f, _ in corpus.files)
    words = [f"w{k}" for k in range(340)]
    want = [max(1, min(k, 29, 328 - k) + 1) if k < 329 else 1 for k in range(340)]
    hashes = packing.word_spans(*packing.text_bytes(pa.array([" ".join(words)])), lower=False)[0]

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": corpus.frequencies(hashes)})

    assert [r["n"] for r in spark.range(1).coalesce(1).mapInArrow(run, "n long").collect()] == want


def test_neighbours_that_are_wanted():
    """Documents without a rest are left out before they are put in order, and the others keep theirs."""
    rnd = np.random.default_rng(3)
    s = Shard([rnd.integers(0, 60, 40) for _ in range(200)])
    wanted = rnd.random(200) < 0.4
    for d in range(0, 200, 7):
        assert list(s.neighbours(d, wanted=wanted)) == [x for x in s.neighbours(d) if wanted[x]]
