import random
import re

import numpy as np
import pyarrow as pa
import pytest
from spindrift.llm.common import components, shingles, split_batches, text_bytes, word_hashes, word_spans

TEXTS = ["", None, "a b  c", " lead", "trail ", "Ünïcode ünïcode", "x\ty\nz\x0bq\x0cr\rs", "A a", "word", "long " * 400, "\xa0"]


def spread(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(999, i) for i in range(80)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)], "none": [(5, 5)]}[kind]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == spread(nodes, [e for e in edges if e[0] != e[1]])


def test_word_hashes_tell_words_apart():
    data, offsets = text_bytes(pa.array(TEXTS))
    h, counts, start, end = word_spans(data, offsets)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert counts.tolist() == [len(w) for w in words]
    body = data[offsets[0] :].tobytes()
    flat = [w for ws in words for w in ws]
    assert [body[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)] == flat
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in flat]
    assert len(set(h.tolist())) == len(set(low)) and {(a, b) for a, b in zip(low, h.tolist(), strict=True)}.__len__() == len(set(low))


def test_hashes_do_not_depend_on_batches():
    texts = ["some words here", "and more words there", "x " * 3000] * 200
    whole = word_hashes(*text_bytes(pa.array(texts)))[0]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [word_hashes(*text_bytes(p.column(0)))[0] for p in split_batches(batch, "text", 5000)]
    assert len(parts) > 10 and (np.concatenate(parts) == whole).all()


def test_shingles():
    data, offsets = text_bytes(pa.array(TEXTS))
    h, counts = word_hashes(data, offsets)
    s, sizes = shingles(h, counts, 3)
    assert sizes.tolist() == [max(n - 2, 1) if n else 0 for n in counts.tolist()]
    a, _ = shingles(*word_hashes(*text_bytes(pa.array(["p q r s", "q r s t"]))), 3)
    assert a[1] == a[2] and len(set(a.tolist())) == 3
