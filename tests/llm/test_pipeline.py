"""The pipeline's stages against brute force, on whole tables; toxicity features against plain counts."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import test_jaccard
import test_mixing
from conftest import SF
from spindrift.llm import mixing, toxicity
from test_operators import WORD, brute_lines
from tokenizers import Tokenizer


def kept_by_mixing(rows):
    """Ids that are sampled: twenty sweeps of fitting, the calibration constant, and a hash of the id, all in plain loops."""

    def topic(text, n):
        if re.search("(?i)licen[sc]e|all rights reserved", text):
            return "licence"
        if re.search("@|https?://", text):
            return "contact"
        return "table" if " | " in text else "long_prose" if n >= 500 else "short_prose"

    cells, of = {}, {}
    for r in rows:
        n = len(WORD.findall(r["text"] or ""))
        of[r["doc_id"]] = key = (r["source"] or "unknown", r["lang"] or "unknown", topic(r["text"] or "", n))
        cells[key] = cells.get(key, 0) + n
    total, want = sum(cells.values()), {}
    for k, d in enumerate(mixing.DIMS):
        mass = {}
        for key, v in cells.items():
            mass[key[k]] = mass.get(key[k], 0) + v
        want[d] = {c: (v / total) ** mixing.TEMPER[d] for c, v in mass.items()}
    w = test_mixing.brute([(*k, float(v)) for k, v in cells.items()], want, 20)
    weight = {k: w[k] / v if v else 0.0 for k, v in cells.items()}
    order = sorted(cells, key=lambda k: (-weight[k], k))
    c = None
    for i, k in enumerate(order):
        rest = sum(cells[x] * weight[x] for x in order[i:])
        now = (0.75 * total - sum(cells[x] for x in order[:i])) / rest if rest else None
        if now and now > 0 and now * weight[k] <= 1:
            c = now
            break
    p = {k: 0.75 if not cells[k] else 1.0 if c is None else min(1.0, c * weight[k]) for k in cells}
    draw = lambda i: int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:13], 16) / 2**52
    return {i for i, k in of.items() if draw(i) < p[k]}


def test_stages_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.materialize(stage(spark, steps[-1], SF), f"brute_{name}"))
    given, clean, lined, unique, mixed, pieces = ([r.asDict() for r in s.collect()] for s in steps)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in given if scored[r["doc_id"]] < 0.5} and clean
    lines = brute_lines([(r["doc_id"], r["text"]) for r in clean])
    assert {r["doc_id"]: r["text"] for r in lined} == {i: t for i, (t, _) in lines.items()}
    old = {r["doc_id"]: r for r in clean}
    for r in lined:
        n = len(r["text"]) if lines[r["doc_id"]][1] else old[r["doc_id"]]["n_chars"]
        assert {**r, "text": 0} == {**old[r["doc_id"]], "text": 0, "n_chars": n}
    groups = {d: c for d, _, c in test_jaccard.brute([(r["doc_id"], r["text"]) for r in lined])}
    key = lambda r: r["doc_id"]
    assert sorted(unique, key=key) == sorted((r for r in lined if groups[r["doc_id"]] == r["doc_id"]), key=key)
    chosen = kept_by_mixing(unique)
    assert sorted(mixed, key=key) == sorted((r for r in unique if r["doc_id"] in chosen), key=key) and 0 < len(mixed) < len(unique)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in mixed}
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    sequences = {}
    for r in pieces:
        own = ids[r["doc_id"]]
        part = np.array(own[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        seen[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((x == 1).all() for x in seen.values())
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def plain_features(text, lexicon):
    """The dense features, counted character by character and word by word."""
    text = text or ""
    letter = lambda c: c.isalnum() and not c.isdecimal() and re.match(r"[^\W\d_]", c) is not None

    def runs(s):
        out, now = [], ""
        for c in [*s, " "]:
            if letter(c):
                now += c
            elif now:
                out.append(now)
                now = ""
        return out

    words = runs(text.lower())
    n, size = len(words), max(len(words), 1)
    weigh = lambda w: lexicon.get(w) or (len(w) >= 4 and (lexicon.get("4:" + w[:4]) or lexicon.get("5:" + w[:5]))) or 0.0
    hits = [(i, weigh(w)) for i, w in enumerate(words) if weigh(w)]
    you = [i for i, w in enumerate(words) if w in toxicity.YOU]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i, _ in hits)
    odd = toxicity.disguised(text)
    undone = ["".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}.get(c, "" if c in "*._- " else c) for c in w.lower()) for w in odd]
    odd_hits = sum(w in lexicon or "4:" + w[:4] in lexicon and len(w) >= 4 or "5:" + w[:5] in lexicon and len(w) >= 5 for w in undone)
    weights = [w for _, w in hits]
    letters = sum(len(w) for w in words)
    return [
        math.log1p(n), len(hits) / size, math.log1p(len(hits)), max([0.0, *weights]), sum(weights) / size, near / size, len(you) / size, sum(w.isupper() for w in text.split()) / size,
        sum(c in "!?" for c in text) / size, max(0, len(text) - letters - sum(c == " " for c in text)) / max(len(text), 1), len(odd) / size, float(odd_hits),
    ]


def test_features_against_plain_counts(docs001):
    lexicon = {"idiot": 3.0, "loser": 2.5, "4:stup": 2.0, "5:trott": 1.5, "du": 0.5, "ass": 1.0}
    texts = [r["text"] for r in docs001.collect()]
    texts += [None, "", " ", "You IDIOT! such l0sers, i-d-i-o-t", "you " * 30 + "stupid", "st", "STUPID?! trottel", "1d1ot a.s.s", "é É ß ẞ İ 日本 ١٢", "a_b you_idiot", "x " * 5000, "idiot " * 3000 + "you", "d u m m  i d i o t", "!?!?", "l.o-s_e r"]
    for t in texts:
        got, want = toxicity.features(t, lexicon), plain_features(t, lexicon)
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want)), (t, got, want)


def test_disguised_words():
    assert sorted(toxicity.disguised("such l0sers, i-d-i-o-t and s t u p i d or plain")) == sorted(["l0sers", "i-d-i-o-t", "s t u p i d"])
    assert toxicity.disguised("plain words, 12 numbers and-dashes.") == ["and-dashes"] and toxicity.disguised("") == []
