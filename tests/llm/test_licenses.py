"""License templates against a matcher that tries every way to read them."""

import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F
from spindrift.llm import licenses
from spindrift.llm.license_texts import TEMPLATES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MARK = re.compile(r"<<.*?>>", re.S)


def lower(s):
    return s.encode().lower().decode()


def written(markup, rnd=None, holder="Jane Roe"):
    """One text that a template accepts: optional regions all there, or drawn."""
    out, skip, at = [], 0, 0
    for m in MARK.finditer(markup):
        if not skip:
            out.append(markup[at : m.start()])
        at = m.end()
        if m[0].startswith("<<begin"):
            skip += bool(skip or (rnd and rnd.random() < 0.5))
        elif m[0].startswith("<<end"):
            skip -= bool(skip)
        elif not skip:
            out.append(" 2 " if "match=[0-9]" in m[0] else " nc " if "match=nc" in m[0] else " https " if "match=https" in m[0] else f" {holder} ")
    return "".join([*out, markup[at:]])


@pytest.mark.parametrize("k", range(len(TEMPLATES)))
def test_templates_accept_their_variants(k):
    import pyarrow as pa

    label, markup, whole = TEMPLATES[k]
    rnd, scanner = random.Random(k), licenses.Scanner([TEMPLATES[k]], {})
    holder = "Jane" if "words=1-1>>" in markup else "Jane Roe"
    texts = [f"Before it. {written(markup, rnd if i else None, holder)} After it." for i in range(10)]
    for text, found in zip(texts, scanner.scan(pa.array(texts))[1]):
        assert [m["kind"] for m in found] == ["text" if whole else "notice"], text
        assert "{" not in found[0]["label"] and found[0]["label"].startswith(label.split("{")[0].rstrip("-"))


def test_a_changed_mandatory_word_is_not_accepted():
    import pyarrow as pa

    scanner, rnd = licenses.Scanner(), random.Random(3)
    for label, markup, whole in TEMPLATES:
        if not whole:
            continue
        plain = WORD.findall(lower(written(MARK.sub(lambda m: m[0] if "var" in m[0] else "", markup))))
        kept = [i for i, w in enumerate(plain) if w not in ("jane", "roe", "2", "https")]
        for i in rnd.sample(kept[5:], 8):
            broken = [*plain[:i], "banana", *plain[i + 1 :]]
            ((_, found),) = [scanner.scan(pa.array([" ".join(broken)]))]
            assert label.split("{")[0] not in {m["label"][: len(label.split("{")[0])] for m in found[0] if m["kind"] == "text"}, (label, plain[i])


def accepts(parts, words):
    """Whether ``words`` are read by ``parts`` (a word, ('?', parts) or ('*', low, high)): every way is tried."""
    if not parts:
        return not words
    p, rest = parts[0], parts[1:]
    if isinstance(p, str):
        return bool(words) and words[0] == p and accepts(rest, words[1:])
    if p[0] == "?":
        return accepts(rest, words) or accepts([*p[1], *rest], words)
    return any(accepts(rest, words[n:]) for n in range(p[1], min(p[2], len(words)) + 1))


def markup_of(parts):
    return " ".join(p if isinstance(p, str) else f"<<beginOptional>>{markup_of(p[1])}<<endOptional>>" if p[0] == "?" else f"<<var;name=x;words={p[1]}-{p[2]}>>" for p in parts)


def test_automata_against_trying_every_way():
    rnd = random.Random(5)

    def parts(depth, n):
        kinds = [rnd.random() for _ in range(n)]
        return [("?", parts(depth + 1, rnd.randint(1, 2))) if k < 0.25 and depth < 2 else ("*", lo := rnd.randint(0, 1), lo + rnd.randint(0, 2)) if k < 0.4 else rnd.choice("abc") for k in kinds]

    for _ in range(300):
        p = ["a", *parts(0, rnd.randint(1, 5))]
        a = licenses.compile_template("x", markup_of(p), True)
        for _ in range(20):
            w = ["a", *(rnd.choice("abc") for _ in range(rnd.randint(0, 7)))]
            want = [n for n in range(1, len(w) + 1) if accepts(p, w[:n])]
            got, share = a.walk(lambda i: w[i], 0, len(w))
            assert got == (max(want) if want else None) and 0 <= share <= 1
            if got:
                assert isinstance(a.captures(w[:got]), dict)


def brute(text):
    """n_words, n_base, first, last and base labels, word by word."""
    w = WORD.findall(lower(text or ""))
    hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


ROWS = [
    (1, "Released under the MIT License. MIT-LICENSE, cc by, CC\nBY; apache license gnu General-public\tLICENSE"), (1, "mit license"), (1, "mit license"), (2, None), (3, ""), (4, "..."), (None, "mit licenses; amit license"),
    (5, "é mit license é cc 'by' " * 3000), (6, "MİT LICENSE mit license cc by"), (7, "cc cc by by"), (8, "gnu general public"), (9, "mit"),
]


def test_base_columns(spark, tmp_path):
    clash = {c: F.lit("clash") for c in ("matches", "score", "labels", "n_words", "label", "kind")}
    spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op13_license_scans(spark, str(tmp_path)).collect()
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(repr, ((*(r[n] for n in names),) for r in got))) == sorted(repr((i, *brute(t))) for i, t in ROWS)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (r["labels"] != "")


def test_given_table(spark):
    got = {r["doc_id"]: r for r in licenses.op13_license_scans(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute(r["text"])


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_faulty_markup():
    for bad in ("a <<beginOptional>> b", "a <<other>>"):
        with pytest.raises(ValueError):
            licenses.compile_template("x", bad, True)
    with pytest.raises(ValueError):
        licenses.Scanner([("x", "<<var;name=a>> b", True)])
