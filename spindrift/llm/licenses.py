"""Operator 13: license scans by template markup compiled to token automata.

A template is a license's wording with markup: ``<<beginOptional>> ... <<endOptional>>`` encloses words that may be left
out (regions may be nested), ``<<var;name=N;match=REGEX;words=LO-HI>>`` stands for LO to HI words that each match REGEX
(any word, and exactly one, where not given). Everything else is mandatory wording. A template becomes an automaton
over words; a text holds the license where the automaton accepts a run of its words, that is, where the mandatory
wording matches word by word. Case of A-Z, punctuation and white space don't count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SIGNS, modest_batches, small_parts, table, text_bytes, word_spans
from .license_texts import TEMPLATES

#: Base phrases and their labels, fixed by the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What a match of each kind says at most: a whole text, a notice, a phrase, and a text that breaks off (times its matched share).
TEXT, NOTICE, PHRASE, BROKEN = 1.0, 0.9, 0.5, 0.8

_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_MARK = re.compile(r"<<(.*?)>>", re.S)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def lower_ascii(text: bytes) -> str:
    return text.lower().decode()  # of bytes, A-Z only


@dataclass
class Automaton:
    """Words of a template as a nondeterministic automaton whose state sets are made when they are reached.

    ``moves[s]`` are (word or None, pattern or None, next, name) of state s, ``free[s]`` moves without a word;
    ``done[s]`` is the number of mandatory words before s. The memo of transitions is cleared when it outgrows MEMO.
    """

    label: str
    whole: bool
    moves: list = field(default_factory=list)
    free: list = field(default_factory=list)
    done: list = field(default_factory=list)
    memo: dict = field(default_factory=dict)
    MEMO = 50_000

    def state(self, done: int) -> int:
        self.moves.append([])
        self.free.append([])
        self.done.append(done)
        return len(self.moves) - 1

    def close(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: str) -> frozenset:
        key = states, word
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            found = self.close({t for s in states for w, p, t, _ in self.moves[s] if (w == word if w is not None else p is None or p.fullmatch(word))})
            self.memo[key] = found
        return found

    def starts(self) -> tuple[set[str], set[tuple[str, str]]]:
        """First words after which anything may come, and first pairs of words. A template begins with a word."""
        singles, pairs = set(), set()
        for s in self.close({0}):
            for w, _, t, _ in self.moves[s]:
                if w is None:
                    raise ValueError(f"{self.label}: a template must not begin with a replaceable region")
                for u in self.close({t}):
                    if u == self.end:
                        singles.add(w)
                    for v, *_ in self.moves[u]:
                        singles.add(w) if v is None else pairs.add((w, v))
        return singles, {p for p in pairs if p[0] not in singles}

    def walk(self, word, at: int, end: int) -> tuple[int | None, float]:
        """The end of the longest accepted run of words from ``at`` (None: none), and the matched share of the wording."""
        states, got, far = self.close({0}), None, 0
        while at < end and states:
            states = self.step(states, word(at))
            at += 1
            if self.end in states:
                got = at
            far = max(far, max((self.done[s] for s in states), default=0))
        return got, 1.0 if got is not None else far / max(self.total, 1)

    def captures(self, words: list[str]) -> dict[str, str]:
        """The words of each replaceable region of an accepted run; earlier regions take as many as they can."""
        takes = lambda v, p, w: v == w if v is not None else p is None or p.fullmatch(w)
        alive = [self._reaching({self.end})]  # at the end: states from which the words that are left lead to acceptance
        for w in reversed(words):
            alive.append(self._reaching({s for s in range(len(self.moves)) for v, p, t, _ in self.moves[s] if t in alive[-1] and takes(v, p, w)}))
        alive.reverse()
        out: dict[str, list[str]] = {}
        states = self.close({0})
        for w, good in zip(words, alive[1:], strict=True):
            options = [(name is not None, t, name) for s in states for v, p, t, name in self.moves[s] if t in good and takes(v, p, w)]
            _, s, name = max(options, key=lambda o: o[:2])
            if name:
                out.setdefault(name, []).append(w)
            states = self.close({s})
        return {k: " ".join(v) for k, v in out.items()}

    def _reaching(self, goal: set[int]) -> set[int]:
        """The states that reach one of ``goal`` without a word."""
        goal = set(goal)
        for s in range(len(self.free) - 1, -1, -1):  # moves without a word only lead forward
            if s not in goal and any(f in goal for f in self.free[s]):
                goal.add(s)
        return goal


def compile_template(label: str, markup: str, whole: bool) -> Automaton:
    """The automaton of one template; ``whole`` tells a license's text from a notice that names it."""
    a = Automaton(label, whole)
    now, open_at, at = a.state(0), [], 0
    done = 0

    def read(words):
        nonlocal now, done
        for w in words:
            done += not open_at
            nxt = a.state(done)
            a.moves[now].append((w, None, nxt, None))
            now = nxt

    for m in _MARK.finditer(markup):
        read(_WORDS.findall(lower_ascii(markup[at : m.start()].encode())))
        at = m.end()
        kind, *fields = m[1].split(";")
        if kind == "beginOptional":
            open_at.append(now)
        elif kind == "endOptional":
            a.free[open_at.pop()].append(now)
        elif kind == "var":
            given = dict(f.split("=", 1) for f in fields)
            low, high = map(int, given.get("words", "1-1").split("-"))
            pattern = re.compile(given["match"]) if "match" in given else None
            skips = []
            for k in range(high):
                if k >= low:
                    skips.append(now)
                nxt = a.state(done)
                a.moves[now].append((None, pattern, nxt, given.get("name", "var")))
                now = nxt
            for s in skips:
                a.free[s].append(now)
        else:
            raise ValueError(f"{label}: unknown markup {m[0]}")
    if open_at:
        raise ValueError(f"{label}: an optional region doesn't end")
    read(_WORDS.findall(lower_ascii(markup[at:].encode())))
    a.end, a.total = now, done
    return a


def _hash(words: list[str]) -> np.ndarray:
    """The words' hashes, as ``word_spans`` has them."""
    body = [w.encode() for w in words]
    return word_spans(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]), True, SIGNS)[0]


class Scanner:
    """Phrases and automata of a set of templates, applied to Arrow arrays of texts."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.automata = [compile_template(*t) for t in templates]
        self.phrases = [(p.split(" "), label) for p, label in phrases.items()]
        self.phrase_hashes = [_hash(p) for p, _ in self.phrases]
        self.begin = []
        for a in self.automata:
            singles, pairs = a.starts()
            x, y = (_hash([p[k] for p in sorted(pairs)]) for k in (0, 1))
            self.begin.append((_hash(sorted(singles)), x * _PAIR + y))

    def scan(self, column) -> tuple[np.ndarray, list[list[dict]]]:
        """Number of words of each text, and its matches."""
        data, offsets = text_bytes(column)
        h, counts, start, end = word_spans(data, offsets, True, SIGNS)
        first = np.concatenate(([0], np.cumsum(counts)))
        text = data[offsets[0] : offsets[-1]]
        word = lambda i: lower_ascii(text[start[i] : end[i]].tobytes())
        found: list[list[dict]] = [[] for _ in counts]
        of = lambda i: int(np.searchsorted(first, i, "right")) - 1

        def add(doc, label, kind, a, b, score):
            found[doc].append({"label": label, "kind": kind, "first_word": a - int(first[doc]), "end_word": b - int(first[doc]), "score": score})

        pair = h[:-1] * _PAIR + h[1:]
        for (words, label), want in zip(self.phrases, self.phrase_hashes, strict=True):
            n = len(words)
            at = np.flatnonzero(h == want[0])
            for j in range(1, n):
                at = at[at + j < len(h)]
                at = at[h[at + j] == want[j]]
            for i in at.tolist():
                doc = of(i)
                if i + n <= first[doc + 1] and [word(i + j) for j in range(n)] == words:
                    add(doc, label, "phrase", i, i + n, PHRASE)
        for a, (one, two) in zip(self.automata, self.begin, strict=True):
            hit = np.isin(h, one)
            hit[: len(pair)] |= np.isin(pair, two)
            past = -1
            for i in np.flatnonzero(hit).tolist():
                if i < past:
                    continue
                doc = of(i)
                got, share = a.walk(word, i, int(first[doc + 1]))
                if got is not None:
                    values = a.captures([word(k) for k in range(i, got)]) if "{" in a.label else {}
                    label = re.sub(r"-?\{(\w+)\}", lambda m: "-" * (m[1] in values) + values.get(m[1], "").replace(" ", ".").upper(), a.label)  # noqa: B023
                    add(doc, label, "text" if a.whole else "notice", i, got, TEXT if a.whole else NOTICE)
                    past = got
                elif a.whole and share >= 0.5:
                    add(doc, a.label, "broken", i, i, BROKEN * share)
        return counts, found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, matches (label, kind, first_word, end_word, score).

    ``kind`` is ``text`` (a whole license), ``notice`` (a sentence that names one), ``phrase`` (a base phrase) or
    ``broken`` (a license's text that departs from its wording after half of it or more; no label is given for it).
    Matches of one template don't overlap and are the longest from their start; those of different ones may. A match
    lies in one text. Null and empty texts have no words and no matches; repeated rows, null ids and ties are scanned
    like other rows; an empty table gives none; other columns are not carried, so their names can't clash. Whole
    texts of any length are read, in parts of some megabytes (a text is never cut), and rows are scanned where
    they are, without a shuffle.
    """
    import pyarrow as pa

    kinds = [("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]
    matches = pa.list_(pa.struct(kinds))

    def run(batches):
        scanner = Scanner(templates, phrases)
        for b in small_parts(batches, "text"):
            counts, found = scanner.scan(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, matches)], names=["doc_id", "n_words", "matches"])

    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = "label: string, kind: string, first_word: long, end_word: long, score: double"
    return rows.mapInArrow(run, f"doc_id long, n_words long, matches array<struct<{fields}>>")


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["kind"] == "phrase")
    given = F.filter("matches", lambda m: m["kind"] != "broken")
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(given).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
        F.size(F.filter("matches", lambda m: m["kind"].isin("text", "notice"))).cast("long").alias("n_templates"),
    )
