"""Operator 7: secret scans by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, small_parts, table
from .lexing import Lexer

#: Base patterns, fixed by the contract. Letters of the names may have either case (ASCII only).
_NAME = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"({_NAME})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # whole runs of [0-9a-f]+
KINDS = ("assign", "access", "hex", "flow")

#: Name parts that make a target sensitive, with the score each adds.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.5, "key": 0.5, "api": 0.4, "access": 0.4, "auth": 0.6, "bearer": 0.8,
    "signing": 0.4, "client": 0.1, "jwt": 0.7, "conn": 0.2, "dsn": 0.5,
}

_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: A sensitive target (0.5 at least) has a part of 0.4 or more: a text without one, or without an operator or an element, has none.
_STRONG = sorted((k for k, v in SENSITIVE.items() if v >= 0.4), key=len)
HINTS = [k for i, k in enumerate(_STRONG) if not any(x in k for x in _STRONG[:i])]


def may_assign(text: str) -> bool:
    """Whether a text could have a sensitive target: those without are not lexed, which loses nothing."""
    if not ("=" in text or ":" in text or "</" in text):
        return False
    low = text.lower()
    return any(h in low for h in HINTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the contract's base matches, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    """How sensitive a target's name is: its parts (snake, dotted, camel case) are scored, at most 1."""
    return min(1.0, sum(SENSITIVE.get(p.lower(), 0.0) for p in dict.fromkeys(_PARTS.findall(name.replace("$", "")))))


def literal_score(value: str) -> float:
    """How much a literal looks like a credential: length, mixed character classes and entropy, 0 to 1."""
    return counted_score(Counter(value))


def counted_score(counts: Counter) -> float:
    """``literal_score`` of a value of which the number of each character is known."""
    n = sum(counts.values())
    if n < 8 or " " in counts:
        return 0.0
    classes = sum(any(map(re.compile(p).match, counts)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return min(1.0, 0.15 * classes + 0.15 * entropy)


def flow_spans(text: str, threshold: float = 0.75) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive target, directly or through names assigned before (see ``lexing``).

    Targets are names with or without a type, quoted keys, subscripts with a quoted key and XML elements; values are strings
    (of any quotes, over any lines), bare words of env, ini and YAML files, and YAML blocks, and what + . .. or mere
    neighbourhood joins, also on the next line. A name, $NAME, ${NAME} or a name in a formatted string stands for
    the literals last bound to it in its function or outside of it; a parameter stands for nothing. A literal is reported when the
    product of its target's name score and its own score reaches ``threshold`` squared, with a name score of 0.5 at least.
    """
    out: set[tuple[int, int]] = set()
    if not may_assign(text):
        return []
    told: set[int] = set()
    every = []  # keeps literals alive, for told
    for name, value in Lexer(text).assignments():
        every.append(value)
        score = name_score(name)
        if score >= 0.5 and score * counted_score(value.counts) >= threshold * threshold:
            out.update(value.spans(told))
    return sorted(out)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    joined = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
    extra = [(a, 3, b) for a, b in flow_spans(text)]
    every = joined if not extra else [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted([*base, *extra])]
    n = Counter(k for _, k, _ in base)
    return n[0], n[1], n[2], hashlib.sha256(",".join(joined).encode()).hexdigest(), ",".join(every)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    Null and empty texts have no spans (base_sha256 is that of the empty string); repeated rows and null ids
    are scanned like others. Spans are code points, end exclusive. No shuffle: rows are scanned where they are.
    """
    import pyarrow as pa

    def run(batches):
        for b in small_parts(batches, "text"):
            got = [scan(x) for x in b.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
