"""Operator 2: quality rules combined by weak supervision. Native: DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the counted vote patterns (3 to the
number of rules at most, whatever the input) estimates each rule's accuracy on good and on bad documents; a
document is kept when its posterior probability of being good is 0.5 or more and the base rules don't fail it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, materialize, table, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Very common words of the four languages; a text of any length without two of them is suspect.
COMMON = ("the", "of", "and", "to", "in", "is", "that", "de", "la", "le", "les", "et", "des", "que", "el", "los", "en", "y", "der", "die", "und", "das", "den", "von", "zu")

#: name -> (good when, bad when), over the measures; neither: the rule abstains.
RULES = {
    "length": ("n_words >= 80", "n_words < 30"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 9 * n_words", "word_chars < 2.5D * n_words OR word_chars > 12 * n_words"),
    "symbols": ("n_symbols <= 0.02D * n_words", "n_symbols >= 0.1D * n_words"),
    "dup_lines": ("n_lines >= 3 AND n_dup_lines = 0", "n_dup_lines >= 0.3D * n_lines AND n_lines > 0"),
    "repeats": ("n_words >= 50 AND n_repeat_words <= 0.02D * n_words", "n_repeat_words >= 0.15D * n_words"),
    "capitals": ("n_upper <= 0.12D * n_letters", "n_upper >= 0.3D * n_letters"),
    # the vocabulary of a long text grows with the root of its length: from 2000 words on that is what is asked for
    "variety": (
        "n_distinct >= 0.4D * n_words OR CAST(n_distinct AS BIGINT) * n_distinct >= 320 * n_words",
        "n_distinct < 0.25D * n_words AND CAST(n_distinct AS BIGINT) * n_distinct < 125 * n_words",
    ),
    "letters": ("n_letters >= 0.85D * word_chars", "n_letters < 0.7D * word_chars"),
    "common": ("n_common >= 3", "n_words >= 20 AND n_common < 2"),
}
ITERATIONS = 12
#: A bad document usually breaks one or two rules only, so each rule is expected to catch a quarter of them.
#: Start, and prior pull (as a share of each rule's votes): accuracy on good and bad documents, share of good ones.
START_GOOD, START_BAD, START_SHARE, PULL = 0.95, 0.25, 0.85, 0.2


def _repeat_words(wins: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in the row's array of window hashes."""
    pairs = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    at = F.sort_array(F.transform(let(pairs, twice), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    add = lambda a, p: F.struct(F.greatest(a["end"], p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"))
    covered = F.aggregate(at, zero, add, lambda a: a["n"])
    return F.when(F.size(F.array_distinct(wins)) < F.size(wins), covered).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the rules' measures of every whole text (null: no words). No shuffle, no Python.

    Window hashes have 64 bits, compared within one text only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE_CLASS + "+", "")) > 0)
    two = base.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", "").alias("joined"), lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.size(F.array_intersect(F.col("w"), F.array(*map(F.lit, COMMON)))).alias("n_common"),
    )
    chars = lambda keep: F.length(F.regexp_replace("joined", keep, "")).cast("long")
    three = two.select(
        "doc_id", "n_words", "n_common", F.length("joined").cast("long").alias("word_chars"), chars("[^#*$%&|<>]+").alias("n_symbols"),
        chars(r"\P{Lu}+").alias("n_upper"), chars(r"\P{L}+").alias("n_letters"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size(F.array_distinct("h")).alias("n_distinct"),
        F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")), lambda i: F.xxhash64(F.slice("h", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")).alias("wins"),
    )
    return three.withColumn("n_repeat_words", _repeat_words(F.col("wins"))).drop("wins")


def with_votes(measured: DataFrame) -> DataFrame:
    vote = {f"v_{k}": F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0).cast("byte") for k, (good, bad) in RULES.items()}
    return measured.withColumns(vote)


def posterior(params: dict[str, float]) -> Column:
    """P(good | votes) as a column; abstentions say nothing."""
    logit = F.lit(math.log(params["share"] / (1 - params["share"])))
    for k in RULES:
        g, b, v = params[f"g_{k}"], params[f"b_{k}"], F.col(f"v_{k}")
        logit = logit + F.when(v == 1, math.log(g / (1 - b))).when(v == -1, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def fit(voted: DataFrame, iterations: int = ITERATIONS) -> dict[str, float]:
    """The accuracies, by expectation-maximisation; each step is one aggregate over the pattern counts."""
    names = [f"v_{k}" for k in RULES]
    patterns = materialize(voted.groupBy(*names).agg(F.count("*").cast("double").alias("n")).coalesce(1), "vote_patterns")
    params = {"share": START_SHARE} | {f"g_{k}": START_GOOD for k in RULES} | {f"b_{k}": START_BAD for k in RULES}
    for _ in range(iterations):
        q, n = F.col("q"), F.col("n")
        sums = [F.sum(n * q).alias("good"), F.sum(n).alias("all")]
        for k in RULES:
            v = F.col(f"v_{k}")
            for name, p, right in (("g", q, 1), ("b", 1 - q, -1)):
                sums += [F.sum(F.when(v == right, n * p).otherwise(0.0)).alias(f"{name}r_{k}"), F.sum(F.when(v != 0, n * p).otherwise(0.0)).alias(f"{name}n_{k}")]
        s = patterns.withColumn("q", posterior(params)).agg(*sums).first()
        if not s["all"]:
            break
        params = {"share": min(0.999, max(0.001, s["good"] / s["all"]))}
        for k in RULES:
            votes = s[f"gn_{k}"] + s[f"bn_{k}"] + 1.0
            for name, start in (("g", START_GOOD), ("b", START_BAD)):
                pull = PULL * votes
                params[f"{name}_{k}"] = min(0.999, max(0.001, (s[f"{name}r_{k}"] + pull * start) / (s[f"{name}n_{k}"] + pull)))
    return params


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the measures, base_failed, posterior and kept.

    Null and empty texts have no words, fail the base rules and get no vote beyond length; repeated rows are
    judged alike; an empty table gives an empty result.
    """
    voted = materialize(with_votes(measure(docs)), "votes")
    params = fit(voted)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = posterior(params)
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (good >= 0.5)).alias("kept"), F.round(good, 6).alias("posterior"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same in DuckDB: the EM steps are unrolled as one-row tables p0, p1, ..."""
    sql = lambda x: x.replace("0.02D", "0.02").replace("D *", " *")
    votes = ",\n".join(f"CASE WHEN {sql(g)} THEN 1 WHEN {sql(b)} THEN -1 ELSE 0 END AS v_{k}" for k, (g, b) in RULES.items())
    logit = "ln(share / (1 - share))" + "".join(f" + CASE v_{k} WHEN 1 THEN ln(g_{k} / (1 - b_{k})) WHEN -1 THEN ln((1 - g_{k}) / b_{k}) ELSE 0.0 END" for k in RULES)
    clamp = lambda x: f"least(0.999, greatest(0.001, {x}))"
    steps = [f"p0 AS MATERIALIZED (SELECT {START_SHARE}::DOUBLE AS share, " + ", ".join(f"{START_GOOD}::DOUBLE AS g_{k}, {START_BAD}::DOUBLE AS b_{k}" for k in RULES) + ")"]
    for i in range(ITERATIONS):
        cols = []
        for k in RULES:
            total = f"(sum(CASE WHEN v_{k} <> 0 THEN n ELSE 0.0 END) + 1.0)"
            for name, p, right, start in (("g", "q", 1, START_GOOD), ("b", "(1 - q)", -1, START_BAD)):
                cols.append(clamp(f"(sum(CASE WHEN v_{k} = {right} THEN n * {p} ELSE 0.0 END) + {PULL}::DOUBLE * {start}::DOUBLE * {total}) / (sum(CASE WHEN v_{k} <> 0 THEN n * {p} ELSE 0.0 END) + {PULL}::DOUBLE * {total})") + f" AS {name}_{k}")
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT {clamp('sum(n * q) / sum(n)')} AS share, {', '.join(cols)} FROM (SELECT *, 1 / (1 + exp(-({logit}))) AS q FROM patterns, p{i}))")
    names = ", ".join(f"v_{k}" for k in RULES)
    space = r"[\x20\x09-\x0D]"
    common = ", ".join(f"'{w}'" for w in COMMON)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS w,
      list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{space}+', '', 'g')) > 0) AS lines FROM t),
pos AS (SELECT r, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM w WHERE len(w) >= {WINDOW}),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(w, i, i + {WINDOW - 1})) AS c FROM pos),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + j AS at FROM win, range({WINDOW}) g(j) WHERE c > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, array_to_string(w, '') AS joined, len(lines)::BIGINT AS n_lines,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(list_distinct(w)) AS n_distinct,
      len(list_intersect(list_distinct(w), [{common}])) AS n_common, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON w.r = rep.r),
f AS (SELECT *, length(joined) AS word_chars, length(regexp_replace(joined, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      length(regexp_replace(joined, '\\P{{Lu}}+', '', 'g')) AS n_upper, length(regexp_replace(joined, '\\P{{L}}+', '', 'g')) AS n_letters FROM m),
v AS MATERIALIZED (SELECT *, {votes} FROM f),
patterns AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 1 / (1 + exp(-({logit}))) >= 0.5 AS kept,
       round(1 / (1 + exp(-({logit}))), 6) AS posterior
FROM v, p{ITERATIONS}
"""


ORACLE_SQL = _oracle()
