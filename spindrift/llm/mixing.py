"""Operator 1: mixing sources to target weights by iterative proportional fitting. Native: DataFrame functions only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table, words

DIMS = ("source", "lang", "topic")
#: Without stated targets a marginal's target is its token share to this power: below 1 evens categories out.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.8}
SWEEPS, KEEP = 20, 0.75
#: Where a tolerance is asked for, raking goes on after its sweeps, MOST_SWEEPS at most. WARN: an error that is told anyway.
TOLERANCE, MOST_SWEEPS, WARN = 1e-6, 200, 0.01
#: Cells up to this number are raked in one task, without a shuffle, and broadcast to the documents.
SMALL_CELLS = 50_000
#: Bands of weights an octave that many cells are summed by.
BANDS = 64
LICENCE = "(?i)licen[sc]e|all rights reserved"
CONTACT = "@|https?://"


def topic(text: Column, n_tokens: Column) -> Column:
    """A document's topic class, from its form: licence text, contact pages, tables, long or short prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.rlike(LICENCE), "licence").when(text.rlike(CONTACT), "contact").when(F.contains(text, F.lit(" | ")), "table")
        .when(n_tokens >= 500, "long_prose").otherwise("short_prose")
    )


def uniform(id_col: str) -> Column:
    """A uniform number in [0, 1) that depends on the id alone (md5, so any engine can repeat it)."""
    digits = F.substring(F.md5(F.concat(F.lit("mix|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def _targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None, one_task: bool) -> DataFrame:
    """Each cell with its marginals' target tokens g_<dim>; stated shares are rescaled to the categories present.

    The few cells of ``one_task`` are summed by windows; many are summed by their marginal's key and joined back.
    """
    if one_task:
        cells = cells.withColumn("one", F.lit(1)).withColumn("total", F.sum("tokens").over(W.partitionBy("one")))
    else:
        cells = cells.withColumn("one", F.lit(1)).crossJoin(cells.agg(F.sum("tokens").alias("total")))  # one row
    for d in DIMS:
        share = lambda mass, d=d: F.pow(mass / F.col("total"), TEMPER[d])
        if stated := (targets or {}).get(d):
            share = lambda mass, d=d, s=stated: F.coalesce(*[F.when(F.col(d) == k, F.lit(float(v))) for k, v in s.items()], F.lit(0.0))  # noqa: E731, ARG005
        if one_task:
            first = F.row_number().over(W.partitionBy("one", d).orderBy(*DIMS)) == 1
            cells = cells.withColumn("share", share(F.sum("tokens").over(W.partitionBy("one", d)))).withColumn("once", F.when(first, F.col("share")).otherwise(0.0))
            cells = cells.withColumn(f"g_{d}", F.col("total") * F.col("share") / F.sum("once").over(W.partitionBy("one"))).drop("share", "once")
        else:
            each = cells.groupBy(d, "total").agg(F.sum("tokens").alias("mass")).withColumn("share", share(F.col("mass")))
            each = each.crossJoin(each.agg(F.sum("share").alias("shares")))  # one row
            cells = cells.join(each.select(d, (F.col("total") * F.col("share") / F.col("shares")).alias(f"g_{d}")), d)
    return cells


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, one_task: bool = True, tolerance: float | None = None) -> DataFrame:
    """Weights w of cells (source, lang, topic, tokens) whose three marginals meet their targets.

    Each sweep scales the cells to one marginal after the other. A small table is raked in a single task; in a larger
    one (very many sources; ``one_task`` false) marginals are sums with partial sums in each task, joined back by their
    key, so a language or topic of any number of cells is no one's task. There are ``sweeps`` sweeps; with a ``tolerance``
    more follow until all marginals are within that share of their targets, or come no nearer. What is missed by more
    than WARN (or the tolerance) is told by a warning: targets that no weights meet, as cells are missing, are so.
    """
    pack = (lambda d: d.coalesce(1)) if one_task else (lambda d: d)
    now = _targets(pack(cells), targets, one_task).withColumn("w", F.col("tokens"))
    i, before = 0, float("inf")
    while True:
        for d in DIMS:
            if one_task:
                now = now.withColumn("s", F.sum("w").over(W.partitionBy(d)))
            else:
                now = now.join(now.groupBy(d).agg(F.sum("w").alias("s")), d)
            now = now.withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.col(f"g_{d}") / F.col("s")).otherwise(0.0)).drop("s")
        i += 1
        if i % 5 == 0 or i == sweeps or not one_task:
            now = pack(materialize(now, "raked"))
        if i < sweeps or (i % 5 and i != sweeps):
            continue
        off = marginal_error(now)
        if tolerance is None or off <= tolerance or off > 0.99 * before or i >= MOST_SWEEPS:
            break
        before = off
    if off > (WARN if tolerance is None else tolerance):
        warnings.warn(f"marginals are off by up to {off:.2g} of their targets after {i} sweeps", stacklevel=2)
    return now


def marginal_error(raked: DataFrame) -> float:
    """The largest distance of a marginal from its target, as a share of the target; 0 for an empty table."""
    sets = [[d] for d in DIMS]
    each = raked.groupingSets(sets, *DIMS).agg(F.sum("w").alias("s"), *[F.max(f"g_{d}").alias(f"g_{d}") for d in DIMS])
    goal = F.coalesce(*[F.when(F.col(d).isNotNull(), F.col(f"g_{d}")) for d in DIMS])
    return each.agg(F.max(F.when(goal > 0, F.abs(F.col("s") - goal) / goal))).first()[0] or 0.0


def calibrate(raked: DataFrame, keep: float = KEEP, one_task: bool = True) -> DataFrame:
    """Cells with weight (w per token) and probability: min(1, c * weight), c such that a share ``keep`` of all
    tokens is expected. Cells are taken by falling weight until the rest needs no more than certainty.

    Where cells are many (``one_task`` false) the running sums are taken in two steps: over the cells' weights in
    BANDS bands an octave, of which there are few, then within each band.
    """
    x = raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    x = x.withColumn("pull", F.col("tokens") * F.col("weight"))
    x = x.withColumn("band", F.lit(0) if one_task else F.coalesce(F.floor(F.log2(F.when(F.col("weight") > 0, F.col("weight"))) * BANDS), F.lit(-(1 << 40))))
    order = W.partitionBy("one", "band").orderBy(F.col("weight").desc(), *DIMS)
    upto, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    x = x.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0.0))).withColumn("after", F.sum("pull").over(rest))
    if not one_task:
        bands = x.groupBy("band").agg(F.sum("tokens").alias("b_tokens"), F.sum("pull").alias("b_pull")).coalesce(1)
        down = W.orderBy(F.col("band").desc())
        ahead, behind = F.sum("b_tokens").over(down.rowsBetween(W.unboundedPreceding, -1)), F.sum("b_pull").over(down.rowsBetween(1, W.unboundedFollowing))
        bands = bands.select("band", F.coalesce(ahead, F.lit(0.0)).alias("ahead"), F.coalesce(behind, F.lit(0.0)).alias("behind"))
        x = x.join(bands, "band").withColumn("before", F.col("before") + F.col("ahead")).withColumn("after", F.col("after") + F.col("behind"))
    x = x.withColumn("c", F.when(F.col("after") > 0, (keep * F.col("total") - F.col("before")) / F.col("after")))
    good = F.when((F.col("c") * F.col("weight") <= 1) & (F.col("c") > 0), F.struct((-F.col("weight")).alias("o"), *DIMS, "c"))
    if one_task:
        x = x.withColumn("best", F.min(good).over(W.partitionBy("one"))["c"])
    else:
        x = x.crossJoin(x.agg(F.min(good)["c"].alias("best")))  # one row
    c = F.col("best")
    p = F.when(F.col("tokens") <= 0, F.lit(keep)).when(c.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), c * F.col("weight")))
    return x.select(*DIMS, "tokens", "weight", p.alias("probability"))


def mixed_rows(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, sweeps: int = SWEEPS) -> DataFrame:
    """(row, source, lang, topic, tokens, weight, probability, sampled); ``row`` has all columns of ``docs`` (doc_id, text, lang,
    source and others) as they were, so none of their names can clash.

    Null source or lang is the category 'unknown'; null and empty texts have no tokens and the plain probability
    ``keep`` if their cell has none; equal ids are sampled alike, so repeated rows are kept or left out together; ties of
    cells go by source, language and topic; texts of any length count whole; an empty table gives an empty result. Documents
    join their cell's weight: the cells are broadcast when there are few, else joined by key with skew handling.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    known = lambda c: F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("unknown")).alias(c)
    keyed = docs.select(row).select("row", known("source"), known("lang"), F.size(words(F.col("row.text"))).cast("long").alias("tokens"))
    keyed = keyed.withColumn("topic", topic(F.col("row.text"), F.col("tokens")))
    counted = materialize(keyed.groupBy(*DIMS).agg(F.sum("tokens").cast("double").alias("tokens")), "cells")
    few = counted.count() <= SMALL_CELLS
    rates = materialize(calibrate(rake(counted, targets, sweeps, few), keep, few), "rates")
    rates = rates.select(*(F.col(d).alias(f"r_{d}") for d in DIMS), "weight", "probability")
    on = [F.col(d) == F.col(f"r_{d}") for d in DIMS]
    out = keyed.join(F.broadcast(rates) if few else rates, on, "left").drop(*(f"r_{d}" for d in DIMS))
    return out.withColumn("sampled", uniform("row.doc_id") < F.col("probability"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, sweeps: int = SWEEPS) -> DataFrame:
    """``docs`` with __source, __lang, __topic, __tokens, __weight, __probability, __sampled (which replace columns of these
    names; ``mixed_rows`` takes any)."""
    made = (*DIMS, "tokens", "weight", "probability", "sampled")
    own = [c for c in docs.columns if c not in {f"__{m}" for m in made}]
    return mixed_rows(docs, targets, keep, sweeps).select(*[F.col("row")[c].alias(c) for c in own], *[F.col(m).alias(f"__{m}") for m in made])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
        F.round("__weight", 8).alias("weight"), F.round("__probability", 8).alias("probability"), F.col("__sampled").alias("sampled"),
    )


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents, with the columns they came with, whatever their names."""
    return mixed_rows(docs).where("sampled").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _oracle() -> str:
    g = ["t0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(sum(n_tokens)) OVER ()::DOUBLE AS total FROM k GROUP BY ALL)"]
    for i, d in enumerate(DIMS):
        g.append(f"""m{i} AS MATERIALIZED (SELECT {d}, pow(sum(tokens) / any_value(total), {TEMPER[d]}::DOUBLE) AS s, any_value(total) AS total FROM t0 GROUP BY {d}),
h{i} AS MATERIALIZED (SELECT {d}, total * s / sum(s) OVER () AS g FROM m{i})""")
    g.append("w0 AS MATERIALIZED (SELECT t0.*, h0.g AS g_source, h1.g AS g_lang, h2.g AS g_topic, tokens AS w FROM t0 JOIN h0 USING (source) JOIN h1 USING (lang) JOIN h2 USING (topic))")
    n = 0
    for _ in range(SWEEPS):
        for d in DIMS:
            g.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER p > 0 THEN w * g_{d} / sum(w) OVER p ELSE 0.0 END AS w) FROM w{n} WINDOW p AS (PARTITION BY {d}))")
            n += 1
    cats = f"CASE WHEN regexp_matches(text, '{LICENCE}') THEN 'licence' WHEN regexp_matches(text, '{CONTACT}') THEN 'contact' WHEN contains(text, ' | ') THEN 'table' WHEN n_tokens >= 500 THEN 'long_prose' ELSE 'short_prose' END"
    return rf"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
k AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, {cats} AS topic FROM b),
{", ".join(g)},
x AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0.0 END AS weight FROM w{n}),
y AS (SELECT *, ({KEEP} * total - coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(tokens * weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c
  FROM x WINDOW o AS (ORDER BY weight DESC, source, lang, topic)),
c AS MATERIALIZED (SELECT arg_min(c, (-weight, source, lang, topic)) AS c FROM y WHERE c * weight <= 1 AND c > 0),
z AS MATERIALIZED (SELECT source, lang, topic, weight, CASE WHEN tokens <= 0 THEN {KEEP} WHEN c.c IS NULL THEN 1.0 ELSE least(1.0, c.c * weight) END::DOUBLE AS p FROM x, c)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 8) AS weight, round(p, 8) AS probability,
  ('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT / {float(1 << 52)} < p AS sampled
FROM k JOIN z USING (source, lang, topic)
"""


ORACLE_SQL = _oracle()
