"""Operator 9: toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, modest_batches, small_parts, table
from .labelled import held_out, sample_labels, share

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!|*._-]+[^\W\d_]+)+")
_SIGNS = re.compile(r"(?<=[^\W\d_])[0-9@$!|*._-]+(?=[^\W\d_])")
_SPACED = re.compile(r"\b[^\W\d_](?:[ .*_-][^\W\d_]\b){3,}")
_LEET = str.maketrans("013457@$!|", "oieastasil", "*._- ")
#: Second-person words of the four languages.
YOU = frozenset(("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "vosotros"))
#: Word beginnings that the lexicon may hold beside whole words, so that inflected forms count.
STEMS = (4, 5)
NEAR = 5
#: Share of the raw score in a calibrated one: it only orders documents that the calibration scores alike.
TIE = 1e-6
FEATURES = ("log_words", "hit_rate", "log_hits", "max_weight", "weight_rate", "near_you_rate", "you_rate", "capital_rate", "shout_rate", "punct_rate", "obfuscated_rate", "obfuscated_hits")


def keys(token: str) -> list[str]:
    """What stands for a lower-case token in the lexicon: itself and its beginnings."""
    return [token, *(f"{n}:{token[:n]}" for n in STEMS if len(token) > n - 1)]


def disguised(text: str) -> list[str]:
    """Words written with signs or digits within, or letter by letter; one that is both at one place counts once.

    Matches of _MIXED are looked for where signs stand between letters only, which few places are.
    """
    written, end = {}, 0
    for m in _SIGNS.finditer(text):
        at = m.start()
        if at < end:
            continue
        while at > end and text[at - 1].isalnum() and not text[at - 1].isdecimal():
            at -= 1
        if found := _MIXED.match(text, at):
            written[at], end = found[0], found.end()
    for m in _SPACED.finditer(text):
        written[m.start()] = m[0]
    return list(written.values())


class Weights(dict):
    """Token -> weight (0 for most), looked up in a lexicon once; MEMO tokens are remembered at a time."""

    MEMO = 100_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, t: str) -> float:
        found = self.lexicon.get
        if len(self) >= self.MEMO:
            self.clear()
        w = self[t] = found(t) or (found("4:" + t[:4]) or found("5:" + t[:5]) if len(t) > 3 else None) or 0.0
        return w


def features(text: str | None, lexicon: dict[str, float], weigh: Weights | None = None) -> list[float]:
    """The dense features of a whole text; null and empty texts have zeros."""
    text, weigh = text or "", Weights(lexicon) if weigh is None else weigh
    tokens = _WORD.findall(text.lower())
    n = len(tokens)
    hits = [(i, w) for i, t in enumerate(tokens) if (w := weigh[t])]
    you = [i for i, t in enumerate(tokens) if t in YOU]
    near, j = 0, 0
    for i, _ in hits:
        while j < len(you) and you[j] < i - NEAR:
            j += 1
        near += j < len(you) and you[j] <= i + NEAR
    odd = [x.lower().translate(_LEET) for x in disguised(text)]
    odd_hits = sum(any(k in lexicon for k in keys(t)) for t in odd)
    upper, letters, size = sum(map(str.isupper, text.split())), sum(map(len, tokens)), max(n, 1)
    weights = [w for _, w in hits]
    return [
        math.log1p(n), len(hits) / size, math.log1p(len(hits)), max(weights, default=0.0), sum(weights) / size, near / size, len(you) / size, upper / size,
        (text.count("!") + text.count("?")) / size, max(0, len(text) - letters - text.count(" ")) / max(len(text), 1), len(odd) / size, float(odd_hits),
    ]


def learn_lexicon(texts: DataFrame, max_entries: int = 400, least: int = 3) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts: (text, y) rows are counted per partition, then summed.

    An entry needs ``least`` toxic texts and a log odds ratio of 2; the ``max_entries`` best are kept.
    """

    import pyarrow as pa

    schema = pa.schema({"key": pa.string(), "n": pa.int64(), "t": pa.int64()})

    def count(batches):
        toxic, every = Counter(), Counter()
        table = lambda: pa.RecordBatch.from_pydict({"key": list(every), "n": list(every.values()), "t": [toxic[k] for k in every]}, schema)
        for b in small_parts(batches, "text"):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {k for t in set(_WORD.findall((text or "").lower())) for k in keys(t)}
                every.update(found)
                if y:
                    toxic.update(found)
                every[""] += 1
                toxic[""] += bool(y)
                if len(every) > 100_000:  # hand over what is counted so far
                    yield table()
                    toxic, every = Counter(), Counter()
        yield table()

    counts = texts.select("text", "y").mapInArrow(count, "key string, n long, t long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    counts = materialize(counts.where(f"t >= {least} OR key = ''"), "lexicon_counts")
    total = counts.where("key = ''").first()
    if not total or not 0 < total["t"] < total["n"]:
        return {}
    odds = F.log((F.col("t") + 0.5) / (total["t"] + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (total["n"] - total["t"] + 1.0))
    best = counts.where("key <> ''").withColumn("w", odds).where("w >= 2").orderBy((F.col("w") * F.sqrt("t")).desc(), "key").limit(max_entries)
    return {r["key"]: float(r["w"]) for r in best.collect()}


def feature_rows(rows: DataFrame, lexicon: dict[str, float], keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns of ``rows`` with a double column per feature, computed where the rows are."""
    import pyarrow as pa

    def run(batches):
        weigh = Weights(lexicon)
        for b in small_parts(batches, "text"):
            got = [features(x, lexicon, weigh) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            cols = list(zip(*got, strict=True)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), *(pa.array(c, pa.float64()) for c in cols)], names=[*keep, *FEATURES])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{f} double" for f in FEATURES)]))


class ToxicityModel:
    """A lexicon, boosted trees and a calibration, each learnt from its own share of the sample."""

    def __init__(self, lexicon, trees, calibration, prior: float):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def score(self, rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """``keep`` columns and score; without trees (no labels of both kinds) every score is the prior."""
        if self.trees is None:
            return rows.select(*keep, F.lit(self.prior).alias("score"))
        return self._apply(feature_rows(rows, self.lexicon, keep)).select(*keep, "score")

    def _raw(self, x: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        x = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(x)
        return self.trees.transform(x).withColumn("margin", vector_to_array("probability")[1])

    def _apply(self, x: DataFrame) -> DataFrame:
        x = self._raw(x)
        if self.calibration is None:
            return x.withColumn("score", F.col("margin"))
        # the calibration is a step function; a millionth of the raw score keeps ranks apart within its steps
        return self.calibration.transform(x).withColumn("score", (1 - TIE) * F.col("prediction_iso") + TIE * F.col("margin"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> ToxicityModel:
    """Fit on about ``max_labelled`` labelled rows at most (crc32(doc_id) mod 5 = 0 is never read).

    Trees are fitted on rows that the lexicon was not learnt from, and calibrated on a third share.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    modest_batches(docs.sparkSession)
    chosen = sample_labels(labels, "toxic", 5, 0, max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").withColumn("part", share("doc_id", "part"))
    rows = materialize(rows, "toxic_sample")
    lexicon = learn_lexicon(rows.where("part < 400000"))
    x = materialize(feature_rows(rows.where("part >= 400000").withColumn("y", (F.col("y") > 0).cast("int")), lexicon, ("doc_id", "y", "part")), "toxic_features")
    sums = x.agg(F.count("*").alias("n"), F.sum("y").alias("t"), F.sum(F.expr("if(part < 800000, y, 0)")).alias("tt"), F.sum(F.expr("if(part < 800000, 1 - y, 0)")).alias("tc"), F.sum(F.expr("if(part >= 800000, y, 0)")).alias("ct"), F.sum(F.expr("if(part >= 800000, 1 - y, 0)")).alias("cc")).first()
    prior = float(sums["t"] / sums["n"]) if sums["n"] else 0.0
    if not sums["tt"] or not sums["tc"]:
        return ToxicityModel(lexicon, None, None, prior)
    put = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform
    trees = GBTClassifier(labelCol="y", featuresCol="features", maxDepth=3, maxIter=20, stepSize=0.3, seed=7).fit(put(x.where("part < 800000")))
    model = ToxicityModel(lexicon, trees, None, prior)
    if sums["ct"] >= 20 and sums["cc"] >= 20:
        iso = IsotonicRegression(featuresCol="margin", labelCol="y", predictionCol="prediction_iso")
        model.calibration = iso.fit(model._raw(x.where("part >= 800000")).select("margin", F.col("y").cast("double").alias("y")))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored by their (zero) features, very long ones whole (rates don't depend on length);
    repeated rows get equal scores; null ids are scored but never learnt from; an empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels, max_labelled)
    out = model.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ("doc_id",))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Pipeline stage: documents scored below ``threshold`` stay, with the columns they came with.

    Other columns travel beside the text in one struct, so that no name clashes with the model's and no text is sent
    to the workers twice.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*rest).alias("__rest"))
    kept = model.score(rows, ("text", "__rest")).where(F.col("score") < threshold)
    return kept.select(*("text" if c == "text" else F.col("__rest")[c].alias(c) for c in docs.columns))
