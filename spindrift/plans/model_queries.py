"""Queries over vocabularies and small networks; weights come from arithmetic that SQL repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import gradients as N
from ..operators import vocabulary as V
from .encode_queries import _DOCS, _SLICE, _docs, _win
from .lenses import load

LENGTH, WIDTH, HIDDEN, CLASSES, ROWS = 64, 5, 4, 3, 997


def _tokens(spark, sf):
    """Every token of the packets' slices (packet_id, pos, token); packets without one have a row without a token."""
    x = E.packet_tokens(_docs(spark, sf))
    return x.select("packet_id", F.posexplode_outer("tokens").alias("pos", "token"))


def _ids(spark, sf):
    tokens = _tokens(spark, sf)
    known = V.learn_vocabulary(tokens, least=2)
    x = V.with_ids(tokens.where("token IS NOT NULL"), known).unionByName(tokens.where("token IS NULL").withColumn("id", F.lit(None).cast("long")))
    return V.padded_ids(x, "packet_id", LENGTH)


def vocabulary(spark, sf):
    """The vocabulary of all slices' tokens that occur twice or more."""
    return V.learn_vocabulary(_tokens(spark, sf), least=2)


def vocabulary_ids(spark, sf):
    """All slices as padded ids of that vocabulary, with segments."""
    x = _ids(spark, sf)
    return x.select("packet_id", F.array_join("ids", " ").alias("ids"), F.array_join("segments", "").alias("segments"))


def token_network():
    """An embedding, a dense layer for each token, their mean and the class scores."""
    import numpy as np

    i = lambda n, m, a, b: np.cos(a * np.arange(n)[:, None] + b * np.arange(m)[None, :])
    table, first, last = i(ROWS, WIDTH, 0.7, 1.3), i(WIDTH, HIDDEN, 0.9, 2.1), i(HIDDEN, CLASSES, 1.1, 0.4)
    return N.Network([N.Embedding(table, V.UNK), N.Dense(first, np.zeros(HIDDEN), True), N.MeanPool(), N.Dense(last, np.zeros(CLASSES))], LENGTH)


def token_gradient(spark, sf):
    """The gradient's norm at every token of every slice, for the class predicted."""
    x = N.gradient_saliency(_ids(spark, sf), token_network(), "ids", "packet_id", segments="segments")
    x = x.select("packet_id", "pred", F.posexplode("saliency").alias("pos", "score"))
    return x.select("packet_id", "pred", F.col("pos").cast("long").alias("pos"), F.round("score", 8).alias("score"))


def pixel_network(width=64):
    """Two dense layers over inputs that were divided by 0.5 before."""
    import numpy as np

    first = np.sin(0.3 * np.arange(width)[:, None] + 0.8 * np.arange(HIDDEN)[None, :])
    last = np.cos(1.1 * np.arange(HIDDEN)[:, None] + 0.4 * np.arange(CLASSES)[None, :])
    return N.Network([N.Dense(first, 0.1 * np.arange(HIDDEN), True), N.Dense(last, np.zeros(CLASSES))], width, 2.0)


def _pixels(spark, sf, target):
    x = load(spark, sf, "embeddings").withColumn("gold", F.pmod(F.col("label").cast("long"), F.lit(CLASSES)))
    out = N.gradient_saliency(x, pixel_network(), "embedding", "vec_id", target)
    out = out.select("vec_id", "pred", F.posexplode("saliency").alias("g", "score"))
    return out.select("vec_id", "pred", F.col("g").cast("long").alias("g"), F.round("score", 8).alias("score"))


def pixel_gradient(spark, sf):
    """The gradient at every component of every vector, for the class predicted."""
    return _pixels(spark, sf, "pred")


def pixel_gradient_gold(spark, sf):
    """The same for the vector's own label."""
    return _pixels(spark, sf, "gold")


_VOCAB = f"""d AS MATERIALIZED (SELECT packet_id, {_win('h')} AS t FROM (SELECT packet_id, {_SLICE} AS h FROM ({_DOCS}))),
u AS MATERIALIZED (SELECT packet_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM d),
v AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 4 AS id, n FROM (SELECT token, count(*) AS n FROM u GROUP BY token) WHERE n >= 2)"""
_FILL = f"""i AS MATERIALIZED (SELECT packet_id, pos + 1 AS pos, coalesce(id, 1) AS id FROM u LEFT JOIN v USING (token) WHERE pos < {LENGTH - 1} UNION ALL SELECT packet_id, 0, 2 FROM d)"""
_NET = f"""e AS MATERIALIZED (SELECT packet_id, pos, k, tanh(sum(cos(0.7::DOUBLE * (CASE WHEN id < {ROWS} THEN id ELSE 1 END) + 1.3::DOUBLE * w) * cos(0.9::DOUBLE * w + 2.1::DOUBLE * k))) AS h FROM i, range({WIDTH}) a(w), range({HIDDEN}) b(k) GROUP BY ALL),
s AS (SELECT packet_id, c, sum(m * cos(1.1::DOUBLE * k + 0.4::DOUBLE * c)) AS score FROM (SELECT packet_id, k, avg(h) AS m FROM e GROUP BY ALL), range({CLASSES}) u(c) GROUP BY ALL),
p AS MATERIALIZED (SELECT packet_id, arg_max(c, score) AS pred FROM s GROUP BY packet_id),
n AS (SELECT packet_id, count(*) AS n FROM i GROUP BY packet_id),
g AS (SELECT packet_id, pos, w, any_value(pred) AS pred, sum((1 - h * h) * cos(1.1::DOUBLE * k + 0.4::DOUBLE * pred) * cos(0.9::DOUBLE * w + 2.1::DOUBLE * k)) / any_value(n) AS d FROM e JOIN p USING (packet_id) JOIN n USING (packet_id), range({WIDTH}) a(w) GROUP BY packet_id, pos, w),
o AS (SELECT packet_id, any_value(pred) AS pred, pos, round(sqrt(sum(d * d)), 8) AS score FROM g GROUP BY packet_id, pos)
SELECT packet_id, pred, pos, score FROM o UNION ALL SELECT packet_id, pred, pos, 0.0 FROM p, range({LENGTH}) u(pos) WHERE (packet_id, pos) NOT IN (SELECT packet_id, pos FROM i)"""


def _pixel_sql(target):
    return f"""WITH x AS MATERIALIZED (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS g FROM embeddings),
h AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, k, tanh(sum(x * sin(0.3::DOUBLE * g + 0.8::DOUBLE * k)) + 0.1::DOUBLE * k) AS h FROM x, range({HIDDEN}) u(k) WHERE g < 64 GROUP BY vec_id, k),
s AS (SELECT vec_id, any_value(label) AS label, c, sum(h * cos(1.1::DOUBLE * k + 0.4::DOUBLE * c)) AS score FROM h, range({CLASSES}) u(c) GROUP BY vec_id, c),
p AS MATERIALIZED (SELECT vec_id, arg_max(c, score) AS pred, any_value(label)::BIGINT AS gold FROM s GROUP BY vec_id),
t AS MATERIALIZED (SELECT vec_id, pred, {target} AS c FROM p)
SELECT vec_id, any_value(pred) AS pred, g, round(2 * abs(sum((1 - h * h) * cos(1.1::DOUBLE * k + 0.4::DOUBLE * c) * sin(0.3::DOUBLE * g + 0.8::DOUBLE * k))), 8) AS score FROM h JOIN t USING (vec_id), range(64) u(g) GROUP BY vec_id, g"""


SQL = {
    "vocabulary": f"WITH {_VOCAB} SELECT token, id, n FROM v UNION ALL SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]']), unnest([0, 1, 2, 3, 4]), 0",
    "vocabulary_ids": f"""WITH {_VOCAB}, {_FILL} SELECT packet_id, array_to_string(list_concat(list(id ORDER BY pos), list_transform(range(0, {LENGTH} - count(*)), lambda x: 0)), ' ') AS ids,
repeat('1', count(*)::BIGINT) || repeat('0', {LENGTH} - count(*)::BIGINT) AS segments FROM i GROUP BY packet_id""",
    "token_gradient": f"WITH {_VOCAB}, {_FILL}, {_NET}",
    "pixel_gradient": _pixel_sql("pred"),
    "pixel_gradient_gold": _pixel_sql(f"coalesce(((gold % {CLASSES}) + {CLASSES}) % {CLASSES}, pred)"),
}
QUERIES = {f.__name__: f for f in (vocabulary, vocabulary_ids, token_gradient, pixel_gradient, pixel_gradient_gold)}
