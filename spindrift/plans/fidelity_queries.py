"""Queries over the features lens: divergence, entropy, coverage and novelty of generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .lenses import CATEGORICAL, FEATURES_SQL, NUMERIC, features


def _rounded(df):
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def numeric_fidelity(spark, sf):
    """Jensen-Shannon and total-variation divergence of numeric features over 99 bins."""
    return _rounded(M.numeric_fidelity(features(spark, sf), "side", NUMERIC))


def categorical_fidelity(spark, sf):
    """The same over category frequencies."""
    return _rounded(M.categorical_fidelity(features(spark, sf), "side", CATEGORICAL))


def fidelity_report(spark, sf):
    """All features' divergences and the mean of each family: the flagship query."""
    return _rounded(M.fidelity_report(features(spark, sf), "side", NUMERIC, CATEGORICAL))


def entropy_diversity(spark, sf):
    """Shannon entropy of every feature's values, real and generated."""
    return _rounded(M.entropy(features(spark, sf), "side", NUMERIC + CATEGORICAL))


def coverage_diversity(spark, sf):
    """Share of real values that are generated too."""
    return _rounded(M.coverage(features(spark, sf), "side", NUMERIC + CATEGORICAL))


def novelty_diversity(spark, sf):
    """Share of generated values that aren't real ones."""
    return _rounded(M.novelty(features(spark, sf), "side", NUMERIC + CATEGORICAL))


def histogram_counts(spark, sf):
    """The bins themselves: counts of both sides per numeric feature."""
    return M.histogram(M.long_form(features(spark, sf), "side", NUMERIC, "double"))


def class_shares(spark, sf):
    """Rows of each side and their share."""
    return _rounded(M.per_class_share(features(spark, sf), "side"))


def _long(cols, cast):
    return " UNION ALL ".join(f"SELECT side, '{c}' AS feature, {c}::{cast} AS value FROM x" for c in cols)


_NUM = f"""x AS MATERIALIZED ({FEATURES_SQL}), l AS MATERIALIZED ({_long(NUMERIC, 'DOUBLE')}),
s AS (SELECT feature, min(value) AS lo, CASE WHEN max(value) = min(value) THEN max(value) + 1e-6 ELSE max(value) END AS hi FROM l WHERE value IS NOT NULL GROUP BY feature),
e AS (SELECT feature, lo, list_transform(range(0, 100), lambda k: lo + k * ((hi - lo) / 99)) AS edges FROM s),
h AS MATERIALIZED (SELECT l.feature, least(len(list_filter(edges, lambda e: e <= value)), 99)::BIGINT AS bin, count(*) FILTER (side = 'real') AS real, count(*) FILTER (side = 'gen') AS gen FROM l JOIN e ON l.feature = e.feature GROUP BY 1, 2)"""
_CAT = f"c AS MATERIALIZED (SELECT feature, value, count(*) FILTER (side = 'real') AS real, count(*) FILTER (side = 'gen') AS gen FROM ({_long(CATEGORICAL, 'VARCHAR')}) GROUP BY 1, 2)"
# numbers compare as values here: grouping doubles and grouping their text give the same groups
_ALL = f"c AS MATERIALIZED (SELECT feature, value, count(*) FILTER (side = 'real') AS real, count(*) FILTER (side = 'gen') AS gen FROM ({_long(NUMERIC + CATEGORICAL, 'VARCHAR')}) GROUP BY 1, 2)"
_X = f"x AS MATERIALIZED ({FEATURES_SQL})"


def _div(table):
    kl = lambda a: f"sum(CASE WHEN {a} > 0 THEN {a} * ln({a} / ((p + q) / 2)) ELSE 0.0 END)"
    return f"SELECT feature, 0.5 * {kl('p')} + 0.5 * {kl('q')} AS jsd, 0.5 * sum(abs(p - q)) AS tvd FROM (SELECT feature, real / sum(real) OVER w AS p, gen / sum(gen) OVER w AS q FROM {table} WINDOW w AS (PARTITION BY feature)) GROUP BY feature"


_ROUND = "SELECT feature, round(jsd, 8) AS jsd, round(tvd, 8) AS tvd FROM"
SQL = {
    "numeric_fidelity": f"WITH {_NUM} {_ROUND} ({_div('h')})",
    "categorical_fidelity": f"WITH {_X}, {_CAT} {_ROUND} ({_div('c')})",
    "fidelity_report": f"""WITH {_NUM}, {_CAT}, d AS (SELECT 'numeric' AS family, * FROM ({_div('h')}) UNION ALL SELECT 'categorical', * FROM ({_div('c')}))
SELECT family, feature, round(jsd, 8) AS jsd, round(tvd, 8) AS tvd FROM (SELECT family, feature, jsd, tvd FROM d UNION ALL SELECT family, '*', avg(jsd), avg(tvd) FROM d GROUP BY family)""",
    "entropy_diversity": f"""WITH {_X}, {_ALL} SELECT feature, round(0.0 - sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END), 8) AS entropy_real, round(0.0 - sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0.0 END), 8) AS entropy_gen
FROM (SELECT feature, real / sum(real) OVER w AS p, gen / sum(gen) OVER w AS q FROM c WINDOW w AS (PARTITION BY feature)) GROUP BY feature""",
    "coverage_diversity": f"WITH {_X}, {_ALL} SELECT feature, round(count(*) FILTER (real > 0 AND gen > 0) / count(*) FILTER (real > 0), 8) AS coverage FROM c GROUP BY feature",
    "novelty_diversity": f"WITH {_X}, {_ALL} SELECT feature, round(count(*) FILTER (real = 0 AND gen > 0) / count(*) FILTER (gen > 0), 8) AS novelty FROM c GROUP BY feature",
    "histogram_counts": f"WITH {_NUM} SELECT * FROM h",
    "class_shares": f"WITH {_X} SELECT side, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM x GROUP BY side",
}
QUERIES = {f.__name__: f for f in (numeric_fidelity, categorical_fidelity, fidelity_report, entropy_diversity, coverage_diversity, novelty_diversity, histogram_counts, class_shares)}
