"""ANOVA-F percentile feature selection.

F is computed from per-(class, feature) moments gathered in one scan (K rows after aggregation, K x F unpivoted);
the few K x F numbers are turned into F scores on the driver, as Spark ML's own ANOVA test does. The fill
used before scoring (missing numeric -> column mean, missing discrete -> most frequent value) is applied
analytically to those moments: filling z rows with value c changes count, mean and squared deviations in
closed form, so no filled copy of the table is made. Scaling is skipped: F is invariant under x -> (x - m) / s.

Selection follows the percentile rule: keep F above the linearly interpolated (100 - p)th percentile of the
scores, then fill up from scores tied with the threshold, in column order, up to floor(#features * p / 100);
a NaN score counts as the lowest score; p = 100 keeps all, p = 0 keeps none.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.functions import nan_to_null, q, split_discrete_numeric
from ctxspark.operators.stats import column_modes, column_moments


def anova_moments(df: DataFrame, features: Sequence[str], label: str = "label") -> tuple[list, dict]:
    """Moments per (class, feature) from one scan, and the modes of the discrete features from one more.

    K x F moment rows and one mode per discrete feature are collected.
    """
    discrete, _ = split_discrete_numeric(features)
    mom = (column_moments(df, features, [label]).withColumnRenamed(label, "label")
           .withColumn("m2", F.col("std") * F.col("std") * F.col("n")).collect())
    rows = sum(r["rows"] for r in mom if r["feature"] == features[0]) if features else 0
    modes = {r["feature"]: r["mode"] for r in column_modes(df, discrete, rows).collect()} if discrete else {}
    return [r.asDict() for r in mom], modes


def f_scores_from_moments(mom: Sequence, modes: dict, features: Sequence[str]) -> dict[str, float]:
    """F per feature after filling missing values (numeric: mean, discrete: mode), in closed form:
    filling z rows with c changes a class's count, mean and squared deviations without touching the rows."""
    by_feature: dict[str, list] = {}
    for r in mom:
        by_feature.setdefault(r["feature"], []).append(r)
    out = {}
    for c in features:
        rs = by_feature.get(c, [])
        if not rs:
            out[c] = float("nan")
            continue
        rows = np.array([r["rows"] for r in rs], dtype=float)
        n = np.array([r["n"] for r in rs], dtype=float)
        mean = np.array([0.0 if r["mean"] is None else r["mean"] for r in rs])
        m2 = np.array([0.0 if r["m2"] is None else r["m2"] for r in rs])
        if n.sum() == 0:
            out[c] = float("nan")
            continue
        fill = modes.get(c, (n * mean).sum() / n.sum())
        z = rows - n
        mk = (n * mean + z * fill) / rows
        ssk = m2 + n * (mean - mk) ** 2 + z * (fill - mk) ** 2
        total, k = rows.sum(), len(rs)
        grand = (rows * mk).sum() / total
        ssb, ssw = (rows * (mk - grand) ** 2).sum(), ssk.sum()
        if k < 2 or total <= k:
            out[c] = float("nan")
            continue
        msb, msw = ssb / (k - 1), ssw / (total - k)
        out[c] = (float("nan") if msb == 0 else float("inf")) if msw == 0 else float(msb / msw)
    return out


def anova_f(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, f_score) after filling missing values (numeric: mean, discrete: most frequent value)."""
    features = list(features)
    mom, modes = anova_moments(df, features, label)
    scores = f_scores_from_moments(mom, modes, features)
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("f_score", T.DoubleType())])
    return df.sparkSession.createDataFrame([(c, scores[c]) for c in features], schema)


def percentile_mask(scores: Sequence[float], percentile: float) -> list[bool]:
    """Keep mask for scores in column order under the percentile rule (NaN = lowest).

    ``floor(n * percentile / 100)`` places go to the ranks above the threshold rank first, then to scores equal to the
    threshold in column order. The threshold stands at rank (n - 1) * (100 - percentile) / 100 of the ascending scores,
    between two ranks linearly.
    """
    if not 0 < percentile < 100:
        return [percentile >= 100] * len(scores)
    values = [-sys.float_info.max if math.isnan(x) else x for x in scores]
    if not values:
        return []
    ascending, rank = sorted(values), (len(values) - 1) * (100 - percentile) / 100
    below = math.floor(rank)
    above = min(below + 1, len(values) - 1)
    threshold = ascending[below]
    if rank > below and ascending[above] > ascending[below]:
        threshold += (ascending[above] - ascending[below]) * (rank - below)
    kept = [x > threshold for x in values]
    places = math.floor(len(values) * percentile / 100) - sum(kept)
    for i, x in enumerate(values):
        if x == threshold and places > 0:
            kept[i], places = True, places - 1
    return kept


def select_features(df: DataFrame, features: Sequence[str], percentile: float = 40, label: str = "label") -> DataFrame:
    """(feature, position, f_score, selected) for every feature, in column order.

    The score table has one row per feature; the mask is computed on the driver from it.
    """
    features = list(features)
    mom, modes = anova_moments(df, features, label)
    scores = f_scores_from_moments(mom, modes, features)
    vals = [scores[c] for c in features]
    mask = percentile_mask(vals, percentile)
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("position", T.IntegerType()),
                           T.StructField("f_score", T.DoubleType()), T.StructField("selected", T.BooleanType())])
    return df.sparkSession.createDataFrame(
        [(c, i, vals[i], bool(mask[i])) for i, c in enumerate(features)], schema)


def selection_fill(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with missing feature values filled as the scores see them: numeric by the mean, discrete by the mode."""
    discrete, numeric = split_discrete_numeric(features)
    fills = {r["feature"]: r["mean"] for r in column_moments(df, numeric).collect()} if numeric else {}
    fills |= {r["feature"]: r["mode"] for r in column_modes(df, discrete).collect()} if discrete else {}
    return df.withColumns({c: F.coalesce(nan_to_null(q(c).cast("double")), F.lit(fills.get(c)).cast("double")) for c in features})


def selected_names(selection: DataFrame) -> list[str]:
    return [r["feature"] for r in selection.filter("selected").orderBy("position").collect()]
