"""Column statistics over wide tables: mean / population std / scale, most frequent value, class counts.

Moments are aggregated in one scan, as columns or, on wide tables, as vectors, with map-side partial sums: one row per
key group and task to the shuffle. Most-frequent values need counts per (feature, value), of the values that summaries leave open: the columns are unpivoted inside the
scan (a Generate, never materialised) and the partial aggregate pre-combines hot values, so a value holding a third of
the rows costs one row per task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.functions import nan_to_null, q


def long_values(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), drop_nulls: bool = True,
                only: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(keep..., feature, value) with NaN read as missing; of a feature in ``only`` just the values listed there."""
    def value(c: str) -> Column:
        x = nan_to_null(q(c).cast("double"))
        return F.when(x.isin(*only[c]), x) if only and c in only else x

    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in features])
    out = df.select(*[q(k) for k in keep], F.explode(pairs).alias("p")).select(*[q(k) for k in keep], "p.feature",
                                                                                "p.value")
    return out.filter(F.col("value").isNotNull()) if drop_nulls else out


COLUMN_BATCH = 64


def column_moments(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), extremes: bool = False) -> DataFrame:
    """(keys..., feature, rows, n, mean, std[, low, high]) per key group; NaN is missing; a feature without values has null moments.

    One scan whatever the width: up to ``COLUMN_BATCH`` features are plain column aggregates (one generated function), more are
    aggregated as vectors.
    """
    if len(features) > COLUMN_BATCH:
        return vector_moments(df, features, keys, extremes)
    kinds = {"n": F.count, "mean": F.avg, "std": F.stddev_pop} | ({"low": F.min, "high": F.max} if extremes else {})
    x = [nan_to_null(q(c).cast("double")) for c in features]
    wide = df.groupBy(*[q(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("__rows"), *[f(v).alias(f"__{n}{j}") for j, v in enumerate(x) for n, f in kinds.items()])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("__rows").alias("rows"), *[F.col(f"__{n}{j}").alias(n) for n in kinds])
                      for j, c in enumerate(features)])
    return wide.select(*[q(k) for k in keys], F.explode(pairs).alias("p")).select(*[q(k) for k in keys], "p.*")


#: Rows whose mean is the pivot of the vector moments: any value near the mean will do, it only keeps the sums of squares small.
PIVOT_ROWS = 1000


def vector_moments(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), extremes: bool = False) -> DataFrame:
    """:func:`column_moments` of wide tables in one scan: every row becomes the vector of its values less a pivot (0 where missing) and the vector of
    its mask, and Spark ML's summarizer adds both up per key group, value sums, square sums and counts by element."""
    names = list(features)
    given = df.select(*[q(k) for k in keys], F.array(*[q(c).cast("double") for c in names]).alias("__x"))
    seen = np.array([[np.nan if v is None else v for v in r[0]] for r in given.select("__x").limit(PIVOT_ROWS).collect()]).reshape(-1, len(names))
    known = np.isfinite(seen)
    pivots = (np.where(known, seen, 0.0).sum(0) / np.maximum(known.sum(0), 1)).tolist()
    missing = lambda v: v.isNull() | F.isnan(v)
    filled = lambda end: array_to_vector(F.transform("__x", lambda v: F.when(missing(v), F.lit(end)).otherwise(v)))
    less = F.zip_with("__x", F.lit(pivots), lambda v, p: F.when(missing(v), F.lit(0.0)).otherwise(v - p))
    mask = F.transform("__x", lambda v: F.when(missing(v), 0.0).otherwise(1.0))
    rows = given.select(*[q(k) for k in keys], array_to_vector(less).alias("__d"), array_to_vector(mask).alias("__m"),
                        *([filled(math.inf).alias("__low"), filled(-math.inf).alias("__high")] if extremes else []))
    sums = [Summarizer.metrics("sum", "normL2").summary(F.col("__d")).alias("d"), Summarizer.sum(F.col("__m")).alias("m")]
    if extremes:
        sums += [Summarizer.min(F.col("__low")).alias("low"), Summarizer.max(F.col("__high")).alias("high")]
    wide = rows.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"), *sums).where("rows > 0")
    ends = ("low", "high") if extremes else ()
    cells = F.arrays_zip(F.lit(names).alias("feature"), F.lit(pivots).alias("pivot"), vector_to_array("d.sum").alias("sum"),
                         vector_to_array("d.normL2").alias("norm"), vector_to_array("m").alias("n"), *[vector_to_array(e).alias(e) for e in ends])
    long = wide.select(*[q(k) for k in keys], "rows", F.explode(cells).alias("p")).select(*[q(k) for k in keys], "rows", "p.*")
    n, off = F.col("n"), F.col("sum") / F.col("n")
    real = lambda v: F.when(n > 0, v)
    m2 = F.greatest(F.col("norm") * F.col("norm") - F.col("sum") * off, F.lit(0.0))
    return long.select(*[q(k) for k in keys], "feature", "rows", n.cast("long").alias("n"), real(F.col("pivot") + off).alias("mean"),
                       real(F.sqrt(m2 / n)).alias("std"), *[real(F.col(e)).alias(e) for e in ends])


def column_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n, mean, std, scale): non-missing count, mean, population std; scale = std, or 1 when std is 0.

    A feature with no values has null mean/std/scale.
    """
    return column_moments(df, features).select(
        "feature", "n", "mean", "std", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")).alias("scale"))


#: Heavy hitters: items that a task's summary tracks, items that it reports, and the a-priori error of its counts as a share of the rows
#: (3.5 over the summary's map size, the power of two from 4/3 of the tracked items on).
TRACKED, REPORTED = 10_000, 64
SUMMARY_ERROR = 3.5 / 16_384
#: Tables of fewer rows go the full way at once: there the extra scan costs more than the shuffle that it saves.
CERTIFY_ROWS = 2_000_000


def mode_candidates(df: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """{feature: values among which its most frequent one is}, for the features where mergeable summaries of one scan prove it.

    A reported count is at most the summary's error E too high, and a value that isn't reported has at most 2 E rows or, beyond the
    last place, no more than the last one reported. So where the highest count less E exceeds both, the mode (and each of its ties) is among the
    values whose count reaches it. Features without such a value (hardly any repeats) are left out.
    """
    out = {}
    for i in range(0, len(features), COLUMN_BATCH):
        part = list(features[i:i + COLUMN_BATCH])
        # -0.0 counts as 0.0
        x = df.select(*[(nan_to_null(q(c).cast("double")) + F.lit(0.0)).alias(f"x{j}") for j, c in enumerate(part)])
        row = x.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"approx_top_k(x{j}, {REPORTED}, {TRACKED})").alias(f"x{j}") for j in range(len(part))]).first()
        error = row["n"] * SUMMARY_ERROR
        for j, c in enumerate(part):
            items = row[f"x{j}"] or []
            top = [(r["item"], r["count"]) for r in items if r["item"] is not None]
            sure = max((n for _, n in top), default=0) - error
            if sure > 2 * error and (len(items) < REPORTED or sure > items[-1]["count"]):
                out[c] = [v for v, n in top if n >= sure]
    return out


def column_modes(df: DataFrame, features: Sequence[str], rows: int | None = None) -> DataFrame:
    """(feature, mode, count): most frequent non-missing value per feature; ties go to the smallest value.

    Features without any value are absent from the result. A summary scan first finds the few values that can be a feature's mode, and
    only those are counted; a feature whose summary proves nothing has all its values counted, so the result is always exact. With ``rows``, the known
    number of rows, small tables skip the summary. The maximum is taken in two hash aggregates (largest count,
    then smallest value of that count), without sorting the counts.
    """
    few = mode_candidates(df, features) if features and (rows is None or rows >= CERTIFY_ROWS) else {}
    counts = long_values(df, features, only=few).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))
    most = counts.groupBy("feature").agg(F.max("count").alias("count"))          # one row per feature
    return (counts.join(F.broadcast(most), ["feature", "count"]).groupBy("feature", "count")
            .agg(F.min("value").alias("mode")).select("feature", "mode", "count"))


def label_histogram(df: DataFrame, columns: Sequence[str], n_classes: int) -> DataFrame:
    """(class, <column>...) counts of each class value in each column; classes 0..K-1 all present (zeros)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("__which"), q(c).cast("int").alias("__class")) for c in columns])).alias("s"))
    counts = stacked.select("s.*").groupBy("__class").agg(*[
        F.count(F.when(F.col("__which") == c, 1)).alias(c) for c in columns])
    domain = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("__class"),
                                                      *[F.lit(0).cast("long").alias(c) for c in columns])
    return (counts.unionByName(domain).groupBy("__class")
            .agg(*[F.sum(q(c)).cast("long").alias(c) for c in columns]).withColumnRenamed("__class", "class"))
