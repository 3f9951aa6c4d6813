"""Column statistics, modes, mixed prep estimator (incl. persistence), ANOVA F and the percentile rule."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ctxspark.operators import prep as pp
from ctxspark.operators import select as sel
from ctxspark.operators import stats as stx


def test_stats_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (3.0, 5.0, float("nan")), (None, 5.0, 3.0)],
                               "a double, c double, n double")
    st = {r.feature: r for r in stx.column_stats(df, ["a", "c", "n"]).collect()}
    assert st["a"].mean == 2.0 and abs(st["a"].std - math.sqrt(2 / 3)) < 1e-12 and st["a"].n == 3
    assert st["c"].std == 0.0 and st["c"].scale == 1.0
    assert st["n"].mean == 2.0 and st["n"].n == 2          # NaN is missing


def test_modes_ties_and_nulls(spark):
    df = spark.createDataFrame([(2.0, 1.0, None), (1.0, 1.0, None), (2.0, None, None), (1.0, 3.0, None)],
                               "t double, u double, z double")
    m = {r.feature: (r.mode, r["count"]) for r in stx.column_modes(df, ["t", "u", "z"]).collect()}
    assert m == {"t": (1.0, 2), "u": (1.0, 2)}              # tie -> smaller; all-null column absent


def test_wide_tables_take_one_scan(spark, tmp_dir):
    names = [f"f{i}" for i in range(300)]
    values = [[None if (n + i) % 11 == 0 or i == 5 else 4.0 if i == 6 else float("nan") if (n + i) % 13 == 0 else (1e9 if i % 3 == 0 else 0.0) + n * (i + 1) % 101 / 7
               for i in range(300)] for n in range(400)]
    schema = "label int, " + ", ".join(f"{c} double" for c in names)
    spark.createDataFrame([(n % 3, *v) for n, v in enumerate(values)], schema).write.parquet(f"{tmp_dir}/wide")
    df = spark.read.parquet(f"{tmp_dir}/wide")
    for keys, some in (([], names[:12]), (["label"], names[288:])):
        out = stx.column_moments(df, names, keys, extremes=True)
        assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        got = {tuple(r[k] for k in [*keys, "feature"]): r for r in out.collect()}
        for r in stx.column_moments(df, some, keys, extremes=True).collect():
            g = got[tuple(r[k] for k in [*keys, "feature"])]
            assert (g["rows"], g["n"]) == (r["rows"], r["n"])
            for c in ("mean", "std", "low", "high"):
                assert g[c] == (r[c] if r[c] is None else pytest.approx(r[c], rel=1e-9, abs=1e-6)), (r["feature"], c)
        assert len(got) == 300 * (3 if keys else 1)
    assert stx.column_moments(df.where("false"), names, ["label"]).collect() == []
    f = {r.feature: r.f_score for r in sel.anova_f(df, names).collect()}
    some = {r.feature: r.f_score for r in sel.anova_f(df, names[:12]).collect()}
    assert all(f[c] == pytest.approx(v, rel=1e-5, nan_ok=True) for c, v in some.items())


def test_certified_modes_are_exact(spark, monkeypatch):
    # x: few values; y: no repeats (not provable); z: one value among many others; t: a tie, also of 0.0 and -0.0; h: a tie behind the reported places
    df = spark.range(20_000).select(
        (F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("double").alias("y"),
        F.when(F.col("id") % 5 == 0, 3.5).otherwise(F.col("id").cast("double")).alias("z"),
        F.when(F.col("id") % 4 == 0, 0.0).when(F.col("id") % 4 == 1, -0.0).when(F.col("id") % 2 == 0, 9.0).otherwise(float("nan")).alias("t"),
        (F.col("id") % 200).cast("double").alias("h"), F.lit(None).cast("double").alias("none"))
    names = ["x", "y", "z", "t", "h", "none"]
    few = stx.mode_candidates(df, names)
    assert set(few) == {"x", "z", "t"} and few["z"] == [3.5] and few["t"] == [0.0]
    full = sorted(map(tuple, stx.column_modes(df, names, rows=20_000).collect()))
    assert sorted(map(tuple, stx.column_modes(df, names).collect())) == full
    assert full == [("h", 0.0, 100), ("t", 0.0, 10_000), ("x", 0.0, 2858), ("y", 0.0, 1), ("z", 3.5, 4000)]
    counted = stx.long_values(df, names, only=few).count()          # rows that reach the exact count
    assert counted == 74_000 and stx.long_values(df, names).count() == 95_000


def test_mixed_prep_transform_and_persistence(spark, tmp_dir):
    df = spark.createDataFrame([(1.0, 0.0, 7.0), (2.0, None, 7.0), (None, 1.0, 7.0), (2.0, 1.0, 7.0)],
                               "x double, discrete_d double, k double")
    df = df.withColumn("allnull", F.lit(None).cast("double"))
    model = pp.MixedPrep(inputCols=["x", "discrete_d", "k", "allnull"]).fit(df)
    assert model.feature_order() == ["discrete_d", "x", "k"]
    got = [list(r[0]) for r in model.transform(df).select(vector_to_array("features")).collect()]
    mean, std = 5 / 3, np.std([1.0, 2.0, 2.0])
    exp = [[0.0, (1 - mean) / std, 0.0], [1.0, (2 - mean) / std, 0.0], [1.0, (2 - mean) / std, 0.0],
           [1.0, (2 - mean) / std, 0.0]]
    assert np.allclose(got, exp)
    path = f"{tmp_dir}/prep"
    PipelineModel([model]).write().overwrite().save(path)
    again = [list(r[0]) for r in PipelineModel.load(path).transform(df).select(vector_to_array("features")).collect()]
    assert np.allclose(again, exp)


def test_nullable_modes_are_exact_or_raise(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, None), (2.0, 1.0), (3.0, 1.0)], "x double, discrete_d double")
    model = pp.MixedPrep(inputCols=["x", "discrete_d"], modesFor="nullable").fit(df)
    full = pp.MixedPrep(inputCols=["x", "discrete_d"]).fit(df)
    one = lambda m, rows: [list(r[0]) for r in m.transform(rows).select(vector_to_array("features")).collect()]
    assert one(model, df) == one(full, df)
    with pytest.raises(Exception, match="missing values"):
        one(model, spark.createDataFrame([(None, 1.0)], df.schema))


def test_percentile_rule():
    s = [1.0, 5.0, 3.0, 3.0, 3.0, 2.0, 9.0, 8.0, 0.5, 7.0, 6.0, 4.0]
    m = sel.percentile_mask(s, 40)
    assert [i for i, x in enumerate(m) if x] == [1, 6, 7, 9, 10]
    assert sel.percentile_mask(list(range(12)), 40) == [False] * 7 + [True] * 5
    tied = sel.percentile_mask([1.0, 2.0, 2.0, 2.0, 0.0], 40)       # ties filled in column order
    assert tied == [False, True, True, False, False]
    assert sel.percentile_mask([1.0, float("nan"), 2.0], 100) == [True, True, True]
    assert sel.percentile_mask([1.0, 2.0], 0) == [False, False]
    assert sel.percentile_mask([float("nan"), 1.0, 2.0, 3.0, 4.0], 40) == [False, False, False, True, True]


def _anova_numpy(x, y):
    classes = np.unique(y)
    n, k = len(x), len(classes)
    grand = x.mean()
    ssb = sum((y == c).sum() * (x[y == c].mean() - grand) ** 2 for c in classes)
    ssw = sum(((x[y == c] - x[y == c].mean()) ** 2).sum() for c in classes)
    return (ssb / (k - 1)) / (ssw / (n - k))


def test_anova_matches_numpy_and_is_affine_invariant(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    a = rng.normal(size=400) + y
    b = rng.normal(size=400)
    b_missing = b.copy()
    b_missing[::7] = np.nan
    d = rng.integers(0, 3, 400).astype(float)
    d[::11] = np.nan
    rows = [(int(y[i]), float(a[i]), float(b_missing[i]), float(d[i]), float(3 * a[i] + 2), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "label int, a double, b double, discrete_d double, a2 double, c double")
    f = {r.feature: r.f_score for r in sel.anova_f(df, ["a", "b", "discrete_d", "a2", "c"]).collect()}
    assert abs(f["a"] - _anova_numpy(a, y)) < 1e-8 * f["a"]
    b_fill = np.where(np.isnan(b_missing), np.nanmean(b_missing), b_missing)
    assert abs(f["b"] - _anova_numpy(b_fill, y)) < 1e-8 * max(1, f["b"])
    vals, cnt = np.unique(d[~np.isnan(d)], return_counts=True)
    d_fill = np.where(np.isnan(d), vals[np.argmax(cnt)], d)
    assert abs(f["discrete_d"] - _anova_numpy(d_fill, y)) < 1e-8 * max(1, f["discrete_d"])
    assert abs(f["a"] - f["a2"]) < 1e-8 * f["a"]
    assert math.isnan(f["c"])                                       # constant feature: 0/0
    chosen = sel.selected_names(sel.select_features(df, ["a", "b", "discrete_d", "a2", "c"], 40))
    assert set(chosen) == {"a", "a2"}


def test_twelve_features_at_forty_percent(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 4, 300)
    cols = {f"f{i:02d}": rng.normal(size=300) + (i / 4) * y for i in range(12)}
    rows = [(int(y[j]), *[float(cols[c][j]) for c in cols]) for j in range(300)]
    df = spark.createDataFrame(rows, "label int, " + ", ".join(f"{c} double" for c in cols))
    chosen = sel.selected_names(sel.select_features(df, list(cols), 40))
    assert chosen == [f"f{i:02d}" for i in range(7, 12)]


def test_mixed_prep_validation(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        pp.MixedPrep(inputCols=["x", "missing"]).fit(df)
    with pytest.raises(ValueError):
        pp.MixedPrep().fit(df)
    assert not hasattr(pp.MixedPrep(inputCols=["x"]), "transform")   # an estimator transforms only once fitted
