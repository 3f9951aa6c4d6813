"""Column roles, argmax label, label names, metric division, epoch formatting."""

import math

from pyspark.sql import functions as F

from ctxspark.functions import (
    argmax_label,
    columns_with_prefix,
    epoch_to_utc_string,
    feature_columns,
    label_name,
    nan_div,
    sorted_columns,
    split_discrete_numeric,
    zero_div,
)

NAN = float("nan")


def test_roles_by_name():
    cols = ["uuid", "timestamp", "acc:x", "discrete:a", "label:SITTING", "label_source", "label_name", "labelled", "b"]
    assert columns_with_prefix(cols, "label") == ["label:SITTING", "label_source", "label_name", "labelled"]
    assert columns_with_prefix(cols) == cols
    feats = feature_columns(cols, ["label:SITTING"])
    assert feats == ["acc:x", "discrete:a", "b"]
    assert split_discrete_numeric(feats) == (["discrete:a"], ["acc:x", "b"])


def test_sorted_columns_code_point(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, A int, `a:x` int")
    assert sorted_columns(df).columns == ["A", "a:x", "b"]


def test_argmax_semantics(spark):
    rows = [
        (0.0, 1.0, 1.0),      # tie -> first maximum
        (0.0, 0.0, 0.0),      # all zero -> 0
        (1.0, None, 1.0),     # missing counts as the largest, first missing wins
        (None, None, None),   # all missing -> 0
        (0.0, NAN, None),     # NaN and null are both missing; the first one wins
        (0.0, 0.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "`label:a` double, `label:b` double, `label:c` double")
    got = [r[0] for r in df.select(argmax_label(["label:a", "label:b", "label:c"])).collect()]
    assert got == [1, 0, 1, 0, 1, 2]


def test_label_name(spark):
    df = spark.createDataFrame([(0,), (2,)], "label int")
    got = [r[0] for r in df.select(label_name(F.col("label"), ["x", "y", "z"])).collect()]
    assert got == ["x", "z"]


def test_divisions(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (3, 0)], "a long, b long")
    nd = [r[0] for r in df.select(nan_div(F.col("a"), F.col("b"))).collect()]
    zd = [r[0] for r in df.select(zero_div(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(nd[0]) and nd[1] == 0.5 and math.isnan(nd[2])
    assert zd == [0.0, 0.5, 0.0]


def test_epoch_format(spark):
    df = spark.createDataFrame([(0.0,), (1590000000.7,), (86399.0,)], "t double")
    got = [r[0] for r in df.select(epoch_to_utc_string(F.col("t"))).collect()]
    assert got == ["1970-01-01 00:00:00", "2020-05-20 18:40:00", "1970-01-01 23:59:59"]
