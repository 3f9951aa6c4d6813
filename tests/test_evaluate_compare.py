"""Per-class state, per-fold and pooled results, NaN metric semantics, scorers, comparison tables."""

import math

import pytest
from pyspark.sql import functions as F

from ctxspark.operators import compare as cmp
from ctxspark.operators import evaluate as ev


def _pred(spark, rows):
    return spark.createDataFrame(rows, "fold int, label int, prediction int")


def test_state_identities(spark):
    rows = [(f, y, (y + f) % 3 if (y + f) % 2 else y) for f in range(2) for y in range(3) for _ in range(5 + y)]
    st = ev.class_state(ev.confusion_counts(_pred(spark, rows), keys=("fold",)), keys=("fold",), n_classes=3)
    for r in st.collect():
        assert r.tp + r.fn == r.support
    tot = st.groupBy("fold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
                                 F.sum("support").alias("n")).collect()
    for r in tot:
        assert r.tp + r.fp == r.n and r.tp + r.fn == r.n
    pooled = ev.pooled_state(st.withColumn("model", F.lit("m")), keys=("model",))
    p = {r["class"]: r for r in pooled.filter(F.col("fold").isNull()).collect()}
    per = st.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")]).collect()
    for r in per:
        assert (p[r["class"]].tp, p[r["class"]].tn, p[r["class"]].fp, p[r["class"]].fn) == (r.tp, r.tn, r.fp, r.fn)


def test_missing_class_raises(spark):
    st = ev.class_state(ev.confusion_counts(_pred(spark, [(0, 0, 0), (0, 1, 1)])), n_classes=3)
    with pytest.raises(Exception):
        st.collect()


def test_never_predicted_class_nan_macro_and_zero_scorer(spark):
    rows = [(0, 0, 0), (0, 0, 0), (0, 1, 0), (0, 2, 2)]          # class 1 never predicted
    conf = ev.confusion_counts(_pred(spark, rows))
    st = ev.class_state(conf, n_classes=3)
    macro = ev.macro_results(st).collect()[0]
    assert math.isnan(macro["Precision"]) and math.isnan(macro["F1"])
    micro = ev.micro_results(st).collect()[0]
    assert micro["Accuracy"] == pytest.approx((3 + 3 + 4) / 12)   # (TP+TN)/all summed over classes
    f1 = ev.f1_scores(conf).collect()[0]
    assert f1.f1_micro == pytest.approx(0.75)
    assert f1.f1_macro == pytest.approx((0.8 + 0.0 + 1.0) / 3)


def test_results_table_shape(spark):
    rows = [(f, y, (y * f) % 3) for f in range(3) for y in range(3) for _ in range(4)]
    res = ev.fold_results(_pred(spark, rows), {"m": "prediction"}, n_classes=3)
    assert res.count() == 3 * (3 + 1)
    assert set(res.columns) >= {"Test type", "Classifier", "Accuracy", "Sensitivity", "Specifisity", "BA",
                                "Precision", "F1"}
    names = {r.Classifier for r in res.collect()}
    assert names == {"m", "m_0", "m_1", "m_2"}


def test_results_same_at_1_and_8_partitions(spark):
    rows = [(f, y, (y + f) % 4) for f in range(2) for y in range(4) for _ in range(3 + f + y)]
    df = _pred(spark, rows)
    a = ev.fold_results(df.coalesce(1), {"m": "prediction"}, n_classes=4).collect()
    b = ev.fold_results(df.repartition(8), {"m": "prediction"}, n_classes=4).collect()
    key = lambda r: (r.model, -1 if r.fold is None else r.fold, r["Test type"])
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        for c in ev.METRIC_COLUMNS:
            assert x[c] == pytest.approx(y[c], rel=1e-12, nan_ok=True)


def test_classification_report(spark):
    conf = ev.confusion_counts(_pred(spark, [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 1)]))
    rep = {r.row: r for r in ev.classification_report(conf).collect()}
    assert rep["0"].precision == 1.0 and rep["0"].recall == 0.5
    assert rep["1"].precision == pytest.approx(2 / 3) and rep["1"].recall == 1.0
    assert rep["accuracy"].f1 == 0.75 and rep["macro avg"].support == 4


def test_agreement_tables(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 0), (1, 1, 1), (1, 0, 0), (2, 1, 1)],
                               "label int, a int, b int")
    m = {(r.correct_a, r.correct_b): (r.n, r.share) for r in cmp.agreement_matrix(df, "label", "a", "b").collect()}
    assert m[(1, 0)] == (1, 0.2) and m[(1, 1)] == (2, 0.4) and m[(0, 1)] == (0, 0.0) and m[(0, 0)] == (2, 0.4)
    byc = cmp.agreement_matrix(df, "label", "a", "b", by_class=True).collect()
    assert len(byc) == 12
    h = {r["class"]: (r.label, r.a, r.b) for r in cmp.disagreement_histogram(df, "label", "a", "b", 3).collect()}
    assert h == {0: (1, 1, 0), 1: (0, 0, 1), 2: (0, 0, 0)}


def test_agreement_scores_only_the_rows_asked_for(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).select("id", (F.col("id") % 100).alias("uuid"), (F.col("id") % 3).cast("int").alias("label")).write.parquet(path)
    scored = spark.sparkContext.accumulator(0)

    def score(x):
        scored.add(1)
        return x % 2

    model = F.udf(score, "int")
    rows = spark.read.parquet(path).join(spark.createDataFrame([(7,), (8,)], "uuid long"), "uuid").withColumn("a", model("label")).withColumn("b", F.lit(1))
    got = {(r.label, r.correct_a, r.correct_b): r.n for r in cmp.agreement_matrix(rows, "label", "a", "b", by_class=True).collect()}
    assert len(got) == 12 and sum(got.values()) == 20
    # the model isn't applied to rows that the join leaves out
    assert scored.value == 20


def test_agreement_of_missing_predictions(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, None, 0), (1, 0, 1)], "label int, a int, b int")
    got = {(r.label, r.correct_a, r.correct_b): (r.n, r.share) for r in cmp.agreement_matrix(rows, "label", "a", "b", by_class=True).collect()}
    assert got == {(k, x, y): (int((k, x, y) in ((0, 1, 1), (1, 0, 1))), float((k, x, y) in ((0, 1, 1), (1, 0, 1))))
                   for k in (0, 1) for x in (0, 1) for y in (0, 1)}
    assert cmp.agreement_matrix(rows.limit(0), "label", "a", "b", by_class=True).count() == 0
