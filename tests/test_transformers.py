"""A list of transformers: planned statistics against step-by-step NumPy, validation, dropped features, persistence."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ctxspark.operators import prep as pp
from ctxspark.operators import transformers as tf
from ctxspark.operators.transformers import Impute, Kind, MinMaxScale, StandardScale

FEATS = ["x", "discrete_d", "k", "y"]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    rows = [(float(r.integers(0, 5)) if i % 4 else None, float(r.integers(0, 3)) if i % 3 else None, 7.0, float(r.normal()) if i % 5 else float("nan"))
            for i in range(60)]
    return spark.createDataFrame(rows, "x double, discrete_d double, k double, y double").cache()


def plain(df, transformers):
    """Each step on the columns as the steps before left them, as a list of transformers is applied by hand."""
    table = {c: np.array([np.nan if r[c] is None else r[c] for r in df.collect()]) for c in FEATS}
    for _, t, kind in transformers:
        for c in [c for c in table if c.startswith("discrete") == (kind is Kind.DISCRETE)]:
            x, real = table[c], table[c][~np.isnan(table[c])]
            if isinstance(t, Impute):
                if t.strategy == "constant":
                    fill = t.value
                elif not len(real):
                    del table[c]
                    continue
                else:
                    values, counts = np.unique(real, return_counts=True)
                    fill = real.mean() if t.strategy == "mean" else values[counts.argmax()]
                table[c] = np.where(np.isnan(x), fill, x)
            elif isinstance(t, StandardScale):
                table[c] = (x - real.mean()) / (real.std() or 1.0)
            else:
                table[c] = (x - real.min()) / ((real.max() - real.min()) or 1.0)
    return table


LISTS = {
    "default": tf.DEFAULT,
    "fill first": (("a", Impute("mean"), Kind.NUMERIC), ("b", StandardScale(), Kind.NUMERIC), ("c", MinMaxScale(), Kind.NUMERIC), ("d", Impute("constant", 9), Kind.DISCRETE),
                   ("e", StandardScale(), Kind.DISCRETE)),
    # the most frequent value after a fill by another one has to be read again; it is the fill where many values were missing
    "mode after fill": (("a", Impute("constant", 2.5), Kind.NUMERIC), ("b", MinMaxScale(), Kind.NUMERIC), ("c", Impute(), Kind.NUMERIC),
                        ("d", Impute("mean"), Kind.DISCRETE), ("e", Impute(), Kind.DISCRETE)),
    "no fill": (("a", StandardScale(), Kind.NUMERIC), ("b", MinMaxScale(), Kind.NUMERIC)),
    "nothing": (),
}


@pytest.mark.parametrize("name", LISTS)
def test_list_equals_step_by_step(data, name):
    model = tf.ColumnTransformers(inputCols=FEATS, transformers=tf.to_json(LISTS[name])).fit(data)
    got = np.array([r[0] for r in model.transform(data).select(vector_to_array("features")).collect()])
    want = plain(data, LISTS[name])
    assert model.feature_order() == ["discrete_d", "x", "k", "y"]
    assert np.allclose(got, np.stack([want[c] for c in model.feature_order()], 1), equal_nan=True)


def test_default_list_equals_the_mixed_prep(data):
    one = lambda m: np.array([r[0] for r in m.transform(data).select(vector_to_array("features")).collect()])
    assert np.allclose(one(tf.ColumnTransformers(inputCols=FEATS).fit(data)), one(pp.MixedPrep(inputCols=FEATS).fit(data)))


def test_features_without_values(data):
    df = data.withColumn("none", F.lit(None).cast("double")).withColumn("discrete_none", F.lit(None).cast("double"))
    model = tf.ColumnTransformers(inputCols=[*FEATS, "none", "discrete_none"]).fit(df)
    assert set(model.feature_order()) == set(FEATS)
    kept = tf.ColumnTransformers(inputCols=["none"], transformers=tf.to_json((("f", Impute("constant", 4), Kind.NUMERIC), ("s", MinMaxScale(), Kind.NUMERIC)))).fit(df)
    assert {r[0][0] for r in kept.transform(df).select(vector_to_array("features")).collect()} == {0.0}


@pytest.mark.parametrize("entry, error", [(("s", object(), Kind.NUMERIC), TypeError), (("s", StandardScale(), "numeric"), ValueError),
                                          (("s", StandardScale(), "other"), ValueError)])
def test_wrong_entries_raise(entry, error):
    with pytest.raises(error):
        tf.to_json([entry])
    with pytest.raises(ValueError):
        Impute("median")
    with pytest.raises(ValueError):
        tf.ColumnTransformers(inputCols=["gone"])._fit(type("D", (), {"columns": []})())


def test_saved_model_gives_the_same(data, tmp_dir):
    model = tf.ColumnTransformers(inputCols=FEATS).fit(data)
    PipelineModel([model]).write().overwrite().save(f"{tmp_dir}/prep")
    rows = lambda m: [r[0] for r in m.transform(data).select(vector_to_array("features")).collect()]
    assert rows(PipelineModel.load(f"{tmp_dir}/prep")) == rows(model)
