"""Brute-force properties on small random fixtures (hypothesis): Spark operators vs plain NumPy / Python."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ctxspark.functions import argmax_label
from ctxspark.operators import evaluate as ev

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
cell = st.one_of(st.none(), st.just(float("nan")), st.sampled_from([0.0, 1.0, 0.5, 2.0]))


@SETTINGS
@given(st.lists(st.tuples(cell, cell, cell, cell), min_size=1, max_size=25))
def test_argmax_matches_numpy(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(argmax_label(["a", "b", "c", "d"])).collect()]
    arr = np.array([[np.nan if v is None else v for v in r] for r in rows], dtype=float)
    assert got == [int(i) for i in np.argmax(arr, axis=1)]


def _brute_state(y, p, k):
    out = {}
    for c in range(k):
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        fn = sum(1 for a, b in zip(y, p) if a == c and b != c)
        fp = sum(1 for a, b in zip(y, p) if a != c and b == c)
        out[c] = (tp, len(y) - tp - fn - fp, fp, fn)
    return out


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=60))
def test_state_and_scores_match_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, prediction int")
    conf = ev.confusion_counts(df)
    y = [a for a, _ in pairs]
    p = [b for _, b in pairs]
    state = {r["class"]: (r.tp, r.tn, r.fp, r.fn) for r in
             ev.class_state(conf, n_classes=4, require_all_classes=False).collect()}
    brute = _brute_state(y, p, 4)
    for c, v in state.items():
        assert v == brute[c]
    # scorer semantics: classes present in truth or prediction, 0/0 -> 0
    classes = sorted(set(y) | set(p))
    f1s = []
    for c in classes:
        tp, _, fp, fn = brute[c]
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / (tp + fn) if tp + fn else 0.0
        f1s.append(2 * prec * rec / (prec + rec) if prec + rec else 0.0)
    r = ev.f1_scores(conf).collect()[0]
    assert math.isclose(r.f1_macro, sum(f1s) / len(f1s), rel_tol=1e-12, abs_tol=1e-12)
    assert math.isclose(r.f1_micro, sum(1 for a, b in pairs if a == b) / len(pairs), rel_tol=1e-12)
