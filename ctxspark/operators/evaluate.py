"""Evaluation: confusion counts, per-class state, per-fold and pooled metrics, reports and scorers.

The only pass over prediction rows is :func:`confusion_counts` (a partial + final hash aggregate whose output has
at most #keys x K x K rows). Everything after it runs on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.functions import nan_div, q, zero_div

METRIC_COLUMNS = ("Accuracy", "Sensitivity", "Specifisity", "BA", "Precision", "F1")
STATE_COLUMNS = ("tp", "tn", "fp", "fn")


def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., label, prediction, n): counts of true x predicted class."""
    return (pred.groupBy(*[q(k) for k in keys], q(label).cast("int").alias("label"),
                         q(prediction).cast("int").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def _window(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*[q(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))


def class_state(confusion: DataFrame, keys: Sequence[str] = (), n_classes: int | None = None,
                require_all_classes: bool = True) -> DataFrame:
    """(keys..., class, tp, tn, fp, fn, support) per class from confusion counts.

    Each count row contributes once to its true class and once to its predicted class (a generate, not a join).
    With ``n_classes`` = K a class outside 0..K-1 raises, and so does a group that lacks one of them; without it the
    classes are those of the counts, and one that is only predicted raises. A missing (null) class raises.
    """
    n, y, p = F.col("n"), F.col("label"), F.col("prediction")
    sides = F.array(
        F.struct(y.alias("class"), n.alias("true_n"), F.lit(0).cast("long").alias("pred_n"),
                 F.when(y == p, n).otherwise(F.lit(0).cast("long")).alias("hit")),
        F.struct(p.alias("class"), F.lit(0).cast("long").alias("true_n"), n.alias("pred_n"),
                 F.lit(0).cast("long").alias("hit")),
    )
    per = (confusion.select(*[q(k) for k in keys], F.explode(sides).alias("s")).select(*[q(k) for k in keys], "s.*")
           .groupBy(*[q(k) for k in keys], "class")
           .agg(F.sum("true_n").alias("support"), F.sum("pred_n").alias("predicted"), F.sum("hit").alias("tp")))
    known = F.col("class").isNotNull()
    if n_classes is not None:
        known &= F.col("class").between(0, n_classes - 1)
    per = per.withColumn("class", F.when(known, F.col("class")).otherwise(F.raise_error(
        F.concat(F.lit("class outside the known ones: "), F.coalesce(F.col("class").cast("string"), F.lit("null"))))))
    w = _window(keys)
    total = F.sum("support").over(w)
    tp = F.col("tp")
    fn = F.col("support") - tp
    fp = F.col("predicted") - tp
    if require_all_classes:
        present = F.count(F.when(F.col("support") > 0, 1)).over(w)
        wanted = F.lit(n_classes) if n_classes is not None else F.count(F.lit(1)).over(w)
        tp = F.when(present == wanted, tp).otherwise(
            F.raise_error(F.lit("every class needs support in each evaluated group")))
    return per.select(*[q(k) for k in keys], F.col("class").cast("int").alias("class"), tp.cast("long").alias("tp"),
                      (total - F.col("support") - fp).cast("long").alias("tn"), fp.cast("long").alias("fp"),
                      fn.cast("long").alias("fn"), F.col("support").cast("long").alias("support"))


def pooled_state(state: DataFrame, keys: Sequence[str] = ("model",), fold: str = "fold") -> DataFrame:
    """Per-fold rows plus pooled rows (fold = null): the sum of the fold states, per class."""
    cols = [*keys, fold, "class"]
    sums = [F.sum(c).cast("long").alias(c) for c in (*STATE_COLUMNS, "support")]
    return (state.groupingSets([[*[q(k) for k in keys], q(fold), F.col("class")], [*[q(k) for k in keys], F.col("class")]],
                               *[q(c) for c in cols]).agg(*sums)
            .select(*[q(c) for c in cols], *STATE_COLUMNS, "support"))


def class_weights(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., class, support, weight): class share of the evaluated rows."""
    return state.select(*[q(k) for k in keys], "class", "support",
                        (F.col("support") / F.sum("support").over(_window(keys))).alias("weight"))


def metric_columns(tp: Column, tn: Column, fp: Column, fn: Column, div=nan_div) -> dict[str, Column]:
    """Sensitivity (TPR), Specifisity (TNR), Accuracy, Precision, BA, F1; 0/0 follows ``div``."""
    tpr = div(tp, tp + fn)
    tnr = div(tn, tn + fp)
    prec = div(tp, tp + fp)
    return {
        "Accuracy": div(tp + tn, tp + fp + tn + fn),
        "Sensitivity": tpr,
        "Specifisity": tnr,
        "BA": (tpr + tnr) / 2,
        "Precision": prec,
        "F1": div(2 * tpr * prec, tpr + prec),
    }


def class_metrics(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-class metrics (keys..., class, support, Accuracy, ..., F1)."""
    m = metric_columns(*(F.col(c) for c in STATE_COLUMNS))
    return state.select(*[q(k) for k in keys], "class", "support", *[v.alias(k) for k, v in m.items()])


def _classifier(keys: Sequence[str]) -> Column:
    if "model" in keys and "fold" in keys:
        return F.when(F.col("fold").isNull(), F.col("model")).otherwise(
            F.concat_ws("_", F.col("model"), F.col("fold").cast("string")))
    if "model" in keys:
        return F.col("model")
    return F.lit("model")


def _summary(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One aggregation per key group -> macro, micro and weighted metrics as one row of structs."""
    k = [q(x) for x in keys]
    m = metric_columns(*(F.col(c) for c in STATE_COLUMNS))
    per = state.select(*k, *STATE_COLUMNS, "support", *[v.alias(f"m_{c}") for c, v in m.items()])
    agg = per.groupBy(*k).agg(
        *[F.sum(c).alias(c) for c in STATE_COLUMNS],
        *[F.avg(f"m_{c}").alias(f"macro_{c}") for c in METRIC_COLUMNS],
        *[(F.sum(F.col("support") * F.col(f"m_{c}")) / F.sum("support")).alias(f"weighted_{c}")
          for c in METRIC_COLUMNS])
    micro = metric_columns(*(F.col(c) for c in STATE_COLUMNS))
    rows = F.array(
        F.struct(F.lit("macro").alias("t"), *[F.col(f"macro_{c}").alias(c) for c in METRIC_COLUMNS]),
        F.struct(F.lit("micro").alias("t"), *[micro[c].alias(c) for c in METRIC_COLUMNS]),
        F.struct(F.lit("weighted").alias("t"), *[F.col(f"weighted_{c}").alias(c) for c in METRIC_COLUMNS]),
    )
    return agg.select(*k, F.explode(rows).alias("r")).select(
        *k, F.col("r.t").alias("Test type"), _classifier(keys).alias("Classifier"),
        *[F.col(f"r.{c}").alias(c) for c in METRIC_COLUMNS])


def micro_results(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key group: metrics of the class-summed TP, TN, FP, FN."""
    return _summary(state, keys).filter(F.col("`Test type`") == "micro")


def macro_results(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Plain mean of per-class metrics; a NaN class metric makes the mean NaN."""
    return _summary(state, keys).filter(F.col("`Test type`") == "macro")


def weighted_results(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-class metrics weighted by class share of the evaluated rows."""
    return _summary(state, keys).filter(F.col("`Test type`") == "weighted")


def results_table(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """macro, micro and weighted rows for every key group (the saved results table), from one aggregation."""
    return _summary(state, keys)


def fold_results(pred: DataFrame, models: dict[str, str] | Sequence[str], label: str = "label", fold: str = "fold",
                 n_classes: int | None = None) -> DataFrame:
    """Results of several prediction columns, per fold and pooled, from one pass over the rows.

    ``models`` maps a model name to its prediction column (or lists columns used as names).
    """
    models = dict(models) if isinstance(models, dict) else {m: m for m in models}
    stacked = pred.select(q(fold).alias("fold"), q(label).alias("label"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), q(col).cast("int").alias("prediction")) for name, col in models.items()
    ])).alias("m")).select("m.model", "fold", "label", "m.prediction")
    conf = confusion_counts(stacked, keys=("model", "fold"))
    state = class_state(conf, keys=("model", "fold"), n_classes=n_classes)
    return results_table(pooled_state(state, keys=("model",), fold="fold"), keys=("model", "fold"))


def f1_scores(confusion: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Scorer values: f1_macro over classes present in truth or prediction (0/0 -> 0), f1_micro (= accuracy)."""
    n, y, p = F.col("n"), F.col("label"), F.col("prediction")
    sides = F.array(
        F.struct(y.alias("class"), n.alias("true_n"), F.lit(0).cast("long").alias("pred_n"),
                 F.when(y == p, n).otherwise(F.lit(0).cast("long")).alias("hit")),
        F.struct(p.alias("class"), F.lit(0).cast("long").alias("true_n"), n.alias("pred_n"),
                 F.lit(0).cast("long").alias("hit")),
    )
    per = (confusion.select(*[q(k) for k in keys], F.explode(sides).alias("s")).select(*[q(k) for k in keys], "s.*")
           .groupBy(*[q(k) for k in keys], "class")
           .agg(F.sum("true_n").alias("support"), F.sum("pred_n").alias("predicted"), F.sum("hit").alias("tp")))
    prec = zero_div(F.col("tp"), F.col("predicted"))
    rec = zero_div(F.col("tp"), F.col("support"))
    f1 = zero_div(2 * prec * rec, prec + rec)
    return (per.groupBy(*[q(k) for k in keys])
            .agg(F.avg(f1).alias("f1_macro"), zero_div(F.sum("tp"), F.sum("support")).alias("f1_micro")))


def classification_report(confusion: DataFrame, keys: Sequence[str] = (), n_classes: int | None = None) -> DataFrame:
    """Per-class precision / recall / f1 / support, then accuracy, macro avg and weighted avg rows.

    The classes are those of the counts; with ``n_classes`` any other raises. 0/0 gives 0 as in the usual text report. ``row`` holds the class index as text or the summary name.
    """
    st = class_state(confusion, keys=keys, n_classes=n_classes, require_all_classes=False)
    prec = zero_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = zero_div(F.col("tp"), F.col("tp") + F.col("fn"))
    per = st.select(*[q(k) for k in keys], "class", prec.alias("precision"), rec.alias("recall"),
                    "support", "tp").withColumn(
        "f1", zero_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    k = [q(x) for x in keys]
    per_rows = per.select(*k, F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support")
    agg = per.groupBy(*k).agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").alias("n"), F.sum("tp").alias("hits"))
    acc = agg.select(*k, F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("hits") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    macro = agg.select(*k, F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), F.col("n").alias("support"))
    weighted = agg.select(*k, F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    return per_rows.unionByName(acc).unionByName(macro).unionByName(weighted)
