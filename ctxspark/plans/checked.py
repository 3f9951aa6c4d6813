"""Registry of checked queries: every operator of the inventory that has a table form.

Each entry is a Spark builder ``(spark, sf_dir) -> DataFrame`` over the provided tables, and where the result is
expressible in SQL a DuckDB oracle over the same parquet views. Floating results are rounded to a fixed number of
decimals on both sides (sums are ordered differently by the two engines).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.functions import epoch_to_utc_string, q, split_discrete_numeric
from ctxspark.operators import compare as cmp
from ctxspark.operators import evaluate as ev
from ctxspark.operators import folds as fo
from ctxspark.operators import labels as lb
from ctxspark.operators import models as md
from ctxspark.operators import prep as pp
from ctxspark.operators import select as sel
from ctxspark.operators import stats as stx
from ctxspark.operators import transformers as tf
from ctxspark.operators import tune
from ctxspark.plans import flows, sqlgen
from ctxspark.session import shared_dir
from ctxspark.sources import fixtures as fx
from ctxspark.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[
        F.round(q(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else q(f.name)
        for f in df.schema.fields
    ])


def _r(items: list[str], digits: int = 9) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in items)


# ---- shared Spark inputs ----------------------------------------------------------------------------------------

def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with rule predictions, tagged with the fold whose test split holds their user."""
    test = fx.members(spark, sf_dir).filter(F.col("split") == "test").select("uuid", "fold")
    return fx.labelled_samples(spark, sf_dir).join(test, "uuid")


def _confusion_all(spark, sf_dir, model="pred_a"):
    return ev.confusion_counts(fx.labelled_samples(spark, sf_dir), prediction=model)


def _stacked(df: DataFrame, keys=("fold",)) -> DataFrame:
    return df.select(*keys, "label", F.explode(F.array(
        F.struct(F.lit("pred_a").alias("model"), F.col("pred_a").alias("prediction")),
        F.struct(F.lit("pred_b").alias("model"), F.col("pred_b").alias("prediction")),
    )).alias("m")).select("m.model", *keys, "label", "m.prediction")


def _fold_state(spark, sf_dir):
    conf = ev.confusion_counts(_stacked(fold_predictions(spark, sf_dir)), keys=("model", "fold"))
    return ev.pooled_state(ev.class_state(conf, keys=("model", "fold")), keys=("model",), fold="fold")


# ---- shared SQL inputs -----------------------------------------------------------------------------------------

LAB = f"lab AS ({fx.LABELLED_SQL})"
MEM = f"mem AS ({fx.MEMBERS_SQL})"
FOLD_PRED = f"""{LAB}, {MEM},
fp AS (SELECT m.fold, l.* FROM lab l JOIN mem m ON l.uuid = m.uuid AND m.split = 'test'),
stacked AS (SELECT 'pred_a' AS model, fold, label, pred_a AS prediction FROM fp
            UNION ALL SELECT 'pred_b' AS model, fold, label, pred_b AS prediction FROM fp),
conf AS (SELECT model, fold, label, prediction, count(*) AS n FROM stacked GROUP BY ALL),
st AS ({sqlgen.class_state_sql("conf", ["model", "fold"])}),
pooled AS (SELECT model, fold, class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(tn) AS BIGINT) AS tn,
                  CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(support) AS BIGINT) AS support
           FROM st GROUP BY GROUPING SETS ((model, fold, class), (model, class)))"""

CLASSIFIER_SQL = """CASE WHEN fold IS NULL THEN model ELSE model || '_' || CAST(fold AS VARCHAR) END"""
MET = list(ev.METRIC_COLUMNS)

# ---- A4, A6, A7: counts and per-class state --------------------------------------------------------------------


@register("a4_class_counts", f"""WITH {LAB}
SELECT label, count(*) AS n FROM lab GROUP BY label""")
def a4_class_counts(spark, sf_dir):
    return fx.labelled_samples(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("a6_confusion_counts", f"""WITH {LAB}
SELECT label, pred_a AS prediction, count(*) AS n FROM lab GROUP BY ALL""")
def a6_confusion_counts(spark, sf_dir):
    return _confusion_all(spark, sf_dir)


@register("a7_class_state", f"""WITH {LAB},
conf AS (SELECT label, pred_a AS prediction, count(*) AS n FROM lab GROUP BY ALL)
{sqlgen.class_state_sql("conf", [])}""")
def a7_class_state(spark, sf_dir):
    return ev.class_state(_confusion_all(spark, sf_dir))


@register("a8_fold_state", f"""WITH {FOLD_PRED}
SELECT * FROM pooled""")
def a8_fold_state(spark, sf_dir):
    return _fold_state(spark, sf_dir)


@register("a9_class_weights", f"""WITH {FOLD_PRED}
SELECT model, fold, class, support, round(support / sum(support) OVER (PARTITION BY model, fold), 9) AS weight
FROM pooled""")
def a9_class_weights(spark, sf_dir):
    return round_doubles(ev.class_weights(_fold_state(spark, sf_dir), keys=("model", "fold")))


# ---- E2-E7: results per fold and pooled ------------------------------------------------------------------------

_MICRO_SQL = f"""SELECT model, fold, 'micro' AS "Test type", {CLASSIFIER_SQL} AS "Classifier", {sqlgen.metrics_sql()}
FROM (SELECT model, fold, sum(tp) AS tp, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn FROM pooled GROUP BY ALL)"""
_PER_CLASS_SQL = f"""SELECT model, fold, class, support, {sqlgen.metrics_sql(digits=18)},
       support / sum(support) OVER (PARTITION BY model, fold) AS weight FROM pooled"""
_MACRO_SQL = f"""SELECT model, fold, 'macro' AS "Test type", {CLASSIFIER_SQL} AS "Classifier",
       {", ".join(f'avg("{c}") AS "{c}"' for c in MET)}
FROM ({_PER_CLASS_SQL}) GROUP BY model, fold"""
_WEIGHTED_SQL = f"""SELECT model, fold, 'weighted' AS "Test type", {CLASSIFIER_SQL} AS "Classifier",
       {", ".join(f'sum(weight * "{c}") AS "{c}"' for c in MET)}
FROM ({_PER_CLASS_SQL}) GROUP BY model, fold"""


def _results_sql(*parts: str) -> str:
    body = " UNION ALL ".join(f"({p})" for p in parts)
    return f"""WITH {FOLD_PRED}
SELECT model, fold, "Test type", "Classifier", {_r(MET)} FROM ({body})"""


@register("e3_micro_results", _results_sql(_MICRO_SQL))
def e3_micro_results(spark, sf_dir):
    return round_doubles(ev.micro_results(_fold_state(spark, sf_dir), keys=("model", "fold")))


@register("e4_macro_results", _results_sql(_MACRO_SQL))
def e4_macro_results(spark, sf_dir):
    return round_doubles(ev.macro_results(_fold_state(spark, sf_dir), keys=("model", "fold")))


@register("e5_weighted_results", _results_sql(_WEIGHTED_SQL))
def e5_weighted_results(spark, sf_dir):
    return round_doubles(ev.weighted_results(_fold_state(spark, sf_dir), keys=("model", "fold")))


@register("e7_results_table", _results_sql(_MACRO_SQL, _MICRO_SQL, _WEIGHTED_SQL))
def e7_results_table(spark, sf_dir):
    return round_doubles(ev.fold_results(fold_predictions(spark, sf_dir), ["pred_a", "pred_b"]))


@register("e6_class_metrics", f"""WITH {LAB},
stacked AS (SELECT 'pred_a' AS model, label, pred_a AS prediction FROM lab
            UNION ALL SELECT 'pred_b' AS model, label, pred_b AS prediction FROM lab),
conf AS (SELECT model, label, prediction, count(*) AS n FROM stacked GROUP BY ALL),
st AS ({sqlgen.class_state_sql("conf", ["model"])})
SELECT model, class, support, {_r(MET)} FROM (SELECT model, class, support, {sqlgen.metrics_sql()} FROM st)""")
def e6_class_metrics(spark, sf_dir):
    conf = ev.confusion_counts(_stacked(fx.labelled_samples(spark, sf_dir), keys=()), keys=("model",))
    return round_doubles(ev.class_metrics(ev.class_state(conf, keys=("model",)), keys=("model",)))


_F1_SQL = f"""WITH {LAB},
stacked AS (SELECT 'pred_a' AS model, label, pred_a AS prediction FROM lab
            UNION ALL SELECT 'pred_b' AS model, label, pred_b AS prediction FROM lab),
conf AS (SELECT model, label, prediction, count(*) AS n FROM stacked GROUP BY ALL),
cls AS (SELECT model, c AS class, sum(CASE WHEN label = c THEN n ELSE 0 END) AS support,
               sum(CASE WHEN prediction = c THEN n ELSE 0 END) AS predicted,
               sum(CASE WHEN label = c AND prediction = c THEN n ELSE 0 END) AS tp
        FROM conf, (SELECT DISTINCT label AS c FROM conf UNION SELECT DISTINCT prediction FROM conf) GROUP BY ALL),
pr AS (SELECT *, {sqlgen.zero_div_sql("tp", "predicted")} AS p, {sqlgen.zero_div_sql("tp", "support")} AS r FROM cls)"""


@register("e8_f1_scorers", _F1_SQL + f"""
SELECT model, round(avg({sqlgen.zero_div_sql("2 * p * r", "p + r")}), 9) AS f1_macro,
       round({sqlgen.zero_div_sql("sum(tp)", "sum(support)")}, 9) AS f1_micro
FROM pr GROUP BY model""")
def e8_f1_scorers(spark, sf_dir):
    conf = ev.confusion_counts(_stacked(fx.labelled_samples(spark, sf_dir), keys=()), keys=("model",))
    return round_doubles(ev.f1_scores(conf, keys=("model",)))


_REPORT_SQL = f""",
per AS (SELECT model, class, p AS precision, r AS recall, {sqlgen.zero_div_sql("2 * p * r", "p + r")} AS f1,
               CAST(support AS BIGINT) AS support, tp FROM pr)
SELECT model, "row", round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
  SELECT model, CAST(class AS VARCHAR) AS "row", precision, recall, f1, support FROM per
  UNION ALL SELECT model, 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM per GROUP BY model
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per GROUP BY model
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per GROUP BY model)"""


@register("e9_classification_report", _F1_SQL + _REPORT_SQL)
def e9_classification_report(spark, sf_dir):
    conf = ev.confusion_counts(_stacked(fx.labelled_samples(spark, sf_dir), keys=()), keys=("model",))
    return round_doubles(ev.classification_report(conf, keys=("model",)))


_TEN_SQL = f"""WITH lab AS ({fx.EMBEDDING_PREDICTIONS_SQL}),
conf AS (SELECT 'rule' AS model, label, prediction, count(*) AS n FROM lab GROUP BY ALL)""" + _F1_SQL[_F1_SQL.index(",\ncls AS"):]


@register("e9_report_ten_classes", _TEN_SQL + _REPORT_SQL)
def e9_report_ten_classes(spark, sf_dir):
    """The report takes its classes from the counts: ten of them in ``embeddings``."""
    conf = ev.confusion_counts(fx.embedding_predictions(spark, sf_dir).withColumn("model", F.lit("rule")), keys=("model",))
    return round_doubles(ev.classification_report(conf, keys=("model",)))


# ---- S3, P2-P7, J1, U1, M8: sources, roles, labelling ----------------------------------------------------------


SAMPLES = f"samples AS ({fx.SAMPLES_SQL})"
SAMPLES_NP = f"samples AS (SELECT * EXCLUDE (part) FROM ({fx.SAMPLES_SQL}))"
_IS_F = "label_af + label_nf + label_rf = 1"


@register("s3_union_users", f"""WITH {SAMPLES}
SELECT * EXCLUDE (acc_price) FROM samples WHERE {_IS_F}
UNION ALL BY NAME
SELECT * EXCLUDE (gyro_tax) FROM samples WHERE NOT ({_IS_F})""")
def s3_union_users(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    is_f = (F.col("label_af") + F.col("label_nf") + F.col("label_rf")) == 1
    return lb.union_users([s.filter(is_f).drop("acc_price"), s.filter(~is_f).drop("gyro_tax")])


@register("s1_read_user_csvs", f"""WITH samples AS ({fx.SAMPLES_SQL})
SELECT uuid, "timestamp", CASE WHEN part % 5 < 2 THEN NULL ELSE acc_quantity END AS acc_quantity,
       CASE WHEN CAST(uuid AS INTEGER) % 2 = 0 THEN acc_price END AS acc_price,
       CASE WHEN CAST(uuid AS INTEGER) % 2 = 1 THEN gyro_tax END AS gyro_tax,
       label_af, 'by,' || CASE WHEN CAST(uuid AS INTEGER) % 2 = 0 AND part % 3 = 1 THEN chr(10) || '"' ELSE ' ' END || CAST(part % 3 AS VARCHAR) AS label_source, CAST(CASE WHEN part % 5 = 2 THEN 1 ELSE 0 END AS INTEGER) AS bad_cells,
       CASE WHEN part % 5 = 2 THEN NULL ELSE gyro_discount END AS gyro_discount
FROM samples""")
def s1_read_user_csvs(spark, sf_dir):
    """One CSV file per user, named after it, with two headers (column set and order), ``nan``, empty, quoted and
    unreadable cells, in every other user's file also cells with quotes and line breaks, written from ``lineitem`` under the shared folder and read back."""
    from ctxspark.sources.sensor_csv import read_user_csvs, write_user_csvs

    base = shared_dir(spark, "user-csv")
    s = fx.samples(spark, sf_dir)
    even = F.col("uuid").cast("int") % 2 == 0
    text = F.when(F.col("part") % 5 == 0, "nan").when(F.col("part") % 5 == 1, "").otherwise(F.col("acc_quantity").cast("string"))
    bad = F.when(F.col("part") % 5 == 2, "broken").otherwise(F.col("gyro_discount").cast("string"))
    s = s.select("uuid", "timestamp", text.alias("acc_quantity"), "acc_price", "gyro_tax", "label_af",
                 F.concat(F.lit("by,"), F.when(even & (F.col("part") % 3 == 1), '\n"').otherwise(" "),
                          (F.col("part") % 3).cast("string")).alias("label_source"), bad.alias("gyro_discount"))
    write_user_csvs(s.filter(even).drop("gyro_tax"), f"{base}/a")
    write_user_csvs(s.filter(~even).drop("acc_price").select("uuid", "label_source", "label_af", "gyro_discount", "gyro_tax",
                                                            "acc_quantity", "timestamp"), f"{base}/b")
    return read_user_csvs(spark, [f"{base}/a", f"{base}/b"], bad_cells=True)


@register("p2_features_frame", f"""WITH {SAMPLES_NP}
SELECT uuid, "timestamp", {", ".join(fx.SAMPLE_FEATURES)} FROM samples""")
def p2_features_frame(spark, sf_dir):
    return lb.split_roles(fx.samples(spark, sf_dir, with_part=False), fx.SAMPLE_LABELS)[0]


@register("p3_labels_frame", f"""WITH {SAMPLES_NP}
SELECT uuid, "timestamp", {", ".join(fx.SAMPLE_LABELS)} FROM samples""")
def p3_labels_frame(spark, sf_dir):
    return lb.split_roles(fx.samples(spark, sf_dir, with_part=False), fx.SAMPLE_LABELS)[1]


_JOINED_SQL = f"""{SAMPLES_NP},
f AS (SELECT uuid, "timestamp", {", ".join(fx.SAMPLE_FEATURES)} FROM samples),
l AS (SELECT uuid, "timestamp", {", ".join(fx.SAMPLE_LABELS)} FROM samples),
j AS (SELECT * FROM f LEFT JOIN l USING (uuid, "timestamp"))"""


@register("j1_join_labels", f"""WITH {_JOINED_SQL}
SELECT * FROM j""")
def j1_join_labels(spark, sf_dir):
    f, l = lb.split_roles(fx.samples(spark, sf_dir, with_part=False), fx.SAMPLE_LABELS)
    return lb.join_labels(f, l)


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in fx.SAMPLE_LABELS) + "]"


@register("p5_labelled_dataset", f"""WITH {_JOINED_SQL}
SELECT * EXCLUDE (l, {", ".join(fx.SAMPLE_LABELS)}), {fx.ARGMAX_SQL} AS label,
       {_NAMES_SQL}[{fx.ARGMAX_SQL} + 1] AS label_name
FROM (SELECT *, {fx.LABEL_LIST_SQL} AS l FROM j)""")
def p5_labelled_dataset(spark, sf_dir):
    return lb.merged_dataset(fx.samples(spark, sf_dir, with_part=False), fx.SAMPLE_LABELS)


@register("u1_train_test_union", f"""WITH {LAB}
SELECT * FROM lab""")
def u1_train_test_union(spark, sf_dir):
    lab = fx.labelled_samples(spark, sf_dir)
    mem = fx.members(spark, sf_dir)
    train = fo.fold_rows(lab, mem, fold=0, split="train").drop("fold", "split")
    test = fo.fold_rows(lab, mem, fold=0, split="test").drop("fold", "split")
    return train.unionByName(test)


@register("m8_epoch_strings", f"""WITH {SAMPLES}
SELECT uuid, "timestamp", strftime(make_timestamp(CAST("timestamp" AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS date
FROM samples""")
def m8_epoch_strings(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    return s.select("uuid", "timestamp", epoch_to_utc_string(F.col("timestamp")).alias("date"))


# ---- J2, J3, W1, L12-L14: folds and groups ----------------------------------------------------------------------


@register("j2_fold_rows", f"""WITH {LAB}, {MEM}
SELECT l.*, m.fold, m.split FROM lab l JOIN mem m USING (uuid)""")
def j2_fold_rows(spark, sf_dir):
    return fo.fold_rows(fx.labelled_samples(spark, sf_dir), fx.members(spark, sf_dir))


@register("j3_attach_groups", f"""WITH {SAMPLES}, gm AS ({fx.GROUP_MAP_SQL})
SELECT s.uuid, s."timestamp", g."group" FROM samples s LEFT JOIN gm g USING (uuid)""")
def j3_attach_groups(spark, sf_dir):
    s = fx.samples(spark, sf_dir).select("uuid", "timestamp")
    return fo.attach_groups(s, fx.group_map(spark, sf_dir))


@register("w1_uuid_codes", f"""WITH {SAMPLES}
SELECT uuid, CAST(row_number() OVER (ORDER BY uuid) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT uuid FROM samples)""")
def w1_uuid_codes(spark, sf_dir):
    return fo.uuid_codes(fx.samples(spark, sf_dir))


@register("l14_row_groups", f"""WITH {SAMPLES},
codes AS (SELECT uuid, CAST(row_number() OVER (ORDER BY uuid) - 1 AS INTEGER) AS "group" FROM (SELECT DISTINCT uuid FROM samples))
SELECT s.uuid, s."timestamp", c."group" FROM samples s JOIN codes c USING (uuid)""")
def l14_row_groups(spark, sf_dir):
    return fo.attach_uuid_codes(fx.samples(spark, sf_dir).select("uuid", "timestamp"))


@register("w1_order_codes", """
SELECT CAST(l_orderkey AS VARCHAR) AS uuid, CAST(row_number() OVER (ORDER BY CAST(l_orderkey AS VARCHAR)) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def w1_order_codes(spark, sf_dir):
    """Dense codes of many keys: one per order."""
    return fo.uuid_codes(fx.read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("uuid")))


@register("l12_group_kfold", f"""WITH RECURSIVE {LAB}, gm AS ({fx.GROUP_MAP_SQL}),
sizes AS (SELECT g."group", count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, g."group" ASC NULLS LAST) AS i
          FROM lab l LEFT JOIN gm g USING (uuid) GROUP BY g."group"),
greedy AS (
  SELECT 0 AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS grp, NULL::INTEGER AS fold, NULL::BIGINT AS n
  UNION ALL
  SELECT s.i,
         list_transform(range(5), lambda k: CASE WHEN k = list_position(g.loads, list_min(g.loads)) - 1
                                            THEN g.loads[k + 1] + s.n ELSE g.loads[k + 1] END),
         s."group", CAST(list_position(g.loads, list_min(g.loads)) - 1 AS INTEGER), s.n
  FROM greedy g JOIN sizes s ON s.i = g.i + 1)
SELECT grp AS "group", fold AS cv_fold, n FROM greedy WHERE i > 0""")
def l12_group_kfold(spark, sf_dir):
    """Group k-fold (5 splits) over the configured user groups; unlisted users form one null group."""
    rows = fo.attach_groups(fx.labelled_samples(spark, sf_dir), fx.group_map(spark, sf_dir))
    tagged = fo.group_kfold(rows, "group", n_splits=5)
    return tagged.groupBy("group", "cv_fold").agg(F.count(F.lit(1)).alias("n"))


@register("l13_stratified_fold_sizes", f"""WITH {LAB}
SELECT label, cv_fold, count(*) AS n
FROM (SELECT label, CAST((row_number() OVER (ORDER BY label) - 1) % 3 AS INTEGER) AS cv_fold FROM lab)
GROUP BY ALL""")
def l13_stratified_fold_sizes(spark, sf_dir):
    tagged = fo.stratified_kfold(fx.labelled_samples(spark, sf_dir), "label", k=3, seed=7)
    return tagged.groupBy("label", "cv_fold").agg(F.count(F.lit(1)).alias("n"))


# ---- A1, A3, M1-M5, P8, C5: statistics, preparation, selection --------------------------------------------------


FEATS = list(fx.SAMPLE_FEATURES)
DISC, NUM = split_discrete_numeric(FEATS)
_UNPIVOT = f"(UNPIVOT (SELECT {', '.join(FEATS)} FROM samples) ON {', '.join(FEATS)} INTO NAME feature VALUE value)"
_STATS_SQL = f"""SELECT feature, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std,
       CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
FROM {_UNPIVOT} GROUP BY feature"""
_MODES_SQL = f"""SELECT feature, value AS mode, n AS count FROM (
  SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC) AS rk
  FROM (SELECT feature, value, count(*) AS n FROM {_UNPIVOT} GROUP BY ALL)) WHERE rk = 1"""


@register("a1_column_stats", f"""WITH {SAMPLES_NP}
SELECT feature, n, round(mean, 9) AS mean, round(std, 9) AS std, round(scale, 9) AS scale FROM ({_STATS_SQL})""")
def a1_column_stats(spark, sf_dir):
    return round_doubles(stx.column_stats(fx.samples(spark, sf_dir, with_part=False), FEATS))


@register("a3_column_modes", f"""WITH {SAMPLES_NP}
{_MODES_SQL}""")
def a3_column_modes(spark, sf_dir):
    return stx.column_modes(fx.samples(spark, sf_dir, with_part=False), FEATS)


def _labelled_join(spark, sf_dir):
    """The merged dataset (features joined with labels, argmax label) without the label name."""
    return lb.merged_dataset(fx.samples(spark, sf_dir, with_part=False), fx.SAMPLE_LABELS, strategy="repeated").drop("label_name")


def _stored_rows(spark, sf_dir):
    """:func:`_labelled_join` written once: the join runs once, whatever reads the rows."""
    path = shared_dir(spark, "labelled-rows")
    _labelled_join(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


_MERGED = f"""{_JOINED_SQL},
merged AS MATERIALIZED (SELECT * EXCLUDE (l, {", ".join(fx.SAMPLE_LABELS)}), {fx.ARGMAX_SQL} AS label
           FROM (SELECT *, {fx.LABEL_LIST_SQL} AS l FROM j))"""
_MOMENTS_SQL = f"""
mstats AS (SELECT feature, avg(value) AS mean FROM (UNPIVOT (SELECT {', '.join(FEATS)} FROM merged) ON {', '.join(FEATS)}
           INTO NAME feature VALUE value) GROUP BY feature),
mmodes AS (SELECT feature, value AS mode FROM (
  SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC) AS rk
  FROM (SELECT feature, value, count(*) AS n FROM (UNPIVOT (SELECT {', '.join(DISC)} FROM merged) ON {', '.join(DISC)}
        INTO NAME feature VALUE value) GROUP BY ALL)) WHERE rk = 1),
fills AS MATERIALIZED (SELECT {", ".join(f"max(CASE WHEN s.feature = '{c}' THEN coalesce(m.mode, s.mean) END) AS f_{c}" for c in FEATS)}
          FROM mstats s LEFT JOIN mmodes m USING (feature)),
filled AS MATERIALIZED (SELECT uuid, "timestamp", label, {", ".join(f"coalesce({c}, f_{c}) AS {c}" for c in FEATS)} FROM merged, fills),
grp AS MATERIALIZED (SELECT feature, label, count(*) AS nk, avg(value) AS mk, var_pop(value) * count(*) AS ssk
        FROM (UNPIVOT (SELECT label, {', '.join(FEATS)} FROM filled) ON {', '.join(FEATS)} INTO NAME feature VALUE value) GROUP BY ALL),
g2 AS (SELECT *, sum(nk * mk) OVER (PARTITION BY feature) / sum(nk) OVER (PARTITION BY feature) AS grand FROM grp),
fs AS (SELECT feature, (sum(nk * (mk - grand) ^ 2) / (count(*) - 1)) / (sum(ssk) / (sum(nk) - count(*))) AS f_score
       FROM g2 GROUP BY feature),
pos AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(FEATS))}) t(feature, position))"""


@register("m1_anova_selection", f"""WITH {_MERGED}, {_MOMENTS_SQL},
ranked AS (SELECT p.feature, CAST(p.position AS INTEGER) AS position, f.f_score,
                  quantile_cont(f.f_score, 0.6) OVER () AS thr,
                  count(*) OVER () AS nf FROM pos p JOIN fs f USING (feature)),
tied AS (SELECT *, sum(CASE WHEN f_score > thr THEN 1 ELSE 0 END) OVER () AS above,
                row_number() OVER (PARTITION BY f_score = thr ORDER BY position) AS tie_rank FROM ranked)
SELECT feature, position, round(f_score, 6) AS f_score,
       (f_score > thr OR (f_score = thr AND tie_rank <= floor(nf * 40 / 100) - above)) AS selected
FROM tied""")
def m1_anova_selection(spark, sf_dir):
    s = sel.select_features(_stored_rows(spark, sf_dir), FEATS, percentile=40)
    return s.withColumn("f_score", F.round("f_score", 6))


def _numbered(df: DataFrame, keep, keys) -> DataFrame:
    """The wide selected table with its columns by number, whichever features were selected: name_i, value_i."""
    named = [x for i, c in enumerate(sorted(keep), 1) for x in (F.lit(c).alias(f"name_{i}"), q(c).cast("double").alias(f"value_{i}"))]
    return df.select(*keys, *named)


_CHOSEN_SQL = """
ranked AS (SELECT p.feature, p.position, f.f_score, quantile_cont(f.f_score, 0.6) OVER () AS thr,
                  count(*) OVER () AS nf
           FROM pos p JOIN fs f USING (feature)),
tied AS (SELECT *, sum(CASE WHEN f_score > thr THEN 1 ELSE 0 END) OVER () AS above,
                row_number() OVER (PARTITION BY f_score = thr ORDER BY position) AS tie_rank FROM ranked),
chosen AS (SELECT feature FROM tied WHERE f_score > thr OR (f_score = thr AND tie_rank <= floor(nf * 40 / 100) - above))"""
# two of the six features are chosen
_PICKED_SQL = ", ".join(f"(SELECT {f}(feature) FROM chosen) AS name_{i}, CASE (SELECT {f}(feature) FROM chosen) "
                        + " ".join(f"WHEN '{c}' THEN {c}" for c in FEATS) + f" END AS value_{i}" for i, f in ((1, "min"), (2, "max")))


@register("p8_selected_dataset", f"""WITH {_MERGED}, {_MOMENTS_SQL}, {_CHOSEN_SQL}
SELECT uuid, label, {_PICKED_SQL} FROM merged""")
def p8_selected_dataset(spark, sf_dir):
    """The saved dataset: uuid, the selected raw features (unfilled) in column order, label."""
    data = _stored_rows(spark, sf_dir)
    keep = sel.selected_names(sel.select_features(data, FEATS, percentile=40))
    return _numbered(data.select("uuid", *[q(c) for c in sorted(keep)], "label"), keep, ["uuid", "label"])


@register("p8_selected_long", f"""WITH {_MERGED}, {_MOMENTS_SQL}, {_CHOSEN_SQL}
SELECT uuid, "timestamp", label, feature, value
FROM (SELECT uuid, "timestamp", label, {", ".join(FEATS)} FROM merged)
     UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(FEATS)}))
WHERE feature IN (SELECT feature FROM chosen)""")
def p8_selected_long(spark, sf_dir):
    """The selected dataset in long form (uuid, timestamp, label, feature, value): selection mask + projection."""
    data = _stored_rows(spark, sf_dir)
    keep = sel.selected_names(sel.select_features(data, FEATS, percentile=40))
    return stx.long_values(data, keep, keep=["uuid", "timestamp", "label"], drop_nulls=False)


@register("m2_selection_fill", f"""WITH {_MERGED}, {_MOMENTS_SQL}
SELECT uuid, "timestamp", label, {", ".join(f'round({c}, 6) AS {c}' for c in FEATS)} FROM filled""")
def m2_selection_fill(spark, sf_dir):
    return round_doubles(sel.selection_fill(_stored_rows(spark, sf_dir), FEATS).select("uuid", "timestamp", "label", *FEATS), 6)


_SCALE_SQL = ", ".join(
    f"round(({c} - (SELECT mean FROM st WHERE feature = '{c}')) / (SELECT scale FROM st WHERE feature = '{c}'), 6) AS {c}"
    for c in NUM)


@register("m3_scaled_features", f"""WITH {SAMPLES_NP}, st AS ({_STATS_SQL})
SELECT uuid, "timestamp", {_SCALE_SQL} FROM samples""")
def m3_scaled_features(spark, sf_dir):
    s = fx.samples(spark, sf_dir, with_part=False)
    st = {r["feature"]: r.asDict() for r in stx.column_stats(s, NUM).collect()}
    return round_doubles(pp.scale_columns(s, st, NUM).select("uuid", "timestamp", *NUM), 6)


@register("m4_scaled_filled", f"""WITH {SAMPLES_NP}, st AS ({_STATS_SQL})
SELECT uuid, "timestamp", {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in NUM)} FROM (SELECT uuid, "timestamp", {_SCALE_SQL} FROM samples)""")
def m4_scaled_filled(spark, sf_dir):
    s = fx.samples(spark, sf_dir, with_part=False)
    st = {r["feature"]: r.asDict() for r in stx.column_stats(s, NUM).collect()}
    return round_doubles(pp.fill_zero(pp.scale_columns(s, st, NUM), NUM).select("uuid", "timestamp", *NUM), 6)


@register("m5_mixed_prep", f"""WITH {SAMPLES_NP}, st AS ({_STATS_SQL}), md AS ({_MODES_SQL})
SELECT uuid, "timestamp",
  {", ".join(f"coalesce({c}, (SELECT mode FROM md WHERE feature = '{c}')) AS p_{c}" for c in DISC)},
  {", ".join(f"round((coalesce({c}, (SELECT mode FROM md WHERE feature = '{c}')) - (SELECT mean FROM st WHERE feature = '{c}')) / (SELECT scale FROM st WHERE feature = '{c}'), 6) AS p_{c}" for c in NUM)}
FROM samples""")
def m5_mixed_prep(spark, sf_dir):
    s = fx.samples(spark, sf_dir, with_part=False)
    model = pp.MixedPrep(inputCols=FEATS).fit(s)
    out = model.transform(s)
    arr = vector_to_array(F.col("features"))
    names = model.feature_order()
    return round_doubles(out.select("uuid", "timestamp", *[arr[i].alias(f"p_{c}") for i, c in enumerate(names)]), 6)


_OTHER_LIST = (("fill", tf.Impute("mean"), tf.Kind.NUMERIC), ("unit", tf.MinMaxScale(), tf.Kind.NUMERIC),
               ("missing", tf.Impute("constant", -1.0), tf.Kind.DISCRETE), ("scaler", tf.StandardScale(), tf.Kind.DISCRETE))


@register("m7_transformer_lists", f"""WITH {SAMPLES_NP}, st AS ({_STATS_SQL}), md AS ({_MODES_SQL})
SELECT uuid, "timestamp",
  {", ".join(f"coalesce({c}, (SELECT mode FROM md WHERE feature = '{c}')) AS a_{c}" for c in DISC)},
  {", ".join(f"round((coalesce({c}, (SELECT mode FROM md WHERE feature = '{c}')) - (SELECT mean FROM st WHERE feature = '{c}')) / (SELECT scale FROM st WHERE feature = '{c}'), 6) AS a_{c}" for c in NUM)},
  {", ".join(f"round((coalesce({c}, -1.0) - avg(coalesce({c}, -1.0)) OVER ()) / stddev_pop(coalesce({c}, -1.0)) OVER (), 6) AS b_{c}" for c in DISC)},
  {", ".join(f"round((coalesce({c}, avg({c}) OVER ()) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS b_{c}" for c in NUM)}
FROM samples""")
def m7_transformer_lists(spark, sf_dir):
    """Two lists of transformers fitted on the same rows: the default one (a) and one of other kinds in another order (b)."""
    s = fx.samples(spark, sf_dir, with_part=False)
    cols = []
    for prefix, transformers in (("a", tf.DEFAULT), ("b", _OTHER_LIST)):
        model = tf.ColumnTransformers(inputCols=FEATS, transformers=tf.to_json(transformers)).fit(s)
        cols += [x.alias(f"{prefix}_{c}") for c, x in model.prepared_columns().items()]
    return round_doubles(s.select("uuid", "timestamp", *cols), 6)


@register("c5_all_data_prep", f"""WITH {LAB}, st AS (SELECT feature, avg(value) AS mean,
       CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
       FROM (UNPIVOT (SELECT {', '.join(NUM)} FROM lab) ON {', '.join(NUM)} INTO NAME feature VALUE value) GROUP BY feature)
SELECT uuid, "timestamp", label,
  {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in DISC)},
  {", ".join(f"round(coalesce(({c} - (SELECT mean FROM st WHERE feature = '{c}')) / (SELECT scale FROM st WHERE feature = '{c}'), 0.0), 6) AS {c}" for c in NUM)}
FROM lab""")
def c5_all_data_prep(spark, sf_dir):
    lab = fx.labelled_samples(spark, sf_dir)
    mem = fx.members(spark, sf_dir)
    both = (fo.fold_rows(lab, mem, fold=0, split="train").unionByName(fo.fold_rows(lab, mem, fold=0, split="test"))
            .drop("fold", "split"))
    return round_doubles(pp.scale_and_fill_all(both, FEATS).select("uuid", "timestamp", "label", *FEATS), 6)


# ---- A5, A10, A11, C1-C4, P12-P14: comparing two models ---------------------------------------------------------


@register("c1_disagreement_rows", f"""WITH {LAB}
SELECT * FROM lab WHERE pred_a <> pred_b""")
def c1_disagreement_rows(spark, sf_dir):
    return cmp.disagreements(fx.labelled_samples(spark, sf_dir), "pred_a", "pred_b")


@register("c2_disagreement_histogram", f"""WITH {LAB},
d AS (SELECT * FROM lab WHERE pred_a <> pred_b),
s AS (SELECT 'label' AS which, label AS v FROM d UNION ALL SELECT 'pred_a', pred_a FROM d UNION ALL SELECT 'pred_b', pred_b FROM d)
SELECT CAST(r.range AS INTEGER) AS label,
       CAST(count(*) FILTER (WHERE which = 'label') AS BIGINT) AS label_n,
       CAST(count(*) FILTER (WHERE which = 'pred_a') AS BIGINT) AS pred_a,
       CAST(count(*) FILTER (WHERE which = 'pred_b') AS BIGINT) AS pred_b
FROM range(6) r LEFT JOIN s ON s.v = r.range GROUP BY r.range""")
def c2_disagreement_histogram(spark, sf_dir):
    h = cmp.disagreement_histogram(fx.labelled_samples(spark, sf_dir), "label", "pred_a", "pred_b", 6)
    return h.toDF("label", "label_n", "pred_a", "pred_b")


@register("p14_correctness_flags", f"""WITH {LAB}
SELECT *, CAST(pred_a = label AS INTEGER) AS pred_a_correct, CAST(pred_b = label AS INTEGER) AS pred_b_correct FROM lab""")
def p14_correctness_flags(spark, sf_dir):
    return cmp.correctness_flags(fx.labelled_samples(spark, sf_dir), "label", ["pred_a", "pred_b"])


_CELLS_SQL = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(correct_a, correct_b)"


@register("c3_agreement_matrix", f"""WITH {LAB},
f AS (SELECT CAST(pred_a = label AS INTEGER) AS correct_a, CAST(pred_b = label AS INTEGER) AS correct_b FROM lab),
n AS (SELECT correct_a, correct_b, count(*) AS n FROM f GROUP BY ALL)
SELECT CAST(c.correct_a AS INTEGER) AS correct_a, CAST(c.correct_b AS INTEGER) AS correct_b, CAST(coalesce(n.n, 0) AS BIGINT) AS n,
       round(coalesce(n.n, 0) / sum(coalesce(n.n, 0)) OVER (), 9) AS share
FROM {_CELLS_SQL} LEFT JOIN n USING (correct_a, correct_b)""")
def c3_agreement_matrix(spark, sf_dir):
    return round_doubles(cmp.agreement_matrix(fx.labelled_samples(spark, sf_dir), "label", "pred_a", "pred_b"))


@register("c4_agreement_by_class", f"""WITH {LAB},
f AS (SELECT label, CAST(pred_a = label AS INTEGER) AS correct_a, CAST(pred_b = label AS INTEGER) AS correct_b FROM lab),
n AS (SELECT label, correct_a, correct_b, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT DISTINCT label FROM f)
SELECT g.label, CAST(c.correct_a AS INTEGER) AS correct_a, CAST(c.correct_b AS INTEGER) AS correct_b,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n,
       round(coalesce(n.n, 0) / sum(coalesce(n.n, 0)) OVER (PARTITION BY g.label), 9) AS share
FROM g CROSS JOIN {_CELLS_SQL} LEFT JOIN n ON n.label = g.label AND n.correct_a = c.correct_a AND n.correct_b = c.correct_b""")
def c4_agreement_by_class(spark, sf_dir):
    return round_doubles(cmp.agreement_matrix(fx.labelled_samples(spark, sf_dir), "label", "pred_a", "pred_b",
                                              by_class=True))


# ---- L3-L16, E1, C6: models (checked by what SQL can state of them) ---------------------------------------------


@register("l6_balanced_weights", f"""WITH {LAB}, {MEM},
tr AS (SELECT l.* FROM lab l JOIN mem m ON l.uuid = m.uuid AND m.fold = 0 AND m.split = 'train'),
c AS (SELECT label, count(*) AS n FROM tr GROUP BY label)
SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM c""")
def l6_balanced_weights(spark, sf_dir):
    train = fo.fold_rows(fx.labelled_samples(spark, sf_dir), fx.members(spark, sf_dir), fold=0, split="train")
    counts = md.class_counts(train)
    tab = spark.createDataFrame(sorted(counts.items()), "label int, n long")
    return round_doubles(tab.withColumn("weight", md.balanced_weight(counts, F.col("label"))))


def _fold0(spark, sf_dir):
    lab, mem = _stored_rows(spark, sf_dir), fo.stored_members(fx.members(spark, sf_dir))
    return (fo.fold_rows(lab, mem, fold=0, split="train").drop("fold", "split"),
            fo.fold_rows(lab, mem, fold=0, split="test", validate=False))


RF_CONFIG = {"estimator": "random-forest", "n_estimators": 50, "criterion": "entropy", "max_depth": 10,
             "class_weight": "balanced", "min_samples_split": 0.1}
_FOLD_ROWS = f"{_MERGED}, {MEM}, t AS (SELECT m.fold, m.split, r.* FROM merged r JOIN mem m USING (uuid))"


def class_totals(predictions: DataFrame, keys=("fold",)) -> DataFrame:
    """(keys, class, support, tp + fn): what every model must give alike."""
    state = ev.class_state(ev.confusion_counts(predictions, keys=keys), keys=keys)
    return state.select(*keys, "class", "support", (F.col("tp") + F.col("fn")).alias("tp_fn"))


@register("l9_train_lr_per_fold", f"""WITH {_FOLD_ROWS}
SELECT fold, CAST(label AS INTEGER) AS class, count(*) AS support, count(*) AS tp_fn FROM t WHERE split = 'test' GROUP BY ALL""")
def l9_train_lr_per_fold(spark, sf_dir):
    """Reference default run: 40 % ANOVA selection, 5 folds, balanced LR (C = 1e-4); rows scored per fold and class."""
    raw = fx.samples(spark, sf_dir, with_part=False)
    cfg = flows.RunConfig(activity_labels=fx.SAMPLE_LABELS)
    return class_totals(flows.run(raw, fx.members(spark, sf_dir), cfg)["predictions"])


def largest_gradient(prepared: DataFrame, coefficients, intercepts, classes, c: float, weight) -> float:
    """Largest absolute gradient entry of the stated objective (1/2 |W|^2 + C sum of weighted log losses) per unit of
    C and row, over all rows: one aggregation of the F + 1 sums per class."""
    x = vector_to_array("features")
    margins = [sum((F.lit(float(w)) * x[j] for j, w in enumerate(row)), F.lit(float(b))) for row, b in zip(coefficients, intercepts)]
    top = F.greatest(*margins) if len(margins) > 1 else F.greatest(margins[0], F.lit(0.0))
    rows = prepared.select("label", x.alias("x"), F.array(*margins).alias("m"), top.alias("top"))
    e = [F.exp(F.col("m")[k] - F.col("top")) for k in range(len(margins))]
    total = sum(e[1:], e[0]) if len(e) > 1 else e[0] + F.exp(-F.col("top"))
    rows = rows.select("x", *[(weight(cls) * (e[k] / total - (F.col("label") == cls).cast("double"))).alias(f"d{k}")
                              for k, cls in enumerate(classes)])
    width = len(coefficients[0])
    sums = [F.sum(F.col(f"d{k}") * F.col("x")[j]).alias(f"g{k}_{j}") for k in range(len(classes)) for j in range(width)]
    sums += [F.sum(f"d{k}").alias(f"g{k}_b") for k in range(len(classes))]
    row = rows.agg(*sums, F.count(F.lit(1)).alias("n")).first()
    return max(abs((float(coefficients[k][j]) if j != "b" else 0.0) / c + row[f"g{k}_{j}"]) / row["n"]
               for k in range(len(classes)) for j in [*range(width), "b"])


def _multinomial_gradient(model, rows: DataFrame, c: float) -> float:
    lr, weight = model.stages[1], md.balanced_weight(md.class_counts(rows), F.col("label"))
    return largest_gradient(model.stages[0].transform(rows).select("features", "label"), lr.coefficientMatrix.toArray(),
                            lr.interceptVector.toArray(), range(len(lr.interceptVector)), c, lambda _: weight)


#: A fit counts as at its minimum when no gradient entry per row exceeds this.
GRADIENT = 1e-4


@register("l16_lr_predictions", f"""WITH {_FOLD_ROWS}
SELECT split, count(*) AS scored, CASE WHEN split = 'train' THEN TRUE END AS at_minimum FROM t WHERE fold = 0 GROUP BY split""")
def l16_lr_predictions(spark, sf_dir):
    """Fold 0 with the default LR: its objective's gradient over all training rows is below the bound, and every row of
    either split gets a prediction."""
    train, test = _fold0(spark, sf_dir)
    model = md.early_fusion(FEATS, flows.DEFAULT_MODEL).fit(train)
    worst = _multinomial_gradient(model, train, flows.DEFAULT_MODEL["C"])
    both = train.withColumn("split", F.lit("train")).unionByName(test.drop("fold"))
    return (md.predict(model, both).groupBy("split").agg(F.count("prediction").alias("scored"))
            .withColumn("at_minimum", F.when(F.col("split") == "train", F.lit(worst < GRADIENT))))


@register("l4_ovr_lr_results", f"""WITH {_FOLD_ROWS}
SELECT CAST(label AS INTEGER) AS class, count(*) AS support, TRUE AS at_minimum FROM t WHERE fold = 0 AND split = 'train' GROUP BY label""")
def l4_ovr_lr_results(spark, sf_dir):
    """One-vs-rest on fold 0: each class's binary problem, its training support and whether its gradient vanishes."""
    train, _ = _fold0(spark, sf_dir)
    config = {"estimator": "logistic-regression", "C": 1, "max_iter": 1000, "class_weight": "balanced", "multi_class": "ovr",
              "tol": 1e-9}
    model = md.early_fusion(FEATS, config).fit(train)
    counts = md.class_counts(train)
    rows = model.stages[0].transform(train).select("features", "label")
    done = []
    for cls, lr in zip(model.stages[-1].getOrDefault("classes"), model.stages[1:-1]):
        binary = rows.withColumn("label", (F.col("label") == cls).cast("int"))
        weight = md.balanced_weight({1: counts[cls], 0: sum(counts.values()) - counts[cls]}, F.col("label"))
        worst = largest_gradient(binary, [lr.coefficients.toArray()], [lr.intercept], [1], 1.0, lambda _: weight)
        done.append((cls, worst < GRADIENT))
    support = train.groupBy(F.col("label").cast("int").alias("class")).agg(F.count(F.lit(1)).alias("support"))
    return support.join(spark.createDataFrame(done, "class int, at_minimum boolean"), "class")


@register("l5_random_forest_results", """
SELECT CAST(label AS INTEGER) AS label, count(*) AS n, TRUE AS beats_majority FROM embeddings GROUP BY label""")
def l5_random_forest_results(spark, sf_dir):
    """Balanced random forest on the embeddings: more rows right than the majority class has."""
    emb = fx.embedding_samples(spark, sf_dir)
    model = md.early_fusion([c for c in emb.columns if c.startswith("emb_")], RF_CONFIG | {"min_samples_split": 2}).fit(emb)
    per = md.predict(model, emb).groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                                      F.count(F.when(F.col("prediction") == F.col("label"), 1)).alias("hits"))
    everything = Window.partitionBy(F.lit(0))       # one row per class
    return per.select("label", "n", (F.sum("hits").over(everything) > F.max("n").over(everything)).alias("beats_majority"))


@register("e1_saved_model_state", f"""WITH {_FOLD_ROWS}
SELECT CAST(label AS INTEGER) AS class, count(*) AS support, count(*) AS tp_fn, CAST(0 AS BIGINT) AS changed
FROM t WHERE fold = 0 AND split = 'test' GROUP BY label""")
def e1_saved_model_state(spark, sf_dir):
    """Train fold 0, save, load back, score the test users with both: no prediction may differ."""
    train, test = _fold0(spark, sf_dir)
    model = md.early_fusion(FEATS, flows.DEFAULT_MODEL).fit(train)
    loaded = store.load_model(store.save_model(model, shared_dir(spark, "model")))
    scored = md.score_two(model, loaded, test, "kept", "again").withColumn("prediction", F.col("again"))
    changed = scored.groupBy(F.col("label").cast("int").alias("class")).agg(
        F.count(F.when(~F.col("kept").eqNullSafe(F.col("again")), 1)).alias("changed"))
    return class_totals(scored, keys=()).join(changed, "class")


def _product_sql(grid) -> str:
    """The grid as a SQL product, the last key varying fastest."""
    keys = list(grid)
    values = [", ".join(f"({i}, '{json.dumps(v)}')" for i, v in enumerate(grid[k])) for k in keys]
    parts = ", ".join(f"(VALUES {v}) t{n}(i, v)" for n, v in enumerate(values))
    text = " || ', ' || ".join(f"'\"{k}\": ' || t{n}.v" for n, k in enumerate(keys))
    order = ", ".join(f"t{n}.i" for n in range(len(keys)))
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS candidate, '{{' || {text} || '}}' AS params FROM {parts}"


def _scored_rows(results: DataFrame, keys: list) -> DataFrame:
    """(keys, candidate, params, n_scores, in_range): every split has a score from 0 to 1 and the mean is theirs."""
    splits = [c for c in results.columns if c.startswith("split") and c.endswith("_test_score")]
    scores = F.filter(F.array(*[q(c) for c in splits]), lambda x: x.isNotNull())
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    ok = F.forall(scores, lambda x: x.between(0, 1)) & (F.abs(mean - F.col("mean_test_score")) < 1e-9) & (F.col("mean_score_time") >= 0)
    return results.select(*keys, "candidate", "params", F.size(scores).alias("n_scores"), ok.alias("in_range"))


def _grid_over_folds(spark, sf_dir, cfg) -> DataFrame:
    """The grid's results on the training rows of every fold, from one stored table of the labelled rows."""
    lab, mem = _stored_rows(spark, sf_dir), fo.stored_members(fx.members(spark, sf_dir))
    fo.check_members(lab, mem)
    def one(k: int) -> DataFrame:
        train = fo.fold_rows(lab, mem, fold=k, split="train", validate=False).drop("fold", "split")
        res, _ = flows.learn_params(train, FEATS, cfg)
        return _scored_rows(res.withColumn("fold", F.lit(k)), ["fold"])

    with ThreadPoolExecutor(max_workers=fx.N_FOLDS) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(fx.N_FOLDS)))


@register("l11_grid_search_lr", f"""WITH g AS ({_product_sql(flows.LR_GRID)}), {MEM}
SELECT f.fold, candidate, params, 3 AS n_scores, TRUE AS in_range FROM g, (SELECT DISTINCT fold FROM mem) f""")
def l11_grid_search_lr(spark, sf_dir):
    """The LR grid (6 candidates, one-vs-rest, balanced) with 3 stratified splits on the training rows of every fold."""
    return _grid_over_folds(spark, sf_dir, flows.RunConfig(activity_labels=fx.SAMPLE_LABELS))


@register("l11_grid_search_rf", f"""WITH g AS ({_product_sql(flows.RF_GRID)}), {MEM}
SELECT f.fold, candidate, params, 3 AS n_scores, TRUE AS in_range FROM g, (SELECT DISTINCT fold FROM mem) f""")
def l11_grid_search_rf(spark, sf_dir):
    """The whole RF grid (80 candidates) with 3 stratified splits on the training rows of every fold."""
    return _grid_over_folds(spark, sf_dir, flows.RunConfig(activity_labels=fx.SAMPLE_LABELS, model_config=RF_CONFIG))


@register("l10_param_grid", _product_sql(flows.RF_GRID))
def l10_param_grid(spark, sf_dir):
    """The candidates of a grid as the results table numbers them, here scored by rule on ``lineitem``."""
    grid = tune.param_grid(flows.RF_GRID)
    scores = (fx.read_table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % len(grid)).cast("int").alias("candidate"))
              .agg(F.avg("l_discount").alias("score"), F.lit(0).alias("split"), F.lit(0.0).alias("fit_time"), F.lit(0.0).alias("score_time")))
    return tune.cv_table(scores, [0], grid).select("candidate", "params")


_CANDIDATES = [{"C": c} for c in (0.1, 1, 10, 100, 1000, 10000, 100000)]
_SCORES_SQL = """s AS (SELECT CAST(l_linenumber - 1 AS INTEGER) AS candidate, CAST(l_suppkey % 3 AS INTEGER) AS split,
                 round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 2) AS score FROM lineitem GROUP BY ALL),
m AS (SELECT candidate, avg(score) AS mean_test_score, stddev_pop(score) AS std_test_score,
             max(score) FILTER (WHERE split = 0) AS split0_test_score, max(score) FILTER (WHERE split = 1) AS split1_test_score,
             max(score) FILTER (WHERE split = 2) AS split2_test_score FROM s GROUP BY candidate),
r AS (SELECT *, CAST(rank() OVER (ORDER BY round(mean_test_score, 9) DESC) AS INTEGER) AS rank_test_score FROM m)"""


def _rule_scores(spark, sf_dir) -> DataFrame:
    """A score per (candidate, split) from ``lineitem``, in hundredths, so that candidates can tie."""
    return (fx.read_table(spark, sf_dir, "lineitem")
            .groupBy((F.col("l_linenumber") - 1).cast("int").alias("candidate"), (F.col("l_suppkey") % 3).cast("int").alias("split"))
            .agg(F.round(F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)), 2).alias("score"),
                 F.lit(1.0).alias("fit_time"), F.lit(0.5).alias("score_time")))


@register("l15_cv_results", f"""WITH {_SCORES_SQL}
SELECT candidate, round(split0_test_score, 9) AS split0_test_score, round(split1_test_score, 9) AS split1_test_score,
       round(split2_test_score, 9) AS split2_test_score, round(mean_test_score, 9) AS mean_test_score,
       round(std_test_score, 9) AS std_test_score, rank_test_score, CAST(1.0 AS DOUBLE) AS mean_fit_time, CAST(0.5 AS DOUBLE) AS mean_score_time FROM r""")
def l15_cv_results(spark, sf_dir):
    return round_doubles(tune.cv_table(_rule_scores(spark, sf_dir), [0, 1, 2], _CANDIDATES).drop("params"))


@register("w3_best_candidate", f"""WITH {_SCORES_SQL}
SELECT candidate, rank_test_score FROM r ORDER BY rank_test_score, candidate LIMIT 1""")
def w3_best_candidate(spark, sf_dir):
    """The first candidate of the best mean score (W2, W3)."""
    results = tune.cv_table(_rule_scores(spark, sf_dir), [0, 1, 2], _CANDIDATES)
    best = _CANDIDATES.index(tune.best_candidate(results))
    return results.where(F.col("candidate") == best).select("candidate", "rank_test_score")


@register("c6_notebook_grouped_cv", f"""WITH g AS ({_product_sql({"C": flows.NOTEBOOK_CS, "solver": ["lbfgs"], "class_weight": ["balanced"], "max_iter": [1000]})})
SELECT k.n AS n_splits, candidate, params, k.n AS n_scores, TRUE AS in_range FROM g, (VALUES (7), (10)) k(n)""")
def c6_notebook_grouped_cv(spark, sf_dir):
    """Notebook: all rows, scaled + zero-filled, LR over 5 values of C with 7- and 10-fold group k-fold by user."""
    lab = fx.labelled_samples(spark, sf_dir).drop("pred_a", "pred_b", "part")
    return _scored_rows(flows.notebook_grouped_cv(lab, FEATS), ["n_splits"])


@register("l3_lr_embeddings", """
SELECT CAST(label AS INTEGER) AS label, count(*) AS n, TRUE AS at_minimum FROM embeddings GROUP BY label""")
def l3_lr_embeddings(spark, sf_dir):
    """Balanced multinomial LR on the whole embedding vectors (10 classes): its objective's gradient vanishes."""
    emb = fx.embedding_samples(spark, sf_dir)
    config = {"estimator": "logistic-regression", "C": 1.0, "max_iter": 500, "class_weight": "balanced", "tol": 1e-9}
    model = md.early_fusion([c for c in emb.columns if c.startswith("emb_")], config).fit(emb)
    worst = _multinomial_gradient(model, emb, config["C"])
    return emb.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("at_minimum", F.lit(worst < GRADIENT))


def flagship(spark, sf_dir):
    raw = fx.samples(spark, sf_dir, with_part=False)
    cfg = flows.RunConfig(activity_labels=fx.SAMPLE_LABELS)
    return round_doubles(flows.run(raw, fx.members(spark, sf_dir), cfg, folds=[0])["results"])


# ---- K1, K2, K5: sinks, written under the shared folder and read back ------------------------------------------


@register("k1_dataset_roundtrip", f"""WITH {_MERGED}, {_MOMENTS_SQL}, {_CHOSEN_SQL}
SELECT uuid, "timestamp", label, {_NAMES_SQL}[label + 1] AS label_name, {_PICKED_SQL} FROM merged""")
def k1_dataset_roundtrip(spark, sf_dir):
    """The run's own dataset: selected features, written under the percentile, read back."""
    raw = fx.samples(spark, sf_dir, with_part=False)
    data, selection = flows.preprocess(raw, flows.RunConfig(activity_labels=fx.SAMPLE_LABELS))
    back = store.read_dataset(spark, store.write_dataset(data, shared_dir(spark, "dataset"), 40))
    return _numbered(back, sel.selected_names(selection), ["uuid", "timestamp", "label", "label_name"])


@register("k6_cv_results_roundtrip", f"""WITH {_SCORES_SQL}
SELECT 'm' AS model, CAST(f.range AS INTEGER) AS fold, candidate, round(mean_test_score, 9) AS mean_test_score, rank_test_score
FROM r, range(2) f""")
def k6_cv_results_roundtrip(spark, sf_dir):
    """CV results of two folds saved under their keys, one of them twice, read back as one table."""
    path = shared_dir(spark, "cv-results")
    results = tune.cv_table(_rule_scores(spark, sf_dir), [0, 1, 2], _CANDIDATES)
    for fold in (0, 1, 1):
        store.replace_rows(results, path, {"model": "m", "fold": fold})
    return round_doubles(store.read_table(spark, path).select("model", "fold", "candidate", "mean_test_score", "rank_test_score"))


@register("k2_fold_export_roundtrip", ORACLES["j2_fold_rows"])
def k2_fold_export_roundtrip(spark, sf_dir):
    """Dataset and membership written once, rows exported by (fold, split), read back."""
    out = store.write_folds(fx.labelled_samples(spark, sf_dir), fx.members(spark, sf_dir), shared_dir(spark, "folds"),
                            export=True)
    back = spark.read.parquet(out["export"])
    return back.withColumn("fold", F.col("fold").cast("int"))


@register("k5_results_roundtrip", f"""SELECT *, 40 AS pct, 'StratifiedKFold' AS cv_method FROM ({ORACLES["e7_results_table"]})""")
def k5_results_roundtrip(spark, sf_dir):
    """Results of two rule models saved under their key columns, twice as by a second run, read back."""
    path = shared_dir(spark, "results")
    res = ev.fold_results(fold_predictions(spark, sf_dir), ["pred_a", "pred_b"])
    for _ in range(2):
        store.replace_rows(round_doubles(res), path, {"pct": 40, "cv_method": "StratifiedKFold"})
    return store.read_table(spark, path)


@register("j4_lr_vs_rf_agreement", f"""WITH {_FOLD_ROWS}
SELECT CAST(label AS INTEGER) AS label, count(*) AS n, TRUE AS shares_sum_to_one FROM t WHERE fold = 0 AND split = 'test' GROUP BY ALL""")
def j4_lr_vs_rf_agreement(spark, sf_dir):
    """Notebook comparison with real models: balanced LR and RF trained on fold 0, both scored on the test users; the four
    cells of joint correctness hold each true class's rows."""
    train, test = _fold0(spark, sf_dir)
    lr = md.early_fusion(FEATS, flows.DEFAULT_MODEL).fit(train)
    rf = md.early_fusion(FEATS, RF_CONFIG).fit(train)
    scored = md.score_two(lr, rf, test, "lr", "rf")
    return (flows.compare_models(scored, "lr", "rf")["agreement_by_class"].groupBy("label")
            .agg(F.sum("n").alias("n"), (F.abs(F.sum("share") - 1) < 1e-9).alias("shares_sum_to_one")))


_EV_LIST = "[" + ", ".join(f"coalesce({c}, 'NaN'::DOUBLE)" for c in fx.EVENT_LABELS) + "]"
_EV_NAMES = "[" + ", ".join(f"'{n}'" for n in fx.EVENT_LABELS) + "]"


@register("j1_unique_keys_events", f"""WITH ev AS ({fx.EVENTS_SQL}),
f AS (SELECT uuid, "timestamp", acc_value, discrete_props_bytes FROM ev),
l AS (SELECT uuid, "timestamp", {", ".join(fx.EVENT_LABELS)} FROM ev),
j AS (SELECT * FROM f LEFT JOIN l USING (uuid, "timestamp"))
SELECT * EXCLUDE (l, {", ".join(fx.EVENT_LABELS)}), {fx.ARGMAX_SQL} AS label, {_EV_NAMES}[{fx.ARGMAX_SQL} + 1] AS label_name
FROM (SELECT *, {_EV_LIST} AS l FROM j)""")
def j1_unique_keys_events(spark, sf_dir):
    """The flows' ``auto`` strategy keyed by (user, time): the key check decides between the self-join and a projection;
    the result equals the left join."""
    return lb.merged_dataset(fx.event_samples(spark, sf_dir), fx.EVENT_LABELS, strategy="auto")


@register("k3_single_split_roundtrip", f"""WITH {LAB}, {MEM}
SELECT l.* EXCLUDE ("timestamp"), m.split FROM lab l JOIN mem m ON l.uuid = m.uuid AND m.fold = 0""")
def k3_single_split_roundtrip(spark, sf_dir):
    """Single train/test split (fold 0 of the membership) written by split without timestamp, read back."""
    path = store.write_single_split(fx.labelled_samples(spark, sf_dir), fx.members(spark, sf_dir),
                                    shared_dir(spark, "single"))
    return spark.read.parquet(path)


@register("s7_fold_lists_roundtrip", f"""WITH {MEM}
SELECT * FROM mem""")
def s7_fold_lists_roundtrip(spark, sf_dir):
    """Fold membership written as uuid-per-line text lists by (fold, split, source), read back."""
    from ctxspark.sources.sensor_csv import read_fold_lists

    path = shared_dir(spark, "fold-lists")
    fx.members(spark, sf_dir).write.mode("overwrite").partitionBy("fold", "split", "source").text(path)
    return read_fold_lists(spark, path, layout="partitioned")
