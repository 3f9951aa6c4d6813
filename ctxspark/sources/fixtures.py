"""The ``samples`` view: a sensor-style wide table derived from the provided ``lineitem`` table.

Most registered queries start here, so their work grows with ``lineitem``; ``events`` and ``embeddings`` have views of
their own. Each Spark builder has a SQL twin
(``*_SQL``) that the DuckDB oracles use, so both engines read the same rows.

``lineitem`` has 3 return flags x 2 line statuses, i.e. six activity classes; supplier keys play the users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.functions import argmax_label, q

# Activity one-hot columns of the fixture, in class order 0..5, with their (returnflag, linestatus).
SAMPLE_LABELS = ("label_af", "label_ao", "label_nf", "label_no", "label_rf", "label_ro")
SAMPLE_LABEL_KEYS = (("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O"))
SAMPLE_FEATURES = ("acc_quantity", "acc_price", "gyro_tax", "gyro_discount", "discrete_line", "discrete_big")
N_FOLDS = 5

LINEITEM_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, with_part: bool = True) -> DataFrame:
    """Wide per-(user, timestamp) rows: 4 numeric + 2 discrete features, 6 one-hot activity columns."""
    li = read_table(spark, sf_dir, "lineitem")
    cols = [
        F.col("l_suppkey").cast("string").alias("uuid"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("timestamp"),
        F.col("l_quantity").cast("double").alias("acc_quantity"),
        F.col("l_extendedprice").cast("double").alias("acc_price"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).cast("double").alias("gyro_tax"),
        F.col("l_discount").cast("double").alias("gyro_discount"),
        F.nullif(F.col("l_linenumber"), F.lit(7)).cast("double").alias("discrete_line"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("discrete_big"),
    ]
    for name, (flag, status) in zip(SAMPLE_LABELS, SAMPLE_LABEL_KEYS):
        hit = (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status)
        cols.append(F.when(hit, 1.0).otherwise(0.0).alias(name))
    if with_part:
        cols.append(F.col("l_partkey").cast("long").alias("part"))
    return li.select(*cols)


def with_rule_predictions(df: DataFrame, label: str = "label") -> DataFrame:
    """Two deterministic 'models' for the evaluator and comparison operators (no ML)."""
    part, y = F.col("part"), F.col(label)
    return df.withColumns({
        "pred_a": F.when(part % 3 == 0, y).otherwise(part % 6).cast("int"),
        "pred_b": F.when(part % 4 == 0, y).otherwise((part + 1) % 6).cast("int"),
    })


def labelled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples + ``label`` (argmax of the one-hot columns) + rule predictions; one-hot columns dropped."""
    s = samples(spark, sf_dir)
    s = s.withColumn("label", argmax_label(SAMPLE_LABELS)).drop(*SAMPLE_LABELS)
    return with_rule_predictions(s)


def members(spark: SparkSession, sf_dir: str, n_folds: int = N_FOLDS) -> DataFrame:
    """Fold membership (fold, split, source, uuid): user u is in the test split of fold u % n_folds.

    One row per (fold, user): bounded by #users x #folds, never by rows.
    """
    users = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("uuid")).distinct()
    folds = F.sequence(F.lit(0), F.lit(n_folds - 1))
    return (
        users.select("uuid", F.explode(folds).alias("fold"))
        .withColumn("split", F.when(F.col("uuid").cast("int") % n_folds == F.col("fold"), "test").otherwise("train"))
        .withColumn("source", F.when(F.col("uuid").cast("int") % 2 == 0, "android").otherwise("iphone"))
        .select("fold", "split", "source", "uuid")
    )


def group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uuid -> group ``1 + uuid % 5``; users divisible by 7 are left out (unlisted -> null group on join)."""
    users = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("uuid")).distinct()
    return (
        users.filter(F.col("uuid").cast("int") % 7 != 0)
        .select("uuid", (1 + F.col("uuid").cast("int") % 5).cast("string").alias("group"))
    )


# Event types of the provided ``events`` table, in class order 0..4.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_LABELS = tuple(f"label_{t}" for t in EVENT_TYPES)


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a wide table keyed by (user, time in microseconds): hardly any key repeats."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("uuid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
                    F.col("value").cast("double").alias("acc_value"),
                    F.octet_length("props").cast("double").alias("discrete_props_bytes"),
                    *[F.when(F.col("event_type") == t, 1.0).otherwise(0.0).alias(n)
                      for t, n in zip(EVENT_TYPES, EVENT_LABELS)])


EVENTS_SQL = """
SELECT CAST(user_id AS VARCHAR) AS uuid, CAST(epoch_us(ts) AS BIGINT) AS "timestamp", CAST(value AS DOUBLE) AS acc_value,
       CAST(strlen(props) AS DOUBLE) AS discrete_props_bytes,
""" + ",\n".join(f"       CAST(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END AS DOUBLE) AS label_{t}" for t in EVENT_TYPES) + """
FROM events
"""


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a wide numeric table (emb_000 ..., as many as the longest vector has; label 0..9)."""
    e = read_table(spark, sf_dir, "embeddings")
    dim = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select(F.col("vec_id").cast("string").alias("uuid"), F.col("vec_id").cast("long").alias("timestamp"),
                    *[F.get("embedding", F.lit(i)).cast("double").alias(f"emb_{i:03d}") for i in range(dim)],
                    F.col("label").cast("int").alias("label"))


def embedding_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule 'model' of ten classes over ``embeddings``: right for two of three vectors, else by the vector's id."""
    return read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label"), F.when(
        F.col("vec_id") % 3 != 0, F.col("label")).otherwise(F.col("vec_id") % 10).cast("int").alias("prediction"))


EMBEDDING_PREDICTIONS_SQL = """
SELECT CAST(label AS INTEGER) AS label, CAST(CASE WHEN vec_id % 3 <> 0 THEN label ELSE vec_id % 10 END AS INTEGER) AS prediction
FROM embeddings
"""


# ---- SQL twins for the DuckDB oracles -------------------------------------------------------------------------

SAMPLES_SQL = """
SELECT CAST(l_suppkey AS VARCHAR)                AS uuid,
       CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS "timestamp",
       CAST(l_quantity AS DOUBLE)                AS acc_quantity,
       CAST(l_extendedprice AS DOUBLE)           AS acc_price,
       CAST(NULLIF(l_tax, 0.0) AS DOUBLE)        AS gyro_tax,
       CAST(l_discount AS DOUBLE)                AS gyro_discount,
       CAST(NULLIF(l_linenumber, 7) AS DOUBLE)   AS discrete_line,
       CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS DOUBLE) AS discrete_big,
       CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS label_af,
       CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS DOUBLE) AS label_ao,
       CAST(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS label_nf,
       CAST(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS DOUBLE) AS label_no,
       CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS label_rf,
       CAST(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS DOUBLE) AS label_ro,
       CAST(l_partkey AS BIGINT)                 AS part
FROM lineitem
"""

ARGMAX_SQL = ("CAST(list_position(l, list_max(l)) - 1 AS INTEGER)")
LABEL_LIST_SQL = "[" + ", ".join(f"coalesce({c}, 'NaN'::DOUBLE)" for c in SAMPLE_LABELS) + "]"

LABELLED_SQL = f"""
SELECT * EXCLUDE (l),
       CAST(CASE WHEN part % 3 = 0 THEN label ELSE part % 6 END AS INTEGER) AS pred_a,
       CAST(CASE WHEN part % 4 = 0 THEN label ELSE (part + 1) % 6 END AS INTEGER) AS pred_b
FROM (SELECT * EXCLUDE ({", ".join(SAMPLE_LABELS)}), {ARGMAX_SQL} AS label
      FROM (SELECT *, {LABEL_LIST_SQL} AS l FROM ({SAMPLES_SQL})))
"""

MEMBERS_SQL = f"""
SELECT CAST(f.fold AS INTEGER) AS fold,
       CASE WHEN CAST(u.uuid AS INTEGER) % {N_FOLDS} = f.fold THEN 'test' ELSE 'train' END AS split,
       CASE WHEN CAST(u.uuid AS INTEGER) % 2 = 0 THEN 'android' ELSE 'iphone' END AS source,
       u.uuid
FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS uuid FROM lineitem) u,
     (SELECT range AS fold FROM range({N_FOLDS})) f
"""

GROUP_MAP_SQL = """
SELECT uuid, CAST(1 + CAST(uuid AS INTEGER) % 5 AS VARCHAR) AS "group"
FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS uuid FROM lineitem)
WHERE CAST(uuid AS INTEGER) % 7 <> 0
"""
