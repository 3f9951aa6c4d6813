"""Datasets, models and result tables on a shared file system (Parquet by default).

Fold data is not copied per fold: the base dataset and the membership table are written once, and a fold is a
broadcast join of the two. An optional export writes rows partitioned by (fold, split) for external tools.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.functions import DISCRETE_PREFIX
from ctxspark.operators.folds import fold_rows


def dataset_path(base: str, percentile: float) -> str:
    """The percentile is part of the path, like ``.../pct=40``."""
    pct = int(percentile) if float(percentile).is_integer() else percentile
    return f"{base.rstrip('/')}/pct={pct}"


def write_dataset(df: DataFrame, base: str, percentile: float, fmt: str = "parquet") -> str:
    path = dataset_path(base, percentile)
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
    return path


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Dataset or fold table; ``label`` as int; discrete features stay doubles (their kind is in the name)."""
    if fmt == "csv":
        # every value is read as text and cast by its column's role: no pass to infer types
        df = spark.read.option("header", True).csv(path)
        kinds = {"uuid": "string", "label_name": "string", "label_source": "string", "timestamp": "long", "label": "int"}
        df = df.select(*[F.col("`" + c + "`").cast(kinds.get(c, "double")).alias(c) for c in df.columns])
    else:
        df = spark.read.parquet(path)
    casts = {}
    if "label" in df.columns:
        casts["label"] = F.col("label").cast("int")
    for c in df.columns:
        if c.startswith(DISCRETE_PREFIX):
            casts[c] = F.col("`" + c + "`").cast("double")
    return df.withColumns(casts) if casts else df


#: Rows of an export's open files that a writer holds, a file per (fold, split) and task.
OPEN_FILE_BYTES = 8 << 20


def write_parted(df: DataFrame, path: str, by: Sequence[str], parts: int) -> None:
    """``df`` as Parquet in folders by the columns ``by``, of ``parts`` values at most: a task keeps a file of each open and needs no sort of its
    rows, which would spill; beyond ``parts`` Spark sorts the rest."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, str(parts + 1))          # Spark goes over to sorting once so many files are open
    try:
        (df.write.mode("overwrite").option("parquet.block.size", OPEN_FILE_BYTES).option("compression", "zstd")
         .partitionBy(*by).parquet(path))
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def write_folds(dataset: DataFrame, members: DataFrame, base: str, export: bool = False) -> dict[str, str]:
    """Write the dataset and the membership table once; optionally export rows by (fold, split)."""
    root = base.rstrip("/")
    out = {"data": f"{root}/data", "members": f"{root}/members"}
    dataset.write.mode("overwrite").parquet(out["data"])
    members.write.mode("overwrite").parquet(out["members"])
    if export:
        out["export"] = f"{root}/by_fold"
        spark = dataset.sparkSession
        data, lists = spark.read.parquet(out["data"]), spark.read.parquet(out["members"])
        write_parted(fold_rows(data, lists), out["export"], ["fold", "split"], max(1, lists.select("fold", "split").distinct().count()))
    return out


def write_single_split(dataset: DataFrame, members: DataFrame, base: str, drop: Sequence[str] = ("timestamp", "label_name")) -> str:
    """Single train/test split (fold 0 of ``members``), partitioned by split."""
    path = f"{base.rstrip('/')}/single"
    rows = fold_rows(dataset, members, fold=0).drop("fold")
    write_parted(rows.drop(*[c for c in drop if c in rows.columns]), path, ["split"], 2)
    return path


def model_path(base: str, model: str, estimator: str, percentile: float, cv_method: str, fold: int | None) -> str:
    parts = [base.rstrip("/"), model, estimator, str(percentile), cv_method]
    return "/".join(parts + ([f"fold={fold}"] if fold is not None else ["all"]))


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_table(df: DataFrame, path: str, keys: dict | None = None) -> str:
    """Append rows (with constant key columns) to a Parquet table, e.g. results or cv_results."""
    out = df.withColumns({k: F.lit(v) for k, v in (keys or {}).items()}) if keys else df
    out.write.mode("append").parquet(path)
    return path


def replace_rows(df: DataFrame, path: str, keys: dict) -> str:
    """Write rows under ``path/<key>=<value>/...`` and replace what those keys held before: a second run adds nothing twice.

    Other keys' rows stay; :func:`read_table` gives all of them back with the key columns.
    """
    at = "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in keys.items())])
    df.drop(*keys).write.mode("overwrite").parquet(at)        # a column of a key's name is read from the path
    return path


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.option("header", True).csv(path)
    # parts of one table may have other split columns than the rest
    return spark.read.option("mergeSchema", True).parquet(path)
