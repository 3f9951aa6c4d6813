"""Labelling: split the wide table by role, join labels back, derive the class label, order columns.

The features/labels left join on (uuid, timestamp) is a hash-partitioned equi-join; with k copies of a key it
gives k*k rows, exactly like a relational left join. When features and labels come from the *same* table and the
key is unique, the join is redundant: :func:`merged_dataset` can find the repeated keys with one key-only aggregate and
then join only their rows (strategies ``"repeated"`` and ``"auto"``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.functions import (
    ACTIVITY_LABELS,
    LABEL_PREFIX,
    argmax_label,
    columns_with_prefix,
    feature_columns,
    label_name,
    q,
)
from ctxspark.session import shared_dir

KEYS = ("uuid", "timestamp")


def union_users(frames: Sequence[DataFrame]) -> DataFrame:
    """Vertical concat by column name; a column missing from a frame is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_roles(df: DataFrame, activity_labels: Sequence[str] = ACTIVITY_LABELS,
                keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(features frame, labels frame); both keep the key columns."""
    labels_all = columns_with_prefix(df, LABEL_PREFIX)
    feats = feature_columns(df, labels_all)
    features = df.select(*[q(k) for k in keys], *[q(c) for c in feats])
    labels = df.select(*[q(k) for k in keys], *[q(c) for c in activity_labels])
    return features, labels


def join_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS,
                null_safe_keys: bool = False) -> DataFrame:
    """Left equi-join features with labels; unmatched feature rows keep null labels."""
    if not null_safe_keys:
        return features.join(labels, list(keys), "left")
    lab = labels.select(*[q(c).alias(f"__r_{c}") if c in keys else q(c) for c in labels.columns])
    cond = reduce(lambda a, b: a & b, [q(k).eqNullSafe(F.col(f"`__r_{k}`")) for k in keys])
    return features.join(lab, cond, "left").drop(*[f"__r_{k}" for k in keys])


def set_labels(df: DataFrame, activity_labels: Sequence[str] = ACTIVITY_LABELS,
               names: Sequence[str] | None = None) -> DataFrame:
    """Add ``label`` (argmax of the activity columns) and ``label_name``; drop the activity columns."""
    names = list(names) if names is not None else list(activity_labels)
    out = df.withColumn("label", argmax_label(activity_labels))
    out = out.withColumn("label_name", label_name(F.col("label"), names))
    return out.drop(*activity_labels)


def order_columns(df: DataFrame, first: Sequence[str] = ("uuid",)) -> DataFrame:
    """Key columns first, then every other column by code point."""
    lead = [c for c in first if c in df.columns]
    rest = sorted(c for c in df.columns if c not in lead)
    return df.select(*[q(c) for c in lead + rest])


#: Hashes of repeated keys are broadcast up to this many (counted first); beyond it the whole frames are joined.
REPEATED_KEYS = 1_000_000


def key_hash(keys: Sequence[str] = KEYS) -> Column:
    return F.xxhash64(*[q(k) for k in keys]).alias("__key")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(__key): the hashes that several rows' keys have, written once, from one aggregate over the key columns only."""
    dup = df.select(key_hash(keys)).groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _stored(dup.select("__key"), "repeated-keys")


def join_repeated(df: DataFrame, repeated: DataFrame, n_repeated: int, activity_labels: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """:func:`join_labels` of the two roles of ``df``, for which only the rows of ``repeated`` keys are joined: a row whose key stands alone
    meets itself, and one without a key (null) meets nothing and gets null labels."""
    features, labels = split_roles(df, activity_labels, keys)
    if n_repeated > REPEATED_KEYS:
        return join_labels(features, labels, keys)
    known = reduce(lambda a, b: a & b, [q(k).isNotNull() for k in keys])
    rows, few = df.withColumn("__key", key_hash(keys)), F.broadcast(repeated)
    alone = (rows.join(few, "__key", "left_anti") if n_repeated else rows).select(
        *[q(c) for c in features.columns], *[F.when(known, q(c)).alias(c) for c in activity_labels])
    if not n_repeated:
        return alone
    several = _stored(rows.join(few, "__key", "left_semi").drop("__key"), "repeated-rows")
    return alone.unionByName(join_labels(*split_roles(several, activity_labels, keys), keys))


def merged_dataset(df: DataFrame, activity_labels: Sequence[str] = ACTIVITY_LABELS, names: Sequence[str] | None = None,
                   keys: Sequence[str] = KEYS, strategy: str = "join") -> DataFrame:
    """Features joined with their labels, labelled, columns sorted.

    ``strategy``: ``"join"`` always joins (duplicates fan out k*k); ``"project"`` assumes unique keys;
    ``"repeated"`` finds the repeated keys first and joins their rows only, with the result of ``"join"``;
    ``"auto"`` does the same, or projects when the keys are unique.
    """
    if strategy not in ("join", "project", "repeated", "auto"):
        raise ValueError(f"unknown strategy {strategy!r}")
    features, labels = split_roles(df, activity_labels, keys)
    if strategy == "join":
        merged = join_labels(features, labels, keys)
    else:
        repeated = repeated_keys(df, keys) if strategy != "project" else None
        n_repeated = repeated.count() if repeated is not None else 0
        if strategy == "repeated" or n_repeated:
            merged = join_repeated(df, repeated, n_repeated, activity_labels, keys)
        else:
            merged = df.select(*[q(c) for c in features.columns], *[q(c) for c in activity_labels])
    return order_columns(set_labels(merged, activity_labels, names))
