"""Folds and groups: rows of a fold split, user groups, user codes, group k-fold and stratified k-fold.

Membership tables (one row per fold x user) and group tables (one row per user) are joined by plain equi-joins: Spark
broadcasts them by their measured bytes or shuffles. Group k-fold keeps its groups in Spark and brings only the
histogram of their sizes to the driver. Stratified k-fold hashes rows into buckets whose number follows from the label
counts alone; bucket sizes give exact offsets, and a row's fold is its global position in label order, mod k.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxspark.functions import q
from ctxspark.session import shared_dir


class UnknownUserError(ValueError):
    pass


def fold_rows(df: DataFrame, members: DataFrame, fold: int | None = None, split: str | None = None,
              validate: bool = True) -> DataFrame:
    """Rows of the users listed for (fold, split); a user listed twice gives its rows twice.

    With ``fold``/``split`` None all listed folds/splits are returned, tagged with ``fold`` and ``split``.
    A listed user without rows raises, unless ``validate`` is off (for callers that have checked the lists).
    """
    m = members
    if fold is not None:
        m = m.filter(F.col("fold") == fold)
    if split is not None:
        m = m.filter(F.col("split") == split)
    m = m.select("uuid", "fold", "split")
    if validate:
        check_members(df, m)
    return df.join(m, "uuid")


def check_members(df: DataFrame, members: DataFrame) -> None:
    """Raise when a user listed in the fold membership has no rows (one anti-join of the distinct users)."""
    unknown = members.select("uuid").distinct().join(df.select("uuid").distinct(), "uuid", "left_anti")
    missing = [r.uuid for r in unknown.limit(5).collect()]
    if missing:
        raise UnknownUserError(f"users in the fold list without rows: {missing}")


def stored_members(members: DataFrame) -> DataFrame:
    """The membership written once: joins with it read a table of known size, which Spark broadcasts if small, instead of making the lists
    again and shuffling the rows for each read of a fold."""
    path = shared_dir(members.sparkSession, "members")
    members.write.parquet(path)
    return members.sparkSession.read.parquet(path)


def attach_groups(df: DataFrame, group_map: DataFrame, group_col: str = "group") -> DataFrame:
    """uuid -> group from a configured map; users not in the map get null."""
    return df.join(group_map.select("uuid", q(group_col)), "uuid", "left")


def dense_index(keys: DataFrame, order: Sequence[Column], out: str = "code") -> DataFrame:
    """0-based position of each row of ``keys`` in the given order, without a single-task global sort.

    Keys are range-partitioned and written once with their partition's number; from that table (and not from a second
    evaluation of the split) come both the positions inside a partition and the sizes of the partitions before it.
    """
    spark = keys.sparkSession
    path = shared_dir(spark, "dense-index")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    local = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__p", (F.sum("__n").over(
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n"))
        .alias("__off"))
    # one row per partition of the range split: a proven bound
    return (local.join(F.broadcast(offsets), "__p")
            .select(*[q(c) for c in keys.columns], (F.col("__off") + F.col("__r") - 1).alias(out)))


def uuid_codes(df: DataFrame, col: str = "uuid") -> DataFrame:
    """(uuid, code): dense 0-based code of each distinct user in sorted order."""
    return dense_index(df.select(q(col)).distinct(), [q(col)], "code").withColumn("code", F.col("code").cast("int"))


def attach_uuid_codes(df: DataFrame, col: str = "uuid", out: str = "group") -> DataFrame:
    return df.join(uuid_codes(df, col).withColumnRenamed("code", out), col)


def greedy_runs(histogram: Iterable[tuple[int, int]], n_splits: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy balance from the histogram of group sizes: runs (size, first, count, folds).

    Groups are taken largest first, each into the fold with the fewest rows so far (the lowest index among equals). The
    ``count`` groups of a size from rank ``first`` on go to ``folds`` in turn. Folds within one size of the lightest
    take turns in a fixed order until they reach the next fold, so a size needs a few runs however many groups it has.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    histogram = sorted(histogram, reverse=True)
    total = sum(c for _, c in histogram)
    if total < n_splits:
        raise ValueError(f"cannot split {total} groups into {n_splits} folds")
    load, out = [0] * n_splits, []
    for size, count in histogram:
        first = 0
        while first < count:
            order = sorted(range(n_splits), key=lambda f: (load[f], f))
            turn = [f for f in order if load[f] < load[order[0]] + size]
            rest = order[len(turn):]
            rounds = (count - first) // len(turn)
            if rest:
                rounds = min(rounds, (load[rest[0]] - 1 - load[turn[-1]]) // size)
            if rounds < 1:
                turn, rounds = order[:1], 1
            for f in turn:
                load[f] += rounds * size
            out.append((size, first, rounds * len(turn), turn))
            first += rounds * len(turn)
    return out


def group_folds(sizes: DataFrame, n_splits: int, out: str = "cv_fold") -> DataFrame:
    """(group, n) -> (group, n, fold): ties between groups go to the smaller key, a null group last.

    Only the histogram of sizes (size, number of groups) reaches the driver.
    """
    histogram = [(r[0], r[1]) for r in sizes.groupBy("n").agg(F.count(F.lit(1))).collect()]
    runs = greedy_runs(histogram, n_splits)
    starts, at = [], 0
    for size, count in sorted(histogram, reverse=True):
        starts.append((size, at))
        at += count
    first_of = dict(starts)
    spark = sizes.sparkSession
    table = spark.createDataFrame([(s, first_of[s] + f, first_of[s] + f + c, t) for s, f, c, t in runs],
                                  "n long, __from long, __to long, __folds array<int>")
    ranked = dense_index(sizes, [F.desc("n"), F.asc_nulls_last("group")], "__rank")
    placed = ranked.join(table, "n").where((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    turn = F.pmod(F.col("__rank") - F.col("__from"), F.size("__folds")).cast("int")
    return placed.select("group", "n", F.get("__folds", turn).alias(out))


def group_kfold(df: DataFrame, group_col: str = "group", n_splits: int = 5, out: str = "cv_fold") -> DataFrame:
    """Tag each row with the test fold of its group (groups never span two folds)."""
    sizes = df.groupBy(q(group_col).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    folds = group_folds(sizes, n_splits, out).select(F.col("group").alias("__g"), q(out))
    return df.join(folds, q(group_col).eqNullSafe(F.col("__g"))).drop("__g")


def stratified_kfold(df: DataFrame, label: str = "label", k: int = 3, seed: int = 0, out: str = "cv_fold",
                     rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Tag each row with a stratified fold in 0..k-1; per label, fold sizes differ by at most one.

    Rows of a label are put in a seeded pseudo-random order (hash of all columns). The row at global position j of
    the label-sorted order goes to fold j mod k, which gives the same per-label fold sizes as a shuffled stratified
    split. Positions need no global sort: rows hash into B buckets, B following from the label counts and
    ``rows_per_bucket`` alone (never from the cluster), bucket sizes give offsets, and positions are row numbers inside
    one (label, bucket). Equal rows are interchangeable; where one row is repeated beyond ``rows_per_bucket``, its
    copies are dealt over parts by their number in a stored copy of the table.
    """
    cols = [q(c) for c in df.columns]
    counts = {r[0]: r[1] for r in df.groupBy(q(label)).agg(F.count(F.lit(1))).collect()}      # K rows
    if not counts:
        return df.withColumn(out, F.lit(None).cast("int"))
    buckets = math.ceil(max(counts.values()) / rows_per_bucket)
    rows = (df.withColumn("__h", F.xxhash64(F.lit(seed), *cols)).withColumn("__h2", F.xxhash64(F.lit(seed + 1), *cols))
            .withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("int")))
    cells = rows.groupBy(q(label).alias("__y"), "__b").agg(F.count(F.lit(1)).alias("__n"))
    part = F.lit(0)
    if buckets > 1 and not cells.where(F.col("__n") > 2 * rows_per_bucket).isEmpty():
        # the rows of more copies than a bucket takes: at most N / rows_per_bucket of them
        hot = (rows.groupBy("__h", "__h2").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > rows_per_bucket)
               .select("__h", "__h2", F.ceil(F.col("__c") / rows_per_bucket).cast("int").alias("__parts")))
        path = shared_dir(df.sparkSession, "stratified")
        (rows.withColumn("__id", F.monotonically_increasing_id()).join(hot, ["__h", "__h2"], "left")
         .withColumn("__hot", F.when(F.col("__parts").isNotNull(), F.col("__h"))).write.parquet(path))
        rows = df.sparkSession.read.parquet(path)
        part = F.coalesce(F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int"), F.lit(0))
    else:
        rows = rows.withColumn("__hot", F.lit(None).cast("long"))
    rows = rows.withColumn("__part", part)
    at = ["__b", "__hot", "__part"]
    sizes = rows.groupBy(q(label).alias("__y"), *at).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__y", *[F.col(c).alias(f"{c}o") for c in at], (F.sum("__n").over(
        Window.orderBy("__y", *at).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).alias("__off"))
    same = q(label).eqNullSafe(F.col("__y"))
    for c in at:
        same &= F.col(c).eqNullSafe(F.col(f"{c}o"))
    w = Window.partitionBy(q(label), *at).orderBy("__h", "__h2")
    pos = F.col("__off") + F.row_number().over(w) - 1
    return rows.join(offsets, same).withColumn(out, F.pmod(pos, F.lit(k)).cast("int")).select(*cols, q(out))
