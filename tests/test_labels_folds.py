"""Labelling join, fold rows, groups, group k-fold, stratified k-fold."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ctxspark.operators import folds as fo
from ctxspark.operators import labels as lb

ACT = ["label:A", "label:B"]


def _wide(spark, rows):
    return spark.createDataFrame(rows, "uuid string, timestamp long, f1 double, `label:A` double, `label:B` double")


def test_join_fanout_and_unmatched(spark):
    feats = spark.createDataFrame([("u", 1, 1.0), ("u", 1, 2.0), ("u", 2, 3.0), ("u", 2, 4.0), ("u", 2, 5.0),
                                   ("v", 9, 6.0)], "uuid string, timestamp long, f1 double")
    labs = spark.createDataFrame([("u", 1, 0.0, 1.0), ("u", 1, 0.0, 1.0), ("u", 2, 1.0, 0.0), ("u", 2, 1.0, 0.0),
                                  ("u", 2, 1.0, 0.0)], "uuid string, timestamp long, `label:A` double, `label:B` double")
    j = lb.join_labels(feats, labs)
    counts = {(r.timestamp): r["count"] for r in j.groupBy("timestamp").count().collect()}
    assert counts == {1: 4, 2: 9, 9: 1}
    labelled = lb.set_labels(j, ACT)
    un = labelled.filter(F.col("uuid") == "v").collect()[0]
    assert un.label == 0 and un.label_name == "label:A"
    assert "label:A" not in labelled.columns


def test_merged_dataset_strategies_agree(spark):
    rows = [("u", 1, 1.0, 0.0, 1.0), ("u", 2, 2.0, 1.0, 0.0), ("w", 1, None, 0.0, 0.0)]
    df = _wide(spark, rows)
    a = lb.merged_dataset(df, ACT, strategy="join")
    b = lb.merged_dataset(df, ACT, strategy="auto")
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.columns == ["uuid", "f1", "label", "label_name", "timestamp"]
    dup = _wide(spark, rows + [rows[0]])
    assert lb.merged_dataset(dup, ACT, strategy="auto").count() == 3 + 3   # 2 copies -> 4 rows


def test_fold_rows_duplicates_and_unknown(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "uuid string, timestamp long")
    mem = spark.createDataFrame([(0, "train", "android", "a"), (0, "train", "iphone", "a"), (0, "test", "android", "b")],
                                "fold int, split string, source string, uuid string")
    assert fo.fold_rows(df, mem, fold=0, split="train").count() == 4   # listed twice -> rows twice
    bad = mem.union(spark.createDataFrame([(0, "test", "iphone", "zz")], mem.schema))
    with pytest.raises(fo.UnknownUserError):
        fo.fold_rows(df, bad, fold=0, split="test")
    assert fo.fold_rows(df, bad, fold=0, split="test", validate=False).count() == 1


def test_uuid_codes_and_groups(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "uuid string")
    codes = {r.uuid: r.code for r in fo.uuid_codes(df).collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}
    gm = spark.createDataFrame([("a", "1")], "uuid string, group string")
    got = {r.uuid: r.group for r in fo.attach_groups(df, gm).collect()}
    assert got == {"a": "1", "b": None, "c": None}


def greedy(sizes, n):
    load, out = [0] * n, []
    for s in sorted(sizes, reverse=True):
        f = min(range(n), key=lambda i: (load[i], i))
        load[f] += s
        out.append(f)
    return out


def unrolled(sizes, n):
    histogram = {s: sizes.count(s) for s in sizes}
    return [f[i % len(f)] for _, _, c, f in fo.greedy_runs(histogram.items(), n) for i in range(c)]


def test_greedy_runs_equal_the_greedy_rule():
    r = random.Random(0)
    for _ in range(500):
        n = r.randint(2, 6)
        sizes = [r.choice([1, 2, 3, 5, 10, 100, 1000]) if r.random() < 0.7 else r.randint(1, 60) for _ in range(r.randint(n, 120))]
        assert unrolled(sizes, n) == greedy(sizes, n)
    assert unrolled([100, 10, 10, 5, 1, 1], 3) == [0, 1, 2, 1, 2, 2]
    assert len(fo.greedy_runs([(10**9, 1), (7, 10**11), (1, 10**12)], 5)) < 60       # runs, not groups
    with pytest.raises(ValueError):
        fo.greedy_runs([(1, 2)], 3)


def test_group_folds_order_ties_by_key_with_null_last(spark):
    sizes = spark.createDataFrame([("b", 5), ("a", 5), (None, 5), ("c", 9), ("d", 1)], "group string, n long")
    got = {r["group"]: r["cv_fold"] for r in fo.group_folds(sizes, 3).collect()}
    assert got == {"c": 0, "a": 1, "b": 2, None: 1, "d": 2}


def test_dense_codes_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        codes = fo.uuid_codes(spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as string) AS uuid")).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert [r.uuid for r in sorted(codes, key=lambda r: r.code)] == sorted(r.uuid for r in codes)
    assert sorted(r.code for r in codes) == list(range(20_000))


def test_group_kfold_groups_never_split(spark):
    rows = [(f"u{i % 9}", i) for i in range(300)] + [("big", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "group string, i long")
    tagged = fo.group_kfold(df, "group", 4)
    per = tagged.groupBy("group").agg(F.countDistinct("cv_fold").alias("k")).collect()
    assert all(r.k == 1 for r in per)
    assert tagged.count() == 1300
    assert {r.cv_fold for r in tagged.select("cv_fold").distinct().collect()} == {0, 1, 2, 3}


def test_stratified_sizes_within_one(spark):
    rows = [(i, i % 7 if i < 600 else 9) for i in range(602)]          # class 9 has 2 rows < k
    df = spark.createDataFrame(rows, "i long, label int")
    for buckets_rows in (10_000, 17):                                  # one bucket, and many buckets
        t = fo.stratified_kfold(df, "label", k=3, seed=3, rows_per_bucket=buckets_rows)
        assert t.count() == 602
        sizes = {}
        for r in t.groupBy("label", "cv_fold").count().collect():
            sizes.setdefault(r.label, []).append(r["count"])
        for lab, s in sizes.items():
            assert max(s) - min(s) <= 1 or len(s) < 3
        # global position rule: position j in label order -> fold j % 3
        total = {}
        for r in t.groupBy("cv_fold").count().collect():
            total[r.cv_fold] = r["count"]
        assert sorted(total.values()) == [200, 201, 201]


def test_fixture_every_row_in_one_test_fold(spark):
    from ctxspark.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    lab = fx.labelled_samples(spark, sf)
    rows = fo.fold_rows(lab, fx.members(spark, sf), split="test")
    assert rows.count() == lab.count()
    per_user = rows.groupBy("uuid").agg(F.countDistinct("fold").alias("k")).filter("k <> 1").count()
    assert per_user == 0
    train = fo.fold_rows(lab, fx.members(spark, sf), split="train")
    assert train.count() == 4 * lab.count()


MEMBERSHIP = """
import json, sys
from pyspark.sql import functions as F
from ctxspark.session import get_spark
from ctxspark.operators.folds import stratified_kfold
spark = get_spark(master=sys.argv[1], shuffle_partitions=int(sys.argv[2]))
df = spark.range(3000).repartition(int(sys.argv[2])).select("id", (F.col("id") % 3).cast("int").alias("label"))
rows = stratified_kfold(df, "label", k=3, seed=7, rows_per_bucket=100).collect()
print("MEMBERSHIP", json.dumps(sorted((r["id"], r["cv_fold"]) for r in rows)))
"""


def test_stratified_membership_does_not_depend_on_the_cores():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = set()
    for cores, parts in ((1, 3), (2, 8), (8, 5)):
        out = subprocess.run([sys.executable, "-c", MEMBERSHIP, f"local[{cores}]", str(parts)], cwd=root, capture_output=True, text=True,
                             env=os.environ | {"PYTHONPATH": root}, timeout=300)
        seen.add(out.stdout.partition("MEMBERSHIP ")[2].strip())
    assert len(seen) == 1 and len(json.loads(seen.pop())) == 3000


def test_stratified_with_many_copies_of_one_row(spark):
    rows = [(1, 0)] * 400 + [(i, i % 2) for i in range(2, 300)]
    df = spark.createDataFrame(rows, "i long, label int")
    t = fo.stratified_kfold(df, "label", k=3, seed=3, rows_per_bucket=50)
    sizes = {}
    for r in t.groupBy("label", "cv_fold").count().collect():
        sizes.setdefault(r.label, []).append(r["count"])
    assert t.count() == len(rows) and all(max(s) - min(s) <= 1 and len(s) == 3 for s in sizes.values())
    assert sorted((r.i, r.label) for r in t.collect()) == sorted(rows)


def test_stored_members_join_without_a_shuffle(spark):
    """A fold's rows are read without making its lists again or moving the rows."""
    from ctxspark.plans import checked

    train, test = checked._fold0(spark, "/root/testdata/sf0.001")
    for rows in (train, test):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "lineitem" not in plan


def test_joining_repeated_keys_only_equals_the_whole_join(spark, monkeypatch):
    rows = [("u", 1, 1.0, 0.0, 1.0), ("u", 2, 2.0, 1.0, 0.0), ("w", 1, None, 0.0, 0.0), ("u", 2, 3.0, 0.0, 1.0), ("u", 2, 3.0, 0.0, 1.0),
            (None, 1, 4.0, 1.0, 0.0), ("v", None, 5.0, 1.0, 0.0), (None, 7, 6.0, 0.0, 1.0), (None, 7, 6.0, 1.0, 0.0)]
    for part in (rows, rows[:3], rows[:3] + rows[5:7], rows[5:], []):
        df = _wide(spark, part)
        whole = sorted(lb.merged_dataset(df, ACT, strategy="join").collect(), key=repr)
        assert sorted(lb.merged_dataset(df, ACT, strategy="repeated").collect(), key=repr) == whole
        with monkeypatch.context() as m:
            m.setattr(lb, "REPEATED_KEYS", 0)
            assert sorted(lb.merged_dataset(df, ACT, strategy="repeated").collect(), key=repr) == whole


def test_only_rows_of_repeated_keys_are_joined(spark, monkeypatch):
    df = _wide(spark, [("u", i, float(i), 0.0, 1.0) for i in range(50)] + [("u", 3, 9.0, 1.0, 0.0)])
    joined = []
    join = lb.join_labels
    monkeypatch.setattr(lb, "join_labels", lambda f, *a, **b: (joined.append(f.count()), join(f, *a, **b))[1])
    assert lb.merged_dataset(df, ACT, strategy="auto").count() == 49 + 4
    assert joined == [2]
