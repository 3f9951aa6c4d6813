"""Per-user CSVs with differing headers, fold lists, dataset / model / results storage."""

import os

from pyspark.sql import functions as F

from ctxspark.sources import sensor_csv as sc
from ctxspark.sources import store


def _write(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def test_csv_headers_differ(spark, tmp_dir):
    d = os.path.join(tmp_dir, "users")
    os.makedirs(d)
    _write(f"{d}/AAA.features_labels.csv", "timestamp,acc:x,label:SITTING,discrete:p\n10,1.5,1,0\n20,,0,1\n")
    _write(f"{d}/BBB.x.y.csv", "discrete:p,timestamp,label:SITTING,gyro:z\n1,30,,2.5\n")
    df = sc.read_user_csvs(spark, d)
    got = {(r.uuid, r.timestamp): r.asDict() for r in df.collect()}
    assert set(got) == {("AAA", 10), ("AAA", 20), ("BBB", 30)}
    assert got[("AAA", 10)]["acc:x"] == 1.5 and got[("AAA", 10)]["gyro:z"] is None
    assert got[("AAA", 20)]["acc:x"] is None and got[("AAA", 20)]["discrete:p"] == 1.0
    assert got[("BBB", 30)]["gyro:z"] == 2.5 and got[("BBB", 30)]["discrete:p"] == 1.0
    assert got[("BBB", 30)]["label:SITTING"] is None
    assert dict(df.dtypes)["timestamp"] == "bigint"


def test_csv_real_cells(spark, tmp_dir):
    d = os.path.join(tmp_dir, "users")
    os.makedirs(d)
    _write(f"{d}/U1.csv", 'timestamp,"acc,x",label_source,label:SITTING\n10,nan,"by, hand",1\n20,oops,-1,NA\n\n30.0, 1e3 ,,0\n')
    _write(f"{d}/U2.csv", 'label_source,timestamp\nnone,5\n')
    _write(f"{d}/notes.txt", "timestamp\n1\n")
    got = {(r["uuid"], r["timestamp"]): r.asDict() for r in sc.read_user_csvs(spark, d, bad_cells=True).collect()}
    assert set(got) == {("U1", 10), ("U1", 20), ("U1", 30), ("U2", 5)}
    one, two, three = got["U1", 10], got["U1", 20], got["U1", 30]
    assert (one["acc,x"], one["label_source"], one["label:SITTING"], one["bad_cells"]) == (None, "by, hand", 1.0, 0)
    assert (two["acc,x"], two["label_source"], two["label:SITTING"], two["bad_cells"]) == (None, "-1", None, 1)
    assert (three["acc,x"], three["label_source"], three["bad_cells"]) == (1000.0, None, 0)
    assert got["U2", 5]["label_source"] == "none" and got["U2", 5]["acc,x"] is None


def test_csv_records_that_span_lines(spark, tmp_dir):
    d = os.path.join(tmp_dir, "users")
    os.makedirs(d)
    _write(f"{d}/U1.csv", 'timestamp,label_source,a\n1,"two\nlines",1.5\n2,"one, ""quoted""",2.5\n3,"a\n\n,""b\n4,x,9",3.5\n5,plain,4.5\n')
    _write(f"{d}/U2.csv", 'timestamp,a,"label_source"\n7,1,"even ""quotes"""\n')
    _write(f"{d}/U3.csv", 'label_source,"odd\nname",timestamp\n"x\ny",2,8\n')
    got = {(r["uuid"], r["timestamp"]): r.asDict() for r in sc.read_user_csvs(spark, d, bad_cells=True).collect()}
    assert {k: v["label_source"] for k, v in got.items()} == {
        ("U1", 1): "two\nlines", ("U1", 2): 'one, "quoted"', ("U1", 3): 'a\n\n,"b\n4,x,9', ("U1", 5): "plain", ("U2", 7): 'even "quotes"', ("U3", 8): "x\ny"}
    assert got["U1", 3]["a"] == 3.5 and got["U3", 8]["odd\nname"] == 2.0 and not any(v["bad_cells"] for v in got.values())


def test_csv_dataset_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("007", 1, 0.5, 1.0, 2, "walk"), ("u", 2, None, 0.0, 0, "sit")],
                               "uuid string, timestamp long, a double, discrete_b double, label int, label_name string")
    back = store.read_dataset(spark, store.write_dataset(df, f"{tmp_dir}/csv", 40, fmt="csv"), fmt="csv")
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_fold_lists(spark, tmp_dir):
    d = os.path.join(tmp_dir, "cv")
    os.makedirs(d)
    _write(f"{d}/fold_0_train_android_uuids.txt", "u1\n\n u2 \n")
    _write(f"{d}/fold_0_train_iphone_uuids.txt", "u3\nu3\n")
    _write(f"{d}/fold_0_test_android_uuids.txt", "u4\n")
    _write(f"{d}/fold_1_test_iphone_uuids.txt", "u1\n")
    m = sc.read_fold_lists(spark, d)
    rows = sorted(tuple(r) for r in m.collect())
    assert rows == sorted([(0, "train", "android", "u1"), (0, "train", "android", "u2"), (0, "train", "iphone", "u3"),
                           (0, "train", "iphone", "u3"), (0, "test", "android", "u4"), (1, "test", "iphone", "u1")])
    _write(f"{d}/train.txt", "a\nb\n")
    _write(f"{d}/test.txt", "c\n")
    single = sorted(tuple(r) for r in sc.read_fold_lists(spark, d, single_split=True).collect())
    assert single == [(0, "test", None, "c"), (0, "train", None, "a"), (0, "train", None, "b")]


def test_dataset_and_results_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("u", 1, 0.5, 1.0, 2)], "uuid string, timestamp long, a double, discrete_b double, label long")
    p = store.write_dataset(df, f"{tmp_dir}/dataset", 40)
    assert p.endswith("pct=40")
    back = store.read_dataset(spark, p)
    assert dict(back.dtypes)["label"] == "int" and back.count() == 1
    res = spark.createDataFrame([("macro", 0.5)], "`Test type` string, F1 double")
    path = f"{tmp_dir}/results"
    store.append_table(res, path, {"model": "m", "fold": 0})
    store.append_table(res, path, {"model": "m", "fold": 1})
    assert store.read_table(spark, path).filter(F.col("model") == "m").count() == 2


def test_write_folds(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "uuid string, timestamp long, label int")
    mem = spark.createDataFrame([(0, "train", "android", "a"), (0, "test", "iphone", "b")],
                                "fold int, split string, source string, uuid string")
    out = store.write_folds(df, mem, f"{tmp_dir}/folds", export=True)
    ex = spark.read.parquet(out["export"])
    assert sorted((r.fold, r.split, r.uuid) for r in ex.collect()) == [(0, "test", "b"), (0, "train", "a")]
    single = spark.read.parquet(store.write_single_split(df, mem, f"{tmp_dir}/s"))
    assert "timestamp" not in single.columns and single.count() == 2


def test_fold_export_sorts_nothing(spark, tmp_dir):
    """The export's tasks keep a file of each of the 6 (fold, split) open, below the number that makes Spark sort; the setting is put back."""
    df = spark.range(4000).select((F.col("id") % 20).cast("string").alias("uuid"), F.col("id").alias("timestamp"), F.lit(0).alias("label"))
    mem = df.select("uuid").distinct().select(F.explode(F.array(*map(F.lit, range(3)))).alias("fold"), F.when(
        F.col("uuid").cast("int") % 3 == F.col("fold"), "test").otherwise("train").alias("split"), F.lit("a").alias("source"), "uuid")
    name, seen, conf = "spark.sql.maxConcurrentOutputFileWriters", [], type(spark.conf)
    before, plain = spark.conf.get(name), conf.set
    conf.set = lambda self, key, value: (seen.append((key, value)), plain(self, key, value))[1]
    try:
        out = store.write_folds(df, mem, f"{tmp_dir}/folds", export=True)
    finally:
        conf.set = plain
    back = spark.read.parquet(out["export"])
    assert back.count() == 12000 and back.groupBy("fold", "split").count().count() == 6
    assert seen[0] == (name, "7") and spark.conf.get(name) == before


def test_csv_rows_come_from_stored_records(spark, tmp_dir):
    """Files are read and their broken lines joined once; headers and rows come from the stored records."""
    os.makedirs(f"{tmp_dir}/u")
    _write(f"{tmp_dir}/u/a.csv", 'timestamp,x,label_source\n1,2.5,"one\ntwo"\n2,nan,three\n')
    _write(f"{tmp_dir}/u/b.csv", "x,timestamp\n7,3\n")
    out = sc.read_user_csvs(spark, f"{tmp_dir}/u")
    assert not [f for f in out.inputFiles() if f.endswith(".csv")]
    assert sorted((r.uuid, r.timestamp, r.x, r.label_source) for r in out.collect()) == [
        ("a", 1, 2.5, "one\ntwo"), ("a", 2, None, "three"), ("b", 3, 7.0, None)]
