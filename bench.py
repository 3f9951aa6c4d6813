"""Benchmark of the headline queries.

Runs each query of ``HEADLINE`` at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
and prints one JSON line: {"metric", "value" (total seconds), "unit", "queries": {name: seconds}, "sf", ...}.
Each query is executed in full with the no-op sink (every row computed, nothing collected to the driver).
One SQL query and one tiny ML fit run first, untimed, so JVM class loading is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ctxspark.plans import checked  # noqa: E402
from ctxspark.session import get_spark  # noqa: E402

HEADLINE = [
    "p5_labelled_dataset",      # J1 + P5: features joined with labels, argmax label
    "a1_column_stats",          # A1: mean / population std per feature
    "a3_column_modes",          # A3: most frequent value per feature
    "m1_anova_selection",       # M1: ANOVA F + percentile selection
    "m5_mixed_prep",            # M5: fit + transform of the mixed prep
    "e7_results_table",         # A6-E7: per-fold and pooled macro / micro / weighted results
    "c4_agreement_by_class",    # C4: correctness agreement per class
    "l13_stratified_fold_sizes",  # L13: stratified folds
    "l16_lr_predictions",       # L3/L16: one logistic-regression fold, trained and scored
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    # warm-up: JVM start, class loading (SQL and ML) and the first parquet footer reads are not part of any query
    checked.QUERIES["a4_class_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(200)
    LogisticRegression(maxIter=5).fit(emb.select(array_to_vector(F.col("embedding")).alias("features"),
                                                 F.col("label").cast("double").alias("label")))
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        checked.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "rows": rows, "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
