"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are cut into blocks of consecutive vec_ids. A block holds its forward index (the component matrix) and the
largest and smallest value of each component (its term maxima). For a query, the sum over components of the larger of
weight times maximum and weight times minimum bounds every score of the block from above. A query visits blocks in the
order of falling bounds and stops when the bound falls below its k-th best score so far.

Queries are grouped and blocks are gathered into cells of bounded size; every query group meets every cell once, in its
own task, and the best k of the cells are merged per query. That is the query set against all rows, in blocks.

Rows: vectors that are null or hold a null, NaN or infinite component take no part; shorter vectors count as padded with
zeros; rows that repeat a vec_id are rows of their own (each is another's candidate, never its own); a null vec_id takes
no part; ties go to the smaller vec_id; scores beyond a long count as its limit; fewer than k candidates give fewer rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm.common import stored

BLOCK = 256
CELL_ROWS = 1 << 15
GROUP_ROWS = 1 << 12


def matrix(values: list, dim: int) -> np.ndarray:
    """Integer components as float where every inner product stays exact, else as Python integers."""
    out = np.zeros((len(values), dim))
    for i, v in enumerate(values):
        out[i, :len(v)] = v
    out = np.floor(out * 256.0)
    if np.abs(out).max(initial=0) >= 2.0**22:
        out = np.array([[int(x) for x in row] for row in out], object).reshape(len(values), dim)
    return out


def typed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in the narrowest kind in which their inner products are exact."""
    if a.dtype == object or b.dtype == object:
        exact = lambda m: m if m.dtype == object else m.astype(np.int64).astype(object)
        return exact(a), exact(b)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**24:
        return a.astype(np.float32), b.astype(np.float32)
    return a, b


def search(queries: np.ndarray, q_row: np.ndarray, rows: np.ndarray, row: np.ndarray, vec: np.ndarray, k: int):
    """Best ``k`` of ``rows`` for each query: (query index, vec_id, score) arrays. ``vec`` ascends within blocks."""
    queries, rows = typed(queries, rows)
    exact = queries.dtype == object
    starts = np.arange(0, len(rows), BLOCK)
    high = np.stack([rows[s:s + BLOCK].max(0) for s in starts])
    low = np.stack([rows[s:s + BLOCK].min(0) for s in starts])
    zero = queries * 0
    bounds = np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    n, worst = len(queries), None
    kind = object if exact else np.float64
    score = np.full((n, k), -np.inf, kind)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    for step in range(len(starts)):
        block = order[:, step]
        worst = score[:, k - 1]
        active = np.flatnonzero(bounds[np.arange(n), block] >= worst)
        if not len(active):
            break
        active = active[np.argsort(block[active], kind="stable")]
        cuts = np.flatnonzero(np.diff(block[active])) + 1
        for group in np.split(active, cuts):
            s = starts[block[group[0]]]
            own = slice(s, min(s + BLOCK, len(rows)))
            got = (queries[group] @ rows[own].T).astype(kind)
            if exact:
                got = np.minimum(np.maximum(got, -2**63), 2**63 - 1)
            got[q_row[group][:, None] == row[own][None, :]] = -np.inf
            both = np.concatenate([score[group], got], 1)
            names = np.concatenate([ids[group], np.broadcast_to(vec[own], got.shape)], 1)
            best = np.lexsort((names, -both), axis=1)[:, :k]
            score[group], ids[group] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
    q, r = np.nonzero(score > -np.inf)
    return q, ids[q, r], score[q, r]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows by integer inner product for each row whose id is divisible
    by ``every``; components are floor(256 * x)."""
    spark = vectors.sparkSession
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists(vector_column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = (vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).where(~bad)
            .select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row")))
    kept = stored(kept, "topk-vectors")
    size = kept.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"),
                    F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    cells, groups, dim = -(-size["n"] // CELL_ROWS) or 1, -(-size["q"] // GROUP_ROWS) or 1, size["dim"] or 1
    cells = max(cells, min(spark.sparkContext.defaultParallelism, -(-size["n"] // (4 * BLOCK))))
    cuts = kept.agg(F.percentile_approx("vec_id", [i / cells for i in range(1, cells)], 100_000)).first()[0] if cells > 1 else []
    cuts = sorted(set(cuts or []))

    # Each row goes once to every query group's cell of its vec_id range; each query once to every cell.
    cell = F.lit(0) if not cuts else F.aggregate(F.lit(cuts), F.lit(0), lambda a, x: a + F.when(F.col("vec_id") > x, 1).otherwise(0))
    rows = kept.withColumn("cell", cell).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = (kept.where(F.col("vec_id") % every == 0).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
             .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(cuts))))))
    both = (asked.select("group", "cell", F.lit(True).alias("ask"), "vec_id", "row", "v")
            .unionByName(rows.select("group", "cell", F.lit(False).alias("ask"), "vec_id", "row", "v")))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        ask = table.column("ask").to_numpy()
        row, vec = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
        m = matrix(table.column("v").to_pylist(), dim)
        out = {c: [] for c in ("row", "query_id", "vec_id", "score")}
        if ask.any() and not ask.all():
            q, ids, score = search(m[ask], row[ask], m[~ask], row[~ask], vec[~ask], k)
            out = {"row": row[ask][q], "query_id": vec[ask][q], "vec_id": ids,
                   "score": [int(s) for s in score]}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    found = both.groupBy("group", "cell").applyInArrow(run, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
