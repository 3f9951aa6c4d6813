"""Hard-negative mining with exact integer scores from a residue-number-system matrix product.

Components are floor(256 * x). A block of scores is multiplied in float32 once per prime: both matrices are reduced to symmetric
residues, and as many dimensions are multiplied at once as keep every sum below 2**24, so each product is exact modulo
its prime. Mixed-radix Chinese remaindering turns the residues into the signed score; as many primes are taken as the two blocks' largest
components ask for. Scores are exact whatever the components.

Two passes, each the anchors against all rows in blocks. Pass one meets anchors and rows of one label and keeps each anchor's best
positives; pass two meets anchors with all rows and keeps, for each positive, the first rows of another label inside the window of
scores that the positive sets. A pass cuts anchors into groups and rows into cells of ``CELL_BYTES``; each group meets each
cell in a task of its own, and Spark merges the few best of all cells. A row is copied once per group, an anchor once per cell.

Rows: a null label, a null vec_id, a null vector or one with a null, NaN or infinite component takes no part; shorter vectors count as
padded with zeros, empty ones score 0; rows that repeat a vec_id are rows of their own (each is another's candidate, never its
own, and an anchor of its own); equal scores go by vec_id; scores beyond a long count as its limit; an anchor without other rows of its label
gives no rows, a positive whose window holds no row gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm.common import small_side, stored

CELL_BYTES = 16 << 20
LEAST_CELL_ROWS = 2048
ANCHOR_BLOCK, ROW_BLOCK = 256, 2048
EXACT_SUM = 1 << 24             # float32 holds every integer below it
FIRST_PRIME = 1024
NONE = np.iinfo(np.int64).min
LIMIT = np.iinfo(np.int64).max


def primes() -> Iterator[int]:
    """The primes below ``FIRST_PRIME``, largest first, then those above it, smallest first (never exhausted in practice)."""
    is_prime = lambda n: all(n % d for d in range(3, int(n ** 0.5) + 1, 2))
    yield from (n for n in range(FIRST_PRIME - 1, 2, -2) if is_prime(n))
    yield from (n for n in range(FIRST_PRIME + 1, 2 * FIRST_PRIME, 2) if is_prime(n))


@cache
def moduli(bits: int) -> tuple[int, ...]:
    """Primes whose product holds every signed number of up to ``bits`` bits."""
    out, product = [], 1
    for p in primes():
        if product.bit_length() > bits + 1:
            return tuple(out)
        out.append(p)
        product *= p
    raise OverflowError(f"scores of {bits} bits")


def components(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(m, shift): floor(256 * x) as m * 256 ** shift, where m is an integer in float64 (256 * x itself may overflow)."""
    huge = np.abs(values) >= 2.0**52          # an integer already
    with np.errstate(over="ignore"):
        return np.where(huge, values, np.floor(values * 256.0)), huge


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """floor(256 * x) modulo the prime ``p``, symmetric around 0, in float32."""
    m, huge = components(values)
    r = np.fmod(m, p)
    if huge.any():
        r = np.where(huge, np.fmod(r * 256.0, p), r)
    return (r - p * np.rint(r / p)).astype(np.float32)


def largest(values: np.ndarray) -> int:
    """Largest absolute component as a Python integer, rounded up."""
    m, huge = components(values)
    if not m.size:
        return 0
    return max(int(np.abs(m[~huge]).max(initial=0)), 256 * int(np.abs(m[huge]).max(initial=0)))


class ResidueMatrix:
    """A matrix by its residues, made once per prime."""

    def __init__(self, values: np.ndarray):
        self.values, self.largest, self._made = values, largest(values), {}

    def modulo(self, p: int) -> np.ndarray:
        if p not in self._made:
            self._made[p] = residues(self.values, p)
        return self._made[p]


def score_bits(a: ResidueMatrix, b: ResidueMatrix) -> int:
    return (a.values.shape[1] * a.largest * b.largest).bit_length()


def scores(a: ResidueMatrix, b: ResidueMatrix, rows_a: slice, rows_b: slice) -> np.ndarray:
    """Exact inner products of two blocks as int64 (beyond a long: its limit)."""
    bits = score_bits(a, b)
    digits: list[np.ndarray] = []
    chosen = moduli(bits)
    for k, p in enumerate(chosen):
        left, right = a.modulo(p)[rows_a], b.modulo(p)[rows_b]
        chunk = max(1, EXACT_SUM // (p // 2) ** 2)
        s = np.zeros((left.shape[0], right.shape[0]))
        for at in range(0, left.shape[1], chunk):
            s += left[:, at:at + chunk] @ right[:, at:at + chunk].T
        # mixed radix: take off the digits known, divide by their primes, keep the symmetric remainder
        for d, q in zip(digits, chosen):
            s -= p * np.rint(s / p)
            s = (s - d) * float(pow(q, -1, p))
        digits.append(s - p * np.rint(s / p))
    whole = bits < 63
    total = np.zeros(digits[0].shape, np.int64 if whole else object) if digits else None
    for d, p in zip(reversed(digits), reversed(chosen)):
        d = d.astype(np.int64)
        total = total * p + (d if whole else d.astype(object))
    if whole:
        return total
    return np.minimum(np.maximum(total, -LIMIT), LIMIT).astype(np.int64)


def best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``k`` largest entries of each row above ``NONE``, earlier columns first among equals; ``s`` is used up."""
    lines = np.arange(len(s))
    out = []
    for _ in range(min(k, s.shape[1])):
        at = s.argmax(1)
        value = s[lines, at]
        real = value > NONE
        if not real.any():
            break
        out.append((lines[real], at[real], value[real]))
        s[lines, at] = NONE
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out))


def dense(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as a float64 matrix, shorter lists padded with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def blocks(n: int, size: int) -> list[slice]:
    return [slice(i, min(i + size, n)) for i in range(0, n, size)]


def rank(rows: DataFrame, keys: list, k: int, score: str, name: str, out: str) -> DataFrame:
    """The first ``k`` rows of each key by falling score, then by name, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    return rows.withColumn(out, F.row_number().over(order)).where(F.col(out) <= k)


def meet(anchors: DataFrame, rows: DataFrame, key: str, dim: int, run, schema: str) -> DataFrame:
    """``run`` over each (anchor group, row cell) of each value of ``key``; both sides cut by bytes, per key value.

    ``rows`` and ``anchors`` have (row, vec_id, label, v); anchors may have ``positives``, too.
    """
    spark = rows.sparkSession
    cell_rows = max(LEAST_CELL_ROWS, CELL_BYTES // (8 * dim))
    # small inputs are spread over the cores; the cells' number changes no result
    spread = -(-rows.count() // max(1, spark.sparkContext.defaultParallelism))
    per_cell = min(cell_rows, max(LEAST_CELL_ROWS, spread))
    parts = (rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / per_cell).cast("int").alias("cells"))
             .join(anchors.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("groups")), key))
    parts = small_side(stored(parts, "negatives-parts"))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    positives = F.col("positives") if "positives" in anchors.columns else F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>")
    asked = (anchors.join(parts, key).select(F.col(key).alias("k"), part("groups").alias("g"), each("cells").alias("c"), F.lit(True).alias("ask"),
                                             "row", "vec_id", "label", "v", positives.alias("positives")))
    given = (rows.join(parts, key).select(F.col(key).alias("k"), each("groups").alias("g"), part("cells").alias("c"), F.lit(False).alias("ask"),
                                          "row", "vec_id", "label", "v", F.lit(None).cast(asked.schema["positives"].dataType).alias("positives")))

    def task(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ask = table.column("ask")
        left, right = table.filter(ask), table.filter(pc.invert(ask)).sort_by([("vec_id", "ascending"), ("row", "ascending")])
        found = run(left, right) if left.num_rows and right.num_rows else []
        return pa.table({name: pa.array(np.concatenate([f[name] for f in found]) if found else [], pa.int64()) for name in names})

    names = [part.split()[0] for part in schema.split(", ")]
    return asked.unionByName(given).groupBy("k", "g", "c").applyInArrow(task, schema)


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part."""
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"),
                          F.monotonically_increasing_id().alias("row"))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~bad)


def mine(vectors: DataFrame, label: Column, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose vec_id is divisible by ``every`` and
    each of its first ``n_positives`` rows of the same label, the first ``n_negatives`` rows of another label whose score is between ``low`` and ``high``
    per cent of the positive's."""
    rows = stored(usable(vectors, label).withColumn("all", F.lit(0)), "negatives-rows")
    dim = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    anchors = rows.where(F.col("vec_id") % every == 0)

    def positives(left: pa.Table, right: pa.Table) -> list[dict]:
        a, b = ResidueMatrix(dense(left.column("v"), dim)), ResidueMatrix(dense(right.column("v"), dim))
        arow, aid = left.column("row").to_numpy(), left.column("vec_id").to_numpy()
        brow, bid = right.column("row").to_numpy(), right.column("vec_id").to_numpy()
        found = []
        for i in blocks(len(arow), ANCHOR_BLOCK):
            own = []
            for j in blocks(len(brow), ROW_BLOCK):
                s = scores(a, b, i, j)
                s[arow[i][:, None] == brow[j][None, :]] = NONE
                line, at, value = best(s, n_positives)
                own.append((line, bid[j][at], value))
            line, other, value = (np.concatenate(x) for x in zip(*own))
            keep = first_of(line, other, value, n_positives)
            line, other, value = line[keep], other[keep], value[keep]
            found.append({"row": arow[i][line], "vec_id": aid[i][line], "positive_id": other, "positive_score": value})
        return found

    near = meet(anchors, rows, "label", dim, positives, "row long, vec_id long, positive_id long, positive_score long")
    near = rank(near, ["row"], n_positives, "positive_score", "positive_id", "at")
    lists = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "positive_id", "positive_score"))).alias("p")).select(
        "row", F.transform("p", lambda x: F.struct(x["positive_id"].alias("positive_id"), x["positive_score"].alias("positive_score"))).alias("positives"))
    asked = stored(anchors.join(lists, "row"), "negatives-anchors")

    def negatives(left: pa.Table, right: pa.Table) -> list[dict]:
        a, b = ResidueMatrix(dense(left.column("v"), dim)), ResidueMatrix(dense(right.column("v"), dim))
        arow, aid, alabel = (left.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        bid, blabel = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
        lists = left.column("positives").to_pylist()
        # windows of whole scores; an anchor with fewer positives gets empty ones
        floor = np.full((len(lists), n_positives), LIMIT)
        top, pid, pscore = np.full_like(floor, NONE), np.zeros_like(floor), np.zeros_like(floor)
        for n, ps in enumerate(lists):
            for m, p in enumerate(ps):
                pid[n, m], pscore[n, m] = p["positive_id"], p["positive_score"]
                floor[n, m], top[n, m] = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
        found = []
        for i in blocks(len(arow), ANCHOR_BLOCK):
            own = [[] for _ in range(n_positives)]
            for j in blocks(len(bid), ROW_BLOCK):
                s = scores(a, b, i, j)
                s[alabel[i][:, None] == blabel[j][None, :]] = NONE
                for m in range(n_positives):
                    inside = (s <= top[i][:, m, None]) & (s >= floor[i][:, m, None])
                    line, at, value = best(np.where(inside, s, NONE), n_negatives)
                    own[m].append((line, bid[j][at], value))
            for m in range(n_positives):
                line, other, value = (np.concatenate(x) for x in zip(*own[m]))
                keep = first_of(line, other, value, n_negatives)
                line, other, value = line[keep], other[keep], value[keep]
                found.append({"row": arow[i][line], "at": np.full(len(line), m), "anchor_id": aid[i][line], "positive_id": pid[i][line, m],
                              "positive_score": pscore[i][line, m], "negative_id": other, "negative_score": value})
        return found

    far = meet(asked, rows, "all", dim, negatives,
               "row long, at long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    far = rank(far, ["row", "at"], n_negatives, "negative_score", "negative_id", "rank")
    return far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def first_of(line: np.ndarray, name: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` first entries of each line by falling score, then by name."""
    if not len(line):
        return np.zeros(0, np.int64)
    order = np.lexsort((name, -score, line))
    starts = np.flatnonzero(np.diff(line[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]
