"""Helpers shared by the operators: stored intermediate tables, text batches, word hashes, joins by id, components.

Intermediate tables are Parquet in the shared folder (``spark.checkpoint.dir``), so a lost executor costs a re-read and
never a recomputation of a different result. Python code works on Arrow batches inside Spark tasks and holds at most
one text slice (``SLICE_BYTES``) plus one document at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.session import shared_dir

SLICE_BYTES = 2 << 20
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: A side is broadcast up to this many 8- to 24-byte rows (counted first); beyond it the join is a shuffle join.
BROADCAST_ROWS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Python tasks get batches of ``BATCH_ROWS`` rows instead of Spark's 10,000 from here on, unless the session sets that
    size itself: a batch of long texts is held twice, by the executor and by its worker."""
    if spark.conf.get(BATCH_SETTING, "10000") == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    path = shared_dir(spark, f"llm-{name}")
    if _made.get() is not None:
        _made.get().append(path)
    return path


def removed(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def intermediate(spark: SparkSession):
    """Tables stored inside are removed at the end: what is kept must be written to a path made before, or read no more."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for name in made:
            removed(spark, name)


def kept(spark: SparkSession, name: str, make) -> DataFrame:
    """``make()`` stored and read back; the tables that it stored on the way are removed."""
    path = scratch(spark, name)
    with intermediate(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses read it instead of recomputing it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when its counted rows are at most ``limit``, else ``df`` (a shuffle join, split by AQE)."""
    return F.broadcast(df) if df.count() <= limit else df


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES):
    """Cut record batches into row slices of about ``max_bytes`` of text (one long row is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words between ASCII white space: row offsets (n + 1) and the words of all rows as a dictionary array.

    A null text is empty. ``lower`` maps A-Z only, as ``[^\\x20\\x09-\\x0D]+`` over a text with A-Z lowered.
    """
    texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(real)])[bounds]
    return kept, flat.filter(pa.array(real)).dictionary_encode()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around): equal inputs give equal outputs, other bits spread."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below ``n``."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(2 * n, base)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def range_hasher(values: np.ndarray):
    """A function (start, end) -> polynomial hash of ``values[start:end]`` for each range: equal contents hash equally
    wherever they stand."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return lambda start, end: mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hasher(values)(start, end)


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the UTF-8 bytes of all strings, from the array's buffers."""
    strings = strings.cast(pa.string()) if not pa.types.is_string(strings.type) else strings
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1].astype(np.int64)
    return ends - ends[0], np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of the UTF-8 bytes of each string, computed on the array's buffers."""
    ends, data = string_bytes(strings)
    return range_hashes(data.astype(np.uint64) + np.uint64(1), ends[:-1], ends[1:])


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the 64-bit hash of each word; each distinct word of the slice is hashed once."""
    bounds, words = split_words(texts, lower)
    if not len(words):
        return bounds, np.zeros(0, np.uint64)
    return bounds, string_hashes(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words of one sequence (len - k + 1 values)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > 8:
        start = np.arange(n)
        return range_hashes(words, start, start + k)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = mix(total * MIX + words[i:i + n])
    return total


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component the smallest node of its group.

    Each round maps every node to the smallest of itself and its neighbours and contracts the graph by that map, so the
    nodes that still have edges at least halve; edges and labels stay in Spark, stored after each round (no lineage).
    Groups of equal keys are pre-aggregated (min), so a hub costs one row per task.
    """
    left = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "cc-edges")
    label = None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        step = (left.select(F.col("u").alias("node"), F.col("v").alias("to"))
                .union(left.select(F.col("v").alias("node"), F.col("u").alias("to")))
                .groupBy("node").agg(F.min("to").alias("to"))
                .select("node", F.least("node", "to").alias("to")))
        step = stored(step, "cc-step")
        if label is None:
            label = step.select("node", F.col("to").alias("component"))
        else:
            m = step.select(F.col("node").alias("component"), "to")
            label = stored(label.join(m, "component", "left")
                           .select("node", F.coalesce("to", "component").alias("component")), "cc-label")
        su, sv = step.select(F.col("node").alias("u"), F.col("to").alias("u2")), step.select(F.col("node").alias("v"), F.col("to").alias("v2"))
        left = stored(left.join(su, "u").join(sv, "v").where("u2 <> v2")
                      .select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct(), "cc-edges")
    else:
        raise RuntimeError("components did not settle")
    if label is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = label.groupBy("component").agg(F.min("node").alias("least"))
    return stored(label.join(least, "component").select("node", F.col("least").alias("component")), "cc-out")
