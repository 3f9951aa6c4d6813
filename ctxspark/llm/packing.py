"""Harmonic packing of token ids into sequences of a fixed capacity.

A piece of length l belongs to class k = capacity // l and a bin of class k takes k pieces, whatever workers they come
from: each worker counts its own pieces of a class, and the counts alone give every piece its bin. A document is cut
into whole capacities, and its rest only where keeping it whole would fill its class's bins below ``min_fill``: then a
piece of capacity // (k + 1), which fills a bin of the next class, is cut off. The last, incomplete bin of each class
(at most k - 1 pieces for k up to the capacity, about 10,000 pieces at 2048 however large the input) joins a common
stream that is cut at the capacity; the stream's end is cut into sequences of power-of-two length, which need no padding.

Inputs: a null text is an empty document (its end id alone); null or repeated doc_ids keep a row for each piece of each
row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm.common import slices, stored
from ctxspark.llm.tokens import word_encoder


def cut(n: int, capacity: int, min_fill: float) -> list[tuple[int, int, int]]:
    """(start, length, class) of a document's pieces; together they hold each of the ``n`` ids once."""
    out = [(at, capacity, 1) for at in range(0, n - n % capacity, capacity)]
    at, left = n - n % capacity, n % capacity
    while left:
        k = capacity // left
        size = left
        if k * left < min_fill * capacity:
            k += 1
            size = capacity // k
        out.append((at, size, k))
        at, left = at + size, left - size
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, min_fill: float) -> DataFrame:
    """The cut documents: (doc_id, start, length, doc_tokens, k, part, seq, ids_crc32, ids), seq counting the class in its
    task. ``ids`` are little-endian, two bytes each where all of the piece fit, else four."""
    def run(batches):
        encoder = word_encoder(vocabulary)
        part, counts = TaskContext.get().partitionId(), {}
        for piece in slices(batches):
            sizes, ids = encoder.encode(piece.column("text"))
            ends = np.cumsum(sizes)
            rows = []
            for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), ends - sizes, ends):
                doc = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for start, size, k in cut(len(doc), capacity, min_fill):
                    seq = counts[k] = counts.get(k, -1) + 1
                    rows.append((doc_id, start, size, len(doc), k, part, seq, *coded(doc[start:start + size])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "start", "length", "doc_tokens", "k", "part", "seq", "ids_crc32", "ids"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
SCHEMA = "doc_id long, start long, length long, doc_tokens long, k int, part int, seq long, ids_crc32 long, ids binary"
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def coded(ids: np.ndarray) -> tuple[int, bytes]:
    """The checksum of the ids as little-endian uint32, and their bytes at the narrowest width."""
    return zlib.crc32(ids.astype("<u4").tobytes()), ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def decoded(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, min_fill: float = 0.97,
         with_ids: bool = True) -> DataFrame:
    """Pack ``docs`` (doc_id, text): (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece.

    Without ``with_ids`` the ids of whole bins are not read again, let alone shuffled.
    """
    cutted = stored(pieces(docs, vocabulary, end_id, capacity, min_fill), "packing-pieces")
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (cutted.groupBy("k", "part").agg(F.count("*").alias("n"))
              .select("k", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                      F.sum("n").over(Window.partitionBy("k")).alias("all"))
              .withColumn("full", F.expr("all div k * k")))
    counts = stored(counts, "packing-counts")
    bins = (counts.groupBy("k").agg(F.expr("max(full) div k").alias("bins"))  # at most ``capacity`` rows
            .select("k", "bins", F.coalesce(F.sum("bins").over(Window.orderBy("k").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    bins = stored(bins, "packing-bins")
    n_bins = bins.agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]

    whole = (cutted.join(counts.select("k", "part", "first", "full"), ["k", "part"])
             .withColumn("idx", F.col("first") + F.col("seq")).where("idx < full")
             .join(F.broadcast(bins.select("k", "base")), "k")
             .withColumn("sequence_id", F.expr("base + idx div k")))
    inside = Window.partitionBy("sequence_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))

    # The last bins: at most k - 1 pieces of a class, in as many parts at most.
    ends = counts.where("first + n > full").select("k", "part", "first", "full")
    rest = (cutted.join(F.broadcast(ends), ["k", "part"]).withColumn("idx", F.col("first") + F.col("seq"))
            .where("idx >= full").select("doc_id", "start", "length", "doc_tokens", "k", "idx", "ids"))

    def stream(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        total = sum(r["length"] for r in rows)
        edges = list(range(0, total - total % capacity + 1, capacity))
        left = total % capacity
        while left:
            edges.append(edges[-1] + (1 << left.bit_length() - 1))
            left -= 1 << left.bit_length() - 1
        out, at, number = [], 0, 0
        for r in rows:
            done, ids = 0, decoded(r["ids"], r["length"])
            while done < r["length"]:
                while edges[number + 1] <= at:
                    number += 1
                size = min(r["length"] - done, edges[number + 1] - at)
                crc, data = coded(ids[done:done + size])
                out.append((r["doc_id"], r["start"] + done, size, crc, r["doc_tokens"], n_bins + number, at - edges[number], data))
                done, at = done + size, at + size
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 7 + [pa.binary()])],
                                             names=OUT)

    rest = rest.repartition(1).sortWithinPartitions("k", "idx").mapInArrow(
        stream, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    names = OUT if with_ids else OUT[:-1]
    return whole.select(*names).unionByName(rest.select(*names))


def packing_digest(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of :func:`pack`."""
    return pack(docs, vocabulary, end_id, capacity, with_ids=False)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, a row each: (sequence_id, length, ids as little-endian uint32, doc_ids, starts, lengths), the last three a
    list with one entry per piece in its order: whose ids they are, from which of the document's ids on, and how many.

    A sequence is a group of at most its capacity's pieces.
    """
    def join(batches):
        for b in batches:
            parts = b.column("parts").to_pylist()
            ids = [b"".join(decoded(p["ids"], p["length"]).tobytes() for p in of) for of in parts]
            lists = [pa.array([[p[c] for p in of] for of in parts], pa.list_(pa.int64())) for c in ("doc_id", "start", "length")]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), b.column("length"), pa.array(ids, pa.binary()), *lists],
                                             names=["sequence_id", "length", "ids", "doc_ids", "starts", "lengths"])

    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    return (packed.groupBy("sequence_id")
            .agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(piece)).alias("parts"))
            .mapInArrow(join, "sequence_id long, length long, ids binary, doc_ids array<long>, starts array<long>, lengths array<long>"))
