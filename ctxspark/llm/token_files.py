"""Token-id files with Simple-8b word-aligned coding.

A 64-bit word holds a selector (top 4 bits) and as many ids as fit its 60 payload bits at the selector's width; an id of
2^60 or more is an escape: its word holds the place of the full value in the block's escape list. Ids are coded in coding
blocks of ``CHUNK`` ids whose word offsets are kept, so a reader can start at any coding block and decodes all words of
one selector in one array operation.

File format: Parquet rows ``(bucket, block, ids_before, doc_ids, doc_sizes, payload)`` under ``bucket=<n>`` folders.
Buckets are ranges of doc_id in ascending order, of about ``BUCKET_BYTES`` of text each, blocks follow each other in a bucket, documents in a block by doc_id.
``payload`` is: 4 little-endian uint32 (values, coding blocks, words, escapes), coding-block word offsets (uint32),
words (uint64), escapes (uint64).

Inputs: a null text is an empty document (its end id alone); a null doc_id sorts first; rows that repeat a doc_id keep
a row each, ordered by the checksum of their ids; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm.common import scratch, slices, small_side
from ctxspark.llm.tokens import word_encoder

#: Fixed values of the format: (ids in a word, bits of an id), by selector; selector 14 is unused and 15 an escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
             (2, 30), (1, 60))
ESCAPE = 15
CHUNK = 1024
BLOCK_IDS = 1 << 16
HEADER = 4
#: Text of a bucket, a range of doc_ids that one task sorts and codes: as many buckets as the texts' bytes ask for.
BUCKET_BYTES = 32 << 20


def encode_block(values: np.ndarray) -> bytes:
    """Simple-8b of unsigned integers: in each coding block the widest-count selector that fits is taken, word by word."""
    values = values.astype(np.uint64, copy=False)
    n = len(values)
    chunks = -(-n // CHUNK)
    if not n:
        return np.zeros(HEADER, "<u4").tobytes()
    room = np.minimum(CHUNK - np.arange(n) % CHUNK, n - np.arange(n)).astype(np.int32)
    choice = np.full(n, ESCAPE, np.uint8)
    top = int(values.max())
    narrow = values.astype(np.uint32) if top < 1 << 32 else values
    wide = np.zeros(n + 1, np.int32)
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[s]
        if count > n:
            break
        fits = room[:n - count + 1] >= count
        if top >> bits:
            np.cumsum(narrow >= narrow.dtype.type(1 << bits), out=wide[1:])
            fits &= wide[count:] == wide[:n - count + 1]
        if s < 7 and not fits.any():
            break
        choice[:n - count + 1][fits] = s
    takes = np.array([c for c, _ in SELECTORS] + [0, 1])[choice]
    steps, here = [], np.arange(0, n, CHUNK)
    ends = np.minimum(here + CHUNK, n)
    while len(here):
        steps.append(here)
        here = here + takes[here]
        going = here < ends
        here, ends = here[going], ends[going]
    first = np.sort(np.concatenate(steps))
    chosen = choice[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(chosen == s)
        for i in range(count if len(rows) else 0):
            words[rows] |= values[first[rows] + i] << np.uint64(i * bits)
    rows = np.flatnonzero(chosen == ESCAPE)
    words[rows] |= np.arange(len(rows), dtype=np.uint64)
    escapes = values[first[rows]]
    offsets = np.searchsorted(first, np.arange(0, n, CHUNK))
    return (np.array([n, chunks, len(words), len(escapes)], "<u4").tobytes() + offsets.astype("<u4").tobytes()
            + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes())


def decode_block(data: bytes, first_chunk: int = 0) -> np.ndarray:
    """The ids of a block from coding block ``first_chunk`` on, as uint64."""
    n, chunks, size, n_escapes = (int(x) for x in np.frombuffer(data, "<u4", HEADER))
    if first_chunk >= chunks:
        return np.zeros(0, np.uint64)
    at = 4 * HEADER
    offsets = np.frombuffer(data, "<u4", chunks, at)
    words = np.frombuffer(data, "<u8", size, at + 4 * chunks)[int(offsets[first_chunk]):]
    escapes = np.frombuffer(data, "<u8", n_escapes, at + 4 * chunks + 8 * size)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    takes = np.array([c for c, _ in SELECTORS] + [0, 1])[selector]
    start = np.cumsum(takes) - takes
    out = np.zeros(n - first_chunk * CHUNK, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(selector == s)
        for i in range(count if len(rows) else 0):
            out[start[rows] + i] = (words[rows] >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)
    rows = np.flatnonzero(selector == ESCAPE)
    out[start[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def _encoded(docs: DataFrame, vocabulary: str, end_id: int, bounds: list[int]) -> DataFrame:
    def run(batches):
        encoder = word_encoder(vocabulary)
        edges = np.array(bounds, np.int64)
        for part in slices(batches):
            sizes, ids = encoder.encode(part.column("text"))
            ends = np.cumsum(sizes)
            doc_ids = part.column("doc_id")
            rows = []
            for a, b in zip(ends - sizes, ends):
                doc = np.append(ids[a:b], np.uint32(end_id))
                rows.append((doc.astype("<u2") if doc.max() < 1 << 16 else doc.astype("<u4")).tobytes())
            known = doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(edges, known, "left"), pa.int32()), doc_ids,
                 pa.array(sizes + 1, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket int, doc_id long, n int, ids binary")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, buckets: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the token files under ``path``, ascending by doc_id.

    The scan encodes; the ids of a doc_id range (cut at quantiles of doc_id alone) meet in one task, which sorts them on
    disk if need be and codes them block by block.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(1, -(-size // BUCKET_BYTES))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / buckets for i in range(1, buckets)], 100_000)
                       .alias("q")).first()["q"] if buckets > 1 else None
    bounds = sorted(set(cuts or []))

    def pack(batches):
        bucket, block, before = -1, 0, 0
        doc_ids, sizes, parts, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([encode_block(np.concatenate(parts))], pa.binary())],
                names=["bucket", "block", "ids_before", "doc_ids", "doc_sizes", "payload"])

        for batch in batches:
            for b, d, n, x in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "ids"))):
                if b != bucket or held >= BLOCK_IDS:
                    if held:
                        yield row()
                        block, before = block + 1, before + held
                    doc_ids, sizes, parts, held = [], [], [], 0
                    if b != bucket:
                        bucket, block, before = b, 0, 0
                doc_ids.append(d)
                sizes.append(n)
                parts.append(np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4"))
                held += n
        if held:
            yield row()

    (_encoded(docs, vocabulary, end_id, bounds)
     .repartitionById(buckets, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), F.crc32("ids"))
     .mapInArrow(pack, "bucket int, block int, ids_before long, doc_ids array<long>, doc_sizes array<int>, payload binary")
     .write.partitionBy("bucket").parquet(path))


def read_token_files(spark, path: str) -> DataFrame:
    """The ids back: (bucket, ids_before in the bucket, doc_id, n_tokens, ids as little-endian uint32)."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = decode_block(one["payload"]).astype("<u4")
                ends = np.cumsum(np.array(one["doc_sizes"], np.int64))
                starts = ends - one["doc_sizes"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["bucket"]] * len(ends), pa.int32()), pa.array(starts + one["ids_before"], pa.int64()),
                     pa.array(one["doc_ids"], pa.int64()), pa.array(ends - starts, pa.int64()),
                     pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                    names=["bucket", "ids_before", "doc_id", "n_tokens", "ids"])

    schema = "block int, ids_before long, doc_ids array<long>, doc_sizes array<int>, payload binary, bucket int"
    return (spark.read.schema(schema).parquet(path).select("bucket", "ids_before", "doc_ids", "doc_sizes", "payload")
            .mapInArrow(run, "bucket int, ids_before long, doc_id long, n_tokens long, ids binary"))


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write, read back and digest: (doc_id, start, n_tokens, ids_crc32). ``start`` needs one row per bucket only."""
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    schema = "doc_sizes array<int>, bucket int"
    sums = (spark.read.schema(schema).parquet(path).groupBy("bucket")
            .agg(F.sum(F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")))
    bases = sums.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return (read_token_files(spark, path).select("bucket", "ids_before", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
            .join(small_side(bases), "bucket")
            .select("doc_id", (F.col("base") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32"))
