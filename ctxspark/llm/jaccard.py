"""Exact n-gram Jaccard join and its components: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

1. Each text becomes its set of k-word shingles (64-bit hashes, sorted). Equal sets are one class from here on.
2. Shingles are ordered rarest first by a table of hashed counters over all texts (``COUNTERS`` of them, whatever the
   input: the order only decides how much work there is, any order gives the same links). Two sets of sizes n and m that
   link at similarity t share a shingle among the first n - ceil(t n) + 1 of one and the first m - ceil(t m) + 1 of the
   other, so each class is entered under those shingles. Entries of one shingle are a tile, cut into bands of sizes that
   can link; a shingle of one class makes no tile.
3. A signature is a bitmap of ``BITS`` bits in which each shingle flips the bit of its hash: two sets differ in at least
   as many shingles as their bitmaps differ in bits, which bounds their overlap from above. Sets too large for it have a
   second one of n to 4 n bits, looked at only where the first admits a pair.
4. In each tile the pairs that the size and bitmap bounds admit only say which classes must be looked at there: such a
   class sends its sorted array to that tile, and the pair is verified in it. A pair belongs to the tile of its first
   shared shingle in that order, so it is verified once, whatever the number of tiles it shares; classes that share one of
   their first ``EARLY`` shingles before a tile's own needn't be looked at in it.
5. No pair leaves a tile: a task prints the edges of a spanning forest of the links it finds and the number of links of
   each class, rows in proportion to the tile. Components of the edges are contracted in Spark, links are summed up.

Equal texts are one class and aren't expanded. Only classes that a tile wants have their arrays made again and moved.

Rows: a null or empty text, or one of white space, has an empty set, links with nothing and is its own component; with
fewer than k words the whole sequence is the one shingle; repeated rows and repeated doc_ids are rows of one or more
classes each; a null doc_id joins its component but never names it; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import components, gram_hashes, kept, mix, slices, small_batches, small_side, stored, word_hashes

COUNTERS = 1 << 20
PIECES = 64
BITS = 512
EARLY = 8
#: From this band on sets may have a bitmap wider than ``BITS``.
WIDE_BAND = 4
BAND_BASE = 4.0
#: A tile of more rows, or of more shingles in its classes' sets, is cut into chunks of about so many; its cells are pairs of chunks.
HOT_ROWS = 4096
HOT_SHINGLES = 1 << 23
ARRAY_BYTES = 4 << 20
#: Classes whose cells are broadcast to the texts; with more, both are joined by shuffle.
ARRAY_CLASSES = 100_000
CELL = ["key", "band", "low", "high"]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a word sequence."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return gram_hashes(words, len(words)) + np.uint64(len(words))
    return np.unique(gram_hashes(words, k))


def class_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sets(part: pa.RecordBatch, k: int):
    bounds, words = word_hashes(part.column("text"))
    for i in range(part.num_rows):
        yield shingle_set(words[bounds[i]:bounds[i + 1]], k)


def signature(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bitmap in which each shingle flips one bit, as uint64 words."""
    flips = np.bincount((mix(shingles) >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def wide_bits(n: int) -> int:
    """The bits that don't saturate for a set of n shingles: a power of 4 from n on, up to 4 n."""
    return max(BITS, 4 ** ((n.bit_length() - 1) // 2 + 1))


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps of several widths (powers of two) at the least of them: the halves of a bitmap, combined by exclusive or,
    are the bitmap of half the bits."""
    words = [np.frombuffer(b, np.uint64) for b in bitmaps]
    width = min(map(len, words))
    return np.stack([np.bitwise_xor.reduce(w.reshape(-1, width)) if len(w) > width else w for w in words])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def most_difference(n, m, percent: int):
    """The most shingles in which sets of sizes n and m may differ and still link: union - overlap, whole numbers."""
    overlap = -(-percent * (n + m) // (100 + percent))
    return n + m - 2 * overlap


def set_table(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, cls, n) per row, and the counter table in pieces (piece, counts), from one pass over the texts."""
    def run(batches):
        counters = np.zeros(COUNTERS, np.uint32)
        for part in slices(batches):
            ids, texts, cls, n = part.column("doc_id"), part.column("text_hash"), [], []
            for s in sets(part, k):
                cls.append(class_id(s))
                n.append(len(s))
                if len(s):
                    np.add.at(counters, (s >> np.uint64(44)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([ids, texts, pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()),
                                              pa.nulls(len(n), pa.binary())], names=names)
        used = [i for i, c in enumerate(np.split(counters, PIECES)) if c.any()]
        data = [np.split(counters, PIECES)[i].astype("<u4").tobytes() for i in used]
        empty = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([empty, empty, pa.nulls(len(used), pa.binary()), empty,
                                          pa.array(used, pa.int32()), pa.array(data, pa.binary())], names=names)

    names = ["doc_id", "text_hash", "cls", "n", "piece", "counts"]
    both = stored(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, cls binary, n long, piece int, counts binary"), "jaccard-sets")
    return both.where("piece is null").select("doc_id", "text_hash", "cls", "n"), both.where("piece is not null").select("piece", "counts")


def counter_table(pieces: DataFrame) -> np.ndarray:
    """The summed counters: ``COUNTERS`` numbers, however large the input."""
    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // PIECES, np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(x, "<u4")
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    out = np.zeros((PIECES, COUNTERS // PIECES), np.int64)
    for r in pieces.groupBy("piece").applyInArrow(add, "piece int, counts binary").collect():
        out[r["piece"]] = np.frombuffer(r["counts"], "<i8")
    return out.ravel()


def ranks(table: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The counters of shingles. Their order is by (counter, hash as a signed number), here and in Spark."""
    return table[(shingles >> np.uint64(44)).astype(np.int64)].astype(np.int64)


def entries(docs: DataFrame, held: Broadcast, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, cls, n) under the rarest shingles of each class, and (cls, n, sig, wide: a wider bitmap of a large set, else
    null); a class once for each task at most."""
    def run(batches):
        table, seen = held.value, set()
        names = ["key", "cls", "n", "sig", "wide"]
        for part in slices(batches):
            keys, cls, n, sigs, wide = [], [], [], [], []
            for s in sets(part, k):
                c = class_id(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                size = prefix_size(len(s), percent)
                order = np.lexsort((s.view(np.int64), ranks(table, s)))[:size]
                keys.append(s[order])
                cls.append(c)
                n.append(len(s))
                sigs.append(signature(s).tobytes())
                bits = wide_bits(len(s))
                wide.append(signature(s, bits).tobytes() if bits > BITS else None)
            if cls:
                sizes = [len(x) for x in keys]
                at = np.repeat(np.arange(len(cls)), sizes)
                one, size = pa.array(cls, pa.binary()), pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), one.take(pa.array(at)), size.take(pa.array(at)),
                                                  pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())], names=names)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cls), pa.int64()), one, size, pa.array(sigs, pa.binary()), pa.array(wide, pa.binary())],
                                                 names=names)

    both = stored(docs.select("text").mapInArrow(run, "key long, cls binary, n long, sig binary, wide binary"), "jaccard-entries")
    return both.where("sig is null").select("key", "cls", "n"), both.where("sig is not null").select("cls", "n", "sig", "wide")


def shared_entries(entered: DataFrame, held_counters: Broadcast, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the shingles that several classes are entered under: the pairs (a, b, key: the first such shingle) of those with
    two classes, if their sizes can link, and the tile rows (key, rank, cls, n) of the others."""
    names = ["key", "rank", "cls", "n", "b"]

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on in the next batch
            held = batch.slice(cut)
            yield from shared(batch.slice(0, cut))
        if held is not None:
            yield from shared(held)

    def shared(batch):
        if batch.num_rows < 2:
            return
        key, cls, n = batch.column("key").to_numpy(), batch.column("cls").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
        fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]))
        key, cls, n = key[fresh], cls[fresh], n[fresh]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        two = start[size == 2]
        two = two[100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1])]
        more = np.flatnonzero(np.repeat(size > 2, size))
        for rows, other in ((two, pa.array(cls[two + 1], pa.binary())), (more, pa.nulls(len(more), pa.binary()))):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(ranks(held_counters.value, key[rows].view(np.uint64))),
                                                  pa.array(cls[rows], pa.binary()), pa.array(n[rows]), other], names=names)

    both = stored(entered.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(run, "key long, rank long, cls binary, n long, b binary")
                  .withColumn("two", F.col("b").isNotNull()), "jaccard-shared")
    pairs = (both.where("two").groupBy(F.col("cls").alias("a"), "b").agg(F.min(F.struct("rank", "key")).alias("first"))
             .select("a", "b", F.col("first.key").alias("key")))
    return pairs, both.where("not two").select("key", "rank", "cls", "n")


def scale(n: Column) -> Column:
    """The band of a size, on a geometric scale."""
    return F.floor(F.log(n.cast("double")) / float(np.log(BAND_BASE)) + 1e-9).cast("int")


def admitted_pairs(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bitmap bound admits: (a, b, key, n), n the larger size."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("x", "y"))
                n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
                out = pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "key")] + [pa.array(np.maximum(n, m))], names=["a", "b", "key", "n"])
                yield out.filter(pa.array(np.bitwise_count(x ^ y).sum(1) <= most_difference(n, m, percent)))

    left = signed.select(F.col("cls").alias("a"), F.col("sig").alias("x"), "n")
    right = signed.select(F.col("cls").alias("b"), F.col("sig").alias("y"), F.col("n").alias("m"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary, key long, n long")


def dealt(tiles: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of ``tiles`` (key, band, ...) in cells: hot tiles are cut into chunks by a hash, and each pair of chunks
    (low, high) is a cell; in a cell of two chunks only pairs across them count."""
    room = F.greatest(F.lit(16), F.least(F.lit(HOT_ROWS), F.floor(HOT_SHINGLES / F.pow(F.lit(BAND_BASE), F.col("band") + 1))))
    hot = (tiles.groupBy("key", "band").agg(F.count("*").alias("c")).where(F.col("c") > room)
           .select("key", "band", F.ceil(F.col("c") / room).cast("int").alias("chunks")))
    rows = rows.join(small_side(stored(hot, "jaccard-hot")), ["key", "band"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("cls", "key"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("chunks", "other")


def whole_cells(batches):
    """Each cell of batches sorted by ``CELL`` as one record batch."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in CELL]
        start = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))
        if held and last != [c[0] for c in columns]:
            yield pa.concat_batches(held)
            held = []
        for at, end in zip(start, np.append(start[1:], batch.num_rows)):
            if at:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(at, end - at))
        last = [c[-1] for c in columns]
    if held:
        yield pa.concat_batches(held)


def near_rows(cell: pa.RecordBatch, sig: np.ndarray, percent: int):
    """(i, rows before i that the size and bitmap bounds admit) for each row of a cell, which is sorted by size. Classes
    that meet in two bands count in the band of the larger one."""
    n, home, chunk = (cell.column(c).to_numpy() for c in ("n", "home", "chunk"))
    band, across = cell.column("band")[0].as_py(), cell.column("low")[0] != cell.column("high")[0]
    lowest = np.searchsorted(100 * n, percent * n, "left")
    for i in np.flatnonzero((home == band) & (lowest < np.arange(len(n)))):
        rows = slice(lowest[i], i)
        ok = np.bitwise_count(sig[rows] ^ sig[i]).sum(1) <= most_difference(n[rows], n[i], percent)
        if across:
            ok &= chunk[rows] != chunk[i]
        if ok.any():
            yield i, lowest[i] + np.flatnonzero(ok)


def wanting(rows: DataFrame, percent: int) -> DataFrame:
    """(key, band, low, high, chunk, early, cls): the classes with a pair in their cell that the bounds admit and that
    shares no earlier one of its first shingles. ``rows``: those columns, n, home and sig."""
    def run(batches):
        for cell in whole_cells(batches):
            if cell.num_rows < 2:
                continue
            sig = folded(cell.column("sig").to_pylist())
            lists = cell.column("early")
            count = lists.value_lengths().to_numpy()
            early = np.full((len(sig), EARLY), cell.column("key")[0].as_py(), np.int64)  # never an earlier one
            early[np.arange(EARLY) < count[:, None]] = lists.flatten().to_numpy()
            want = np.zeros(len(sig), bool)
            for i, near in near_rows(cell, sig, percent):
                if count[i]:
                    near = near[~(early[near][:, :, None] == early[i, :count[i]]).any((1, 2))]
                if len(near):
                    want[near] = want[i] = True
            if want.any():
                yield cell.select([*CELL, "chunk", "early", "cls"]).filter(pa.array(want))

    return (rows.select(*CELL, "chunk", "early", "n", "cls", "home", "sig").repartition(*CELL).sortWithinPartitions(*CELL, "n", "cls")
            .mapInArrow(run, "key long, band int, low int, high int, chunk int, early array<long>, cls binary"))


def wanted_classes(tiles: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(key, band, low, high, chunk, early, cls): the classes that a cell of a tile must look at, as many rows as the tiles
    have at most."""
    bands = F.sequence(scale(F.col("n")), scale(F.col("n") * 100.0 / percent))
    keys = (tiles.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("keys"))
            .join(signed.select("cls", "n", "sig", bands.alias("bands"), scale(F.col("n")).alias("home")), "cls"))
    rows = (keys.select("cls", "n", "sig", "home", "bands", F.expr(f"transform(slice(keys, 1, {EARLY}), x -> x.key)").alias("first"),
                        F.posexplode("keys").alias("at", "own"))
            .select("cls", "n", "sig", "home", F.explode("bands").alias("band"), F.col("own.key").alias("key"),
                    F.expr(f"slice(first, 1, least(at, {EARLY}))").alias("early")))
    return wanting(dealt(tiles.select("key", F.explode(bands).alias("band")), rows), percent)


def class_arrays(docs: DataFrame, firsts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(key, band, low, high, chunk, home, n, cls, shingles): the array of each wanted class, made again from one text of
    it, for each cell that wants it."""
    cells = wanted.groupBy("cls").agg(F.collect_list(F.struct(*CELL, "chunk")).alias("cells"))
    cells = stored(firsts.join(cells, "cls").select(F.col("doc_id").alias("wanted"), F.col("text_hash").alias("wanted_hash"), "cls",
                                                    scale(F.col("n")).alias("home"), "cells"), "jaccard-wanted")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
            .join(small_side(cells, ARRAY_CLASSES), F.col("doc_id").eqNullSafe(F.col("wanted")) & (F.col("text_hash") == F.col("wanted_hash")))
            .select("text", "cls", "home", "cells"))

    def run(batches):
        out, size = [], 0
        for part in slices(batches):
            for c, home, places, s in zip(part.column("cls").to_pylist(), part.column("home").to_pylist(), part.column("cells"), sets(part, k)):
                if class_id(s) != c:
                    continue
                data = s.tobytes()
                for x in places.as_py():
                    out.append((*(x[name] for name in CELL), x["chunk"], home, len(s), c, data))
                    size += len(data) + 64
                    if size > ARRAY_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=names)

    names = [*CELL, "chunk", "home", "n", "cls", "shingles"]
    types = [pa.int64()] + [pa.int32()] * 5 + [pa.int64(), pa.binary(), pa.binary()]
    return rows.mapInArrow(run, "key long, band int, low int, high int, chunk int, home int, n long, cls binary, shingles binary")


def shared_with(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``others`` has in common with ``x``; all are sorted and distinct."""
    if not len(x):
        return np.zeros(len(others), np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    return np.bincount(np.repeat(np.arange(len(others)), [len(o) for o in others])[x[at] == flat], minlength=len(others))


def cell_links(arrays: DataFrame, held: Broadcast, percent: int, every_link: bool) -> DataFrame:
    """(a, b, links): the edges (a, b) of a spanning forest of each cell's links, and the number of links of each class a.

    A pair is verified in the tile of its first common shingle. Without ``every_link`` pairs that are already joined
    aren't verified, and links are not counted.
    """
    def run(batches):
        for cell in whole_cells(batches):
            names = cell.column("cls").to_numpy(zero_copy_only=False)
            fresh = np.concatenate([[True], names[1:] != names[:-1]])  # a repeated row sends its class's array again
            cell, names = cell.filter(pa.array(fresh)), names[fresh]
            if len(names) > 1:
                yield from links(cell, names)

    def links(cell, names):
        table, key = held.value, np.int64(cell.column("key")[0].as_py())
        rank = ranks(table, np.array([key]).view(np.uint64))[0]
        arrays = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.column("shingles")]
        before = []
        for s in arrays:
            r = ranks(table, s)
            before.append(s[(r < rank) | ((r == rank) & (s.view(np.int64) < key))])
        group, count, edges = np.arange(len(arrays)), np.zeros(len(arrays), np.int64), []
        for i, near in near_rows(cell, folded([signature(s, wide_bits(len(s))).tobytes() for s in arrays]), percent):
            # Steps bound what is held at once; they also save pairs that an earlier step has joined.
            step = max(1, (1 << 20 if every_link else 1 << 13) // len(arrays[i]))
            for part in np.split(near, range(step, len(near), step)):
                if not every_link:
                    part = part[group[part] != group[i]]
                if len(part):
                    part = part[shared_with(before[i], [before[j] for j in part]) == 0]
                if not len(part):
                    continue
                both = shared_with(arrays[i], [arrays[j] for j in part])
                part = part[100 * both >= percent * (len(arrays[i]) + np.array([len(arrays[j]) for j in part]) - both)]
                count[part] += 1
                count[i] += len(part)
                for g in np.unique(group[part]):
                    if g != group[i]:
                        edges.append((int(part[group[part] == g][0]), int(i)))
                        group[group == g] = group[i]
        linked = np.flatnonzero(count) if every_link else []
        if edges or len(linked):
            a, b = [names[i] for i, _ in edges], [names[j] for _, j in edges]
            yield pa.RecordBatch.from_arrays([pa.array([*a, *(names[i] for i in linked)], pa.binary()), pa.array(b + [None] * len(linked), pa.binary()),
                                              pa.array([None] * len(edges) + [int(count[i]) for i in linked], pa.int64())], names=["a", "b", "links"])

    return arrays.repartition(*CELL).sortWithinPartitions(*CELL, "n", "cls").mapInArrow(run, "a binary, b binary, links long")


def class_components(docs: DataFrame, rows: DataFrame, pieces: DataFrame, k: int, percent: int, every_link: bool) -> DataFrame:
    """(cls, component_id, n_links) per class with shingles. Without ``every_link`` only the links that the components need
    are verified, and n_links is null."""
    held = docs.sparkSession.sparkContext.broadcast((lambda c: c.astype(np.uint32 if c.max(initial=0) < 2**32 else np.int64))(counter_table(pieces)))
    text = F.coalesce(F.min_by("text_hash", "doc_id"), F.first("text_hash")).alias("text_hash")
    firsts = stored(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), text, F.first("n").alias("n")), "jaccard-classes")
    entered, signatures = entries(docs, held, k, percent)
    twos, tiles = shared_entries(entered, held, percent)
    signed = stored(signatures.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("wide").alias("wide"), F.first("n").alias("n")), "jaccard-signed")

    # A tile of two classes is a cell of its own.
    zero = F.lit(0)
    pairs = (admitted_pairs(twos, signed, percent).select("key", scale(F.col("n")).alias("band"), zero.alias("low"), zero.alias("high"),
                                                          zero.alias("chunk"), F.array().cast("array<long>").alias("early"),
                                                          F.explode(F.array("a", "b")).alias("cls")))
    wanted = stored(pairs.unionByName(wanted_classes(tiles, signed, percent)), "jaccard-cells")
    # Large sets fill the narrow bitmaps: what is left of them is looked at again by the wide ones before any array moves.
    large = F.col("band") >= WIDE_BAND
    wide = signed.select("cls", "n", scale(F.col("n")).alias("home"), F.coalesce("wide", "sig").alias("sig"))
    wanted = stored(wanted.where(~large).unionByName(wanting(wanted.where(large).join(wide, "cls"), percent)), "jaccard-wide")
    found = stored(cell_links(class_arrays(docs, firsts, wanted, k), held, percent, every_link), "jaccard-links")
    label = components(found.where("b is not null"), "a", "b")

    named = stored(firsts.join(label.select(F.col("node").alias("cls"), "component"), "cls", "left")
                   .select("cls", "doc_id", F.coalesce("component", "cls").alias("component")), "jaccard-named")
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component")
    if not every_link:
        return named.select("cls", "component_id", F.lit(None).cast("long").alias("n_links"))
    degree = found.where("links is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("n_links"))
    return named.join(degree, "cls", "left").select("cls", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, every_link: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of ``docs`` (doc_id, text).

    ``n_links`` is the number of other classes (different sets of shingles) that link with the row's class, all of them
    verified; null without ``every_link``, which verifies only what the components need.
    """
    small_batches(docs.sparkSession)
    rows, pieces = set_table(docs, k)
    named = kept(docs.sparkSession, "jaccard-components", lambda: class_components(docs, rows, pieces, k, percent, every_link))
    n_links = F.when(F.col("n") > 0, F.col("n_links")).otherwise(0) if every_link else F.col("n_links")
    return (rows.join(named, "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    n_links.cast("long").alias("n_links")))


def keep_one_per_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one its component is named after; all columns pass through.

    Empty documents are in no group and stay, and so do groups without any doc_id. Of repeated rows of the kept doc_id
    one stays.
    """
    spark = docs.sparkSession
    found = jaccard_components(docs, k, percent, every_link=False)
    gone = kept(spark, "jaccard-gone", lambda: found.where("n_shingles > 0 and doc_id <> component_id")
                .select(F.col("doc_id").alias("__id")).distinct())
    twice = kept(spark, "jaccard-twice", lambda: found.where("n_shingles > 0 and doc_id = component_id")
                 .groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__id"))
    left = docs.join(small_side(gone), F.col("doc_id") == F.col("__id"), "left_anti")
    if twice.isEmpty():
        return left
    twice = small_side(twice)
    once = left.join(twice, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(once)
