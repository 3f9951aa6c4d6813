"""Repeated passages by a sparse suffix array.

Suffixes are kept only at content-selected positions: a word position is an anchor when the hash of the ``GRAM`` words
from it is the smallest of some ``window`` consecutive positions, so any ``MIN_WORDS`` words hold an anchor, at the
same place in each of their occurrences. Suffixes are sorted by their first words; those without an equal neighbour
are dropped. For the others every window of ``MIN_WORDS`` words around the anchor (the suffix extended to the left by 0,
1, 2, ... words) is sorted with its neighbours' and compared: windows with an equal neighbour are repeated. Their union,
extended window by window to the left and right, is the maximal repeat.

Texts that are equal as a whole are one class, entered once. An anchor that very many classes share is not
brought into one task: its windows are counted by a pre-aggregated grouping of their own.

Result: spans of words (white-space separated, end exclusive) of kind ``repeat`` where the words occurred earlier (in
(doc_id, position) order, the same text included) and ``first`` where they occur for the first of several times; a text
that stands whole in several rows is one ``first`` span in its first row.

Rows: null or short texts have no spans; rows with the smallest doc_id of equal texts count as the first; a null doc_id
comes after all others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import gram_hashes, kept, range_hasher, slices, small_batches, small_side, stored, word_hashes

MIN_WORDS = 50
GRAM = 30
#: An anchor of more rows goes the pre-aggregated way.
HOT_ROWS = 20_000
#: Anchors whose windows are made at a time.
CHUNK = 4096
LAST = np.iinfo(np.int64).max


def sliding(values: np.ndarray, size: int, take) -> np.ndarray:
    """``take`` (np.minimum or np.maximum) over each ``size`` consecutive values, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = take(out[:-step], out[step:])
        have += step
    return out


def anchors(bounds: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the concatenated words) of the selected suffixes and the hash of their first words."""
    window = least - GRAM + 1
    if len(words) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, low = window_least(words, least)
    end = np.repeat(bounds[1:], np.diff(bounds))
    low[np.arange(len(low)) + least > end[:len(low)]] = 0
    pad = np.zeros(window - 1, np.uint64)
    high = sliding(np.concatenate([pad, low, pad]), window, np.maximum)
    at = np.flatnonzero((high == grams) & (high > 0))
    return at, grams[at]


def window_least(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of GRAM words, and the smallest of those within the ``least`` words from each position."""
    grams = gram_hashes(words, GRAM)
    return grams, sliding(grams, least - GRAM + 1, np.minimum)


def text_class(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode())


def classes_and_anchors(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n_words) per row, and (key, cls, pos) per anchor of a class, a class once for each task at most."""
    names = ["doc_id", "cls", "n_words", "key", "pos"]

    def run(batches):
        seen: set[bytes] = set()
        for part in slices(batches):
            bounds, words = word_hashes(part.column("text"))
            cls = [text_class(t) for t in part.column("text").to_pylist()]
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cls, pa.binary()), pa.array(np.diff(bounds)),
                                              pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=names)
            fresh = np.zeros(n, bool)
            for i, c in enumerate(cls):
                if c not in seen:
                    fresh[i] = True
                    seen.add(c)
            at, key = anchors(bounds, words, least)
            row = np.searchsorted(bounds, at, "right") - 1
            at, key, row = at[fresh[row]], key[fresh[row]], row[fresh[row]]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(cls, pa.binary()).take(pa.array(row)), pa.nulls(len(at), pa.int64()),
                                              pa.array(key.view(np.int64)), pa.array((at - bounds[row]).astype(np.int32))], names=names)

    both = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, cls binary, n_words long, key long, pos int"), "suffix-anchors")
    return both.where("key is null").select("doc_id", "cls", "n_words"), both.where("key is not null").select("key", "cls", "pos")


def by_run(batches, key: str):
    """Batches cut so that rows of one key (sorted) are never in two of them."""
    held = None
    for batch in batches:
        batch = pa.concat_batches([held, batch]) if held is not None else batch
        if batch.num_rows:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cut = batch.num_rows - 1
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            held = batch.slice(cut)
            if cut:
                yield batch.slice(0, cut)
    if held is not None and held.num_rows:
        yield held


def fresh_rows(batch: pa.RecordBatch) -> np.ndarray:
    """Which sorted rows differ from the row before in key, class or position."""
    key, cls, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cls", "pos"))
    return np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]) | (pos[1:] != pos[:-1])])


def shared_anchors(entered: DataFrame) -> DataFrame:
    """The anchors whose first words another suffix starts with as well."""
    def run(batches):
        for batch in by_run(batches, "key"):
            key, fresh = batch.column("key").to_numpy(), fresh_rows(batch)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.add.reduceat(fresh.astype(np.int64), start) > 1
            yield batch.take(pa.array(np.flatnonzero(fresh & np.repeat(many, np.diff(np.append(start, len(key)))))))

    return entered.repartition("key").sortWithinPartitions("key", "cls", "pos").mapInArrow(run, "key long, cls binary, pos int")


def windows(docs: DataFrame, lists: DataFrame, least: int) -> DataFrame:
    """(key, cls, first_id, pos, hashes): the window hashes around each listed anchor, by left extension; 0 where none."""
    reach = least - GRAM + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(lists, F.col("doc_id").eqNullSafe(F.col("first"))).select("text", "cls", "first", "places")

    def run(batches):
        for part in slices(batches):
            bounds, words = word_hashes(part.column("text"))
            texts, cls = part.column("text").to_pylist(), part.column("cls").to_pylist()
            ok = [i for i in range(part.num_rows) if text_class(texts[i]) == cls[i]]
            if not ok:
                continue
            places = part.column("places")
            at = [np.array(places[i].as_py(), np.int64) for i in ok]
            row = np.repeat(ok, [len(x) for x in at])
            pos = np.concatenate(at)
            here = pos + bounds[row]
            grams, low = window_least(words, least)
            hashes = range_hasher(words)
            first = part.column("first").fill_null(LAST).to_numpy(zero_copy_only=False)[row]
            for a in range(0, len(pos), CHUNK):
                b = slice(a, a + CHUNK)
                start = here[b, None] - np.arange(reach)[None, :]
                valid = (start >= bounds[row[b]][:, None]) & (start + least <= bounds[row[b] + 1][:, None])
                # A window counts under the anchors that are its own smallest: the same in each of its occurrences.
                valid &= low[np.where(valid, start, 0)] == grams[here[b]][:, None]
                safe = np.where(valid, start, 0).ravel()
                h = hashes(safe, np.minimum(safe + least, len(words))) | np.uint64(1)
                h[~valid.ravel()] = 0
                size = len(pos[b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[here[b]].view(np.int64)), pa.array(cls, pa.binary()).take(pa.array(row[b])), pa.array(first[b]),
                     pa.array(pos[b].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * reach), pa.array(h.view(np.int64)))],
                    names=["key", "cls", "first_id", "pos", "hashes"])

    return rows.mapInArrow(run, "key long, cls binary, first_id long, pos int, hashes array<long>")


def repeated_windows(found: DataFrame, least: int) -> DataFrame:
    """(cls, pos, again, later): bit i of ``again`` is set where the window that starts i words before the anchor is
    repeated, of ``later`` where an occurrence precedes it in (first_id, cls, pos) order."""
    reach = least - GRAM + 1

    def run(batches):
        for batch in by_run(batches, "key"):
            # A class whose first doc_id stands in several rows has its windows several times.
            batch = batch.take(pa.array(np.flatnonzero(fresh_rows(batch))))
            n = batch.num_rows
            key = batch.column("key").to_numpy().view(np.uint64)
            h = batch.column("hashes").flatten().to_numpy().view(np.uint64).reshape(n, reach)
            tag = np.where(h > 0, (h ^ (key[:, None] * np.uint64(0xD6E8FEB86659FD93))) + np.arange(reach, dtype=np.uint64)[None, :], 0).ravel()
            order = np.argsort(tag, kind="stable")
            t = tag[order]
            same = np.concatenate([[False], (t[1:] == t[:-1]) & (t[1:] > 0)])
            again = same | np.concatenate([same[1:], [False]])
            bit = np.uint64(1) << (order % reach).astype(np.uint64)
            masks = []
            for flags in (again, same):
                m = np.zeros((n, reach), np.uint64)
                m.ravel()[order[flags]] = bit[flags]
                masks.append(np.bitwise_or.reduce(m, axis=1))
            marked = np.flatnonzero(masks[0])
            yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(marked)), batch.column("pos").take(pa.array(marked)),
                                              pa.array(masks[0][marked].view(np.int64)), pa.array(masks[1][marked].view(np.int64))],
                                             names=["cls", "pos", "again", "later"])

    schema = "cls binary, pos int, again long, later long"
    hot = stored(found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("key"), "suffix-hot")
    if hot.isEmpty():
        return found.repartition("key").sortWithinPartitions("key", "first_id", "cls", "pos").mapInArrow(run, schema)
    hot = small_side(hot)
    cool = (found.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "first_id", "cls", "pos").mapInArrow(run, schema))
    each = (found.join(hot, "key", "left_semi").dropDuplicates(["key", "cls", "pos"]).select("key", "cls", "pos", F.struct("first_id", "cls", "pos").alias("place"),
                                                       F.posexplode("hashes").alias("i", "h")).where("h <> 0"))
    groups = each.groupBy("key", "i", "h").agg(F.count("*").alias("n"), F.min("place").alias("least")).where("n > 1")
    marked = each.join(groups, ["key", "i", "h"]).withColumn("bit", F.expr("shiftleft(1L, i)"))
    return cool.unionByName(marked.groupBy("cls", "pos").agg(
        F.bit_or("bit").alias("again"), F.bit_or(F.when(F.col("place") != F.col("least"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("later")))


def class_spans(marked: DataFrame, least: int) -> DataFrame:
    """(cls, start_word, end_word, kind): the joined windows of each class."""
    reach = least - GRAM + 1

    def run(batches):
        for batch in by_run(batches, "cls"):
            cls, pos = batch.column("cls").to_numpy(zero_copy_only=False), batch.column("pos").to_numpy().astype(np.int64)
            fresh = np.concatenate([[True], cls[1:] != cls[:-1]])
            run_of = np.cumsum(fresh) - 1
            names = cls[fresh]
            again, later = (batch.column(c).to_numpy().view(np.uint64) for c in ("again", "later"))
            for kind, mask in (("repeat", later), ("first", again & ~later)):
                bits = (mask[:, None] >> np.arange(reach, dtype=np.uint64)[None, :]) & np.uint64(1)
                row, i = np.nonzero(bits)
                if not len(row):
                    continue
                starts = np.unique((run_of[row] << 32) | (pos[row] - i))
                new = np.concatenate([[True], starts[1:] - starts[:-1] > least])
                last = np.concatenate([new[1:], [True]])
                begin, end = starts[new], starts[last]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[begin >> 32], pa.binary()), pa.array((begin & 0xFFFFFFFF)), pa.array((end & 0xFFFFFFFF) + least),
                     pa.array([kind] * len(begin))], names=["cls", "start_word", "end_word", "kind"])

    return (marked.repartition("cls").sortWithinPartitions("cls", "pos")
            .mapInArrow(run, "cls binary, start_word long, end_word long, kind string"))


def shared_spans(docs: DataFrame, classes: DataFrame, entered: DataFrame, least: int) -> DataFrame:
    """(doc_id, start_word, end_word, kind) of each class's first row."""
    shared = stored(shared_anchors(entered), "suffix-shared")
    lists = shared.groupBy("cls").agg(F.sort_array(F.collect_set("pos")).alias("places")).join(classes, "cls").select("cls", "first", "places")
    lists = stored(lists, "suffix-lists")
    found = stored(windows(docs, lists, least), "suffix-windows")
    return class_spans(repeated_windows(found, least), least).join(classes.select("cls", F.col("first").alias("doc_id")), "cls")


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, kind) of the passages of ``least`` words or more that repeat."""
    small_batches(docs.sparkSession)
    rows, entered = classes_and_anchors(docs, least)
    classes = stored(rows.groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n_words").alias("n")), "suffix-classes")
    spans = kept(docs.sparkSession, "suffix-spans", lambda: shared_spans(docs, classes, entered, least))
    whole = (rows.join(classes.where("copies > 1").where(F.col("n") >= least), "cls")
             .select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"),
                     F.when(F.col("doc_id").eqNullSafe(F.col("first")), "first").otherwise("repeat").alias("kind")))
    names = ["doc_id", "start_word", "end_word", "kind"]
    return (spans.select(*names).unionByName(whole).distinct()
            .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "kind"))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remove_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of their ``repeat`` spans (and the white space after each of those words)."""
    lists = (spans.where("kind = 'repeat'").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans")))
    names = docs.columns

    def run(batches):
        for part in slices(batches):
            new = []
            for text, cut in zip(part.column("text").to_pylist(), part.column("__spans").to_pylist()):
                if text and cut:
                    words = list(WORD.finditer(text))
                    gone = np.zeros(len(words) + 1, bool)
                    for s in cut:
                        gone[s["start_word"]:s["end_word"]] = True
                    begin = [m.start() for m in words] + [len(text)]
                    text = text[:begin[0]] + "".join(text[begin[i]:begin[i + 1]] for i in range(len(words)) if not gone[i])
                new.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else part.column(c) for c in names], names=names)

    return docs.join(lists, "doc_id", "left").select(*names, "__spans").mapInArrow(run, docs.schema)
