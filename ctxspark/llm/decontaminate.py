"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the texts stores the words' hashes. Passages are runs of ``BLOCK`` words; a passage's terms are its
   distinct words, hashed to ``TERMS`` columns. In the same pass each task sums the document frequencies and the product
   of the term matrix's transpose, the term matrix and a random sparse-sign test matrix (TERMS x RANK, whatever the
   input); the executors add the sums up. From the total, the Nystroem form of the randomised singular value
   decomposition of the TF-IDF passages gives the leading right singular vectors and values; the first few are left out.
2. Windows of one passage or two neighbouring ones and the benchmark items are projected into that latent space (each
   direction divided by its singular value). A window is a candidate for the items whose cosine reaches ``COSINE``; an item
   longer than ``PART`` words is projected in parts of about that length, and each part stands for the item.
   Beside it stands an exact way: who holds ``least`` of an item's n words holds at least k of its n - least + k rarest
   ones, so every run of words within the item's reach that holds k of those (``NEAR`` of the n) is a candidate as well. Together they
   miss no text that the next step would accept.
3. A candidate's words, widened by twice the item's length on each side, are compared with the item: enough of them must be words of
   the item at all, then the longest common subsequence within twice the item's length must hold ``LCS`` of the item's words, and of those of its answer
   (its last sentence) ``ANSWER``.

Rows: a null or empty text or item has no terms and matches nothing; items of fewer than ``SHORT`` words must be held
whole; repeated rows match each; a null doc_id or item_id stays null; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxspark.llm.common import kept, mix, slices, small_batches, small_side, split_words, stored, string_hashes

TERMS = 1 << 14
RANK = 96
#: The leading directions tell languages and frequent words apart rather than contents: they are left out.
COMMON = 6
BLOCK = 32
COSINE = 0.36
PART = 60
NEAR = 0.25
LCS, ANSWER = 0.6, 0.5
SHORT = 8
#: The benchmark is held by every task; a larger one is refused (cut it into parts).
MAX_ITEMS = 50_000
PIECES = 16
#: Gathered rows of RANK numbers at a time: what a core's cache holds.
CHUNK = 1 << 14
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
SENTENCE_ENDS = (".", "!", "?")


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, 32-bit word hashes (signs at the ends taken off) and which words end a sentence; words of signs alone
    go."""
    bounds, words = split_words(texts, lower=False)
    if not len(words):
        return bounds, np.zeros(0, np.uint32), np.zeros(0, bool)
    bare = pc.utf8_lower(pc.utf8_trim(words.dictionary, characters=SIGNS))
    at = words.indices.to_numpy(zero_copy_only=False)
    real = (pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0)[at]
    ends = pc.or_(pc.or_(*(pc.ends_with(words.dictionary, e) for e in SENTENCE_ENDS[:2])), pc.ends_with(words.dictionary, SENTENCE_ENDS[2]))
    return np.concatenate([[0], np.cumsum(real)])[bounds], (string_hashes(bare) >> np.uint64(32)).astype(np.uint32)[at][real], ends.to_numpy(zero_copy_only=False)[at][real]


def blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the passages (each text cut into runs of BLOCK words) and the row of each."""
    n = np.diff(bounds)
    count = -(-n // BLOCK)
    row = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    return bounds[row] + (np.arange(len(row)) - first[row]) * BLOCK, row


def column_of(words: np.ndarray) -> np.ndarray:
    return (mix(words.astype(np.uint64)) >> np.uint64(17)).astype(np.int32) & np.int32(TERMS - 1)


def test_columns() -> tuple[np.ndarray, np.ndarray]:
    """The test matrix: for each term, its one column and sign."""
    r = np.random.default_rng(20240229)
    return r.integers(0, RANK, TERMS), r.choice([-1.0, 1.0], TERMS)


def test_matrix() -> np.ndarray:
    column, sign = test_columns()
    out = np.zeros((TERMS, RANK))
    out[np.arange(TERMS), column] = sign
    return out


def block_pairs(starts: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (passage, term) pairs, by passage."""
    passage = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.append(starts, len(columns))))
    if len(starts) < 1 << 17:
        pair = passage * np.int32(TERMS) + columns
    else:
        pair = passage.astype(np.int64) * TERMS + columns
    pair.sort()
    pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
    return pair // TERMS, pair % TERMS


def grouped_sums(values: np.ndarray, rows: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values[rows]`` over the runs of ``group`` (sorted), in parts of at most ``width`` rows: (group of each part,
    its sum). The parts are padded with a row of zeros, so that rows add up place by place in the cache."""
    new = np.concatenate([[True], group[1:] != group[:-1]])
    start = np.flatnonzero(new)
    inside = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    part = np.cumsum(inside % width == 0) - 1
    n = int(part[-1]) + 1
    places = np.full((n, width), len(values), np.int64)
    places[part, inside % width] = rows
    values = np.concatenate([values, np.zeros((1, values.shape[1]), values.dtype)])
    out = np.empty((n, values.shape[1]), values.dtype)
    for a in range(0, n, CHUNK // width):
        b = min(a + CHUNK // width, n)
        total = np.take(values, places[a:b, 0], axis=0)
        for k in range(1, width):
            total += np.take(values, places[a:b, k], axis=0)
        out[a:b] = total
    return group[inside % width == 0], out


def add_products(total: np.ndarray, y: np.ndarray, passage: np.ndarray, column: np.ndarray) -> None:
    """total[c] += sum of y[p] over the pairs (p, c)."""
    order = np.argsort(column.astype(np.int16), kind="stable")
    of, sums = grouped_sums(y, passage[order], column[order], 8)
    while (of[1:] == of[:-1]).any():
        of, sums = grouped_sums(sums, np.arange(len(of)), of, 8)
    total[of] += sums


def corpus_pass(docs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """(doc_id, words) per row of ``docs``, stored, and over the passages of all texts: document frequencies, the term
    matrix transposed times itself times the test matrix, and the number of passages. Each task adds up its own; the
    pieces of the sums meet in the executors."""
    names = ["doc_id", "words", "piece", "n", "df", "total"]

    def run(batches):
        slot, sign = test_columns()
        df, total, n = np.zeros(TERMS, np.int64), np.zeros((TERMS, RANK), np.float32), 0
        for part in slices(batches):
            bounds, words, _ = terms(part.column("text"))
            k = part.num_rows
            data = [words[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()),
                                              pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)
            starts, _ = blocks(bounds)
            if not len(starts):
                continue
            passage, column = block_pairs(starts, column_of(words))
            y = np.bincount(passage * np.int64(RANK) + slot[column], weights=sign[column], minlength=len(starts) * RANK)
            add_products(total, y.reshape(-1, RANK).astype(np.float32), passage, column)
            df += np.bincount(column, minlength=TERMS)
            n += len(starts)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, pa.binary()), pa.array(range(PIECES), pa.int32()), pa.array([n] * PIECES, pa.int64()),
                 pa.array([x.tobytes() for x in np.split(df, PIECES)], pa.binary()), pa.array([x.tobytes() for x in np.split(total, PIECES)], pa.binary())],
                names=names)

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        df = sum(np.frombuffer(x, np.int64) for x in t.column("df").to_pylist())
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("total").to_pylist())
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([pc.sum(t.column("n")).as_py()], pa.int64()),
                         "df": pa.array([df.tobytes()], pa.binary()), "total": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    # One sum for each task, not for each split: as many tasks as keep all cores busy.
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    schema = "doc_id long, words binary, piece int, n long, df binary, total binary"
    both = stored(docs.select(F.col("doc_id").cast("long"), "text").coalesce(tasks).mapInArrow(run, schema), "decontaminate")
    schema = "piece int, n long, df binary, total binary"
    got = both.where("piece is not null").select("piece", "n", "df", "total").groupBy("piece").applyInArrow(add, schema).collect()
    df, total = np.zeros((PIECES, TERMS // PIECES), np.int64), np.zeros((PIECES, TERMS // PIECES, RANK))
    for r in got:
        df[r["piece"]] = np.frombuffer(r["df"], np.int64)
        total[r["piece"]] = np.frombuffer(r["total"], np.float32).reshape(-1, RANK)
    return both.where("piece is null").select("doc_id", "words"), df.ravel(), total.reshape(TERMS, RANK), got[0]["n"] if got else 0


def latent_space(df: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """Projection of term columns (TERMS x rank): IDF times singular vectors over singular values.

    With D the IDF weights and the test matrix D^-1 Omega, the Gram matrix of the TF-IDF passages times the test matrix
    is D total; its Nystroem form (D total)(Omega' D^-1 D total)^-1 (D total)' has that Gram matrix's leading
    eigenvectors.
    """
    idf = np.log((n + 1) / (df + 0.5)) + 1e-3
    sketch = idf[:, None] * total
    test = test_matrix() / idf[:, None]
    shift = 1e-6 * np.linalg.norm(sketch)
    sketch = sketch + shift * test
    inner = test.T @ sketch
    inner = np.linalg.cholesky((inner + inner.T) / 2 + 1e-9 * np.trace(inner) / RANK * np.eye(RANK))
    u, s, _ = np.linalg.svd(np.linalg.solve(inner, sketch.T).T, full_matrices=False)
    used = (s > 1e-6 * s[0]) & (np.arange(RANK) >= COMMON)
    return np.ascontiguousarray(idf[:, None] * u[:, used] / s[used], np.float32)


class Item:
    """A benchmark item with the bit masks of its words, for subsequences by words of bits."""

    def __init__(self, item_id, words: np.ndarray, ends: np.ndarray):
        self.item_id, self.n = item_id, len(words)
        self.words = words
        stops = [i + 1 for i in np.flatnonzero(ends) if i + 1 < len(words)]
        self.answer = stops[-1] if stops and len(words) - stops[-1] >= 3 else len(words) - max(1, len(words) // 3)
        self.masks = self._masks(words)
        self.answer_masks = self._masks(words[self.answer:])

    @staticmethod
    def _masks(words: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words.tolist()):
            out[w] = out.get(w, 0) | 1 << i
        return out

    @staticmethod
    def common(masks: dict[int, int], n: int, words: list[int]) -> int:
        """Length of the longest common subsequence."""
        full = (1 << n) - 1
        v = full
        for w in words:
            m = masks.get(w)
            if m:
                u = v & m
                v = (v + u | v - u) & full
        return n - v.bit_count()

    def matches(self, words: np.ndarray, lcs: float, answer: float) -> tuple[float, float] | None:
        """(share of the item, share of its answer) that ``words`` hold in order, if both suffice."""
        least, of, best = 1.0 if self.n < SHORT else lcs, self.n - self.answer, None
        words = words.tolist()
        # The item's words must stand within twice its length.
        for a in range(0, max(1, len(words) - self.n), max(1, self.n // 2)):
            held = words[a:a + 2 * self.n]
            share = self.common(self.masks, self.n, held) / self.n
            if share >= least and (best is None or share > best[0]):
                last = self.common(self.answer_masks, of, held) / of
                if last >= answer:
                    best = share, last
        return best


def read_items(benchmark: DataFrame) -> list[Item]:
    rows = benchmark.select("item_id", "text").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"a benchmark of more than {MAX_ITEMS} items: cut it into parts")
    texts = pa.array([r["text"] for r in rows], pa.string())
    bounds, words, ends = terms(texts)
    return [Item(r["item_id"], words[a:b], ends[a:b]) for r, a, b in zip(rows, bounds[:-1], bounds[1:]) if b > a]


def project(space: np.ndarray, starts: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Latent vectors of the passages that start at ``starts`` (the last goes to the end)."""
    passage, column = block_pairs(starts, columns)
    return grouped_sums(space, column, passage, BLOCK)[1]


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def holds_words(columns: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray, member: np.ndarray, least: np.ndarray,
                length: np.ndarray) -> np.ndarray:
    """Which of the ranges hold ``least`` words of their item within its reach; ``columns`` ends with a column of no item."""
    enough = np.empty(len(item), bool)
    order = np.argsort(end - begin, kind="stable")
    c = 0
    while c < len(order):
        # Ranges of about one width at a time, so many as the cache holds.
        some = order[c:c + 4096]
        some = some[:max(1, (1 << 19) // int((end - begin)[some[-1]] + 1))]
        c += len(some)
        width, of = int((end - begin)[some].max()), item[some]
        step = max(8, int(length[of].min()) // 4)
        at = begin[some, None] + np.arange(width)[None, :]
        at[at >= end[some, None]] = len(columns) - 1
        # the most words of the item within its reach, from every step on
        sums = np.zeros((len(some), width + 1), np.int32)
        np.cumsum(member[of[:, None], columns[at]], axis=1, out=sums[:, 1:])
        reach, each, most = 2 * length[of] + step, np.arange(len(some)), np.zeros(len(some), np.int32)
        for o in range(0, width, step):
            np.maximum(most, sums[each, np.minimum(o + reach, width)] - sums[:, o], out=most)
        enough[some] = most >= least[of]
    return enough


def rare_words(items: list[Item], df: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, item) pairs by word, of each item's rarest words, and how many of them a text must hold."""
    words, of, need = [], [], np.zeros(len(items), np.int64)
    for i, item in enumerate(items):
        held = int(np.ceil(least[i] - 1e-9))
        need[i] = k = min(held, max(1, int(np.ceil(NEAR * item.n))))
        rare = np.unique(item.words[np.argsort(df[column_of(item.words)], kind="stable")[:item.n - held + k]])
        words, of = words + [rare], of + [np.full(len(rare), i)]
    words, of = np.concatenate(words), np.concatenate(of)
    order = np.argsort(words, kind="stable")
    return words[order], of[order], need


def near_runs(words: np.ndarray, row: np.ndarray, rare: tuple, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, item): where enough of an item's rare words stand within its reach in one text; ``row`` of each word."""
    names, of, need = rare
    known = np.unique(names)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    hit = np.flatnonzero(known[at] == words)
    first, last = np.searchsorted(names, known, "left"), np.searchsorted(names, known, "right")
    places, found = [], []
    for a in range(0, len(hit), CHUNK):
        # With the words behind the chunk that a run from its last place can reach.
        stop = np.searchsorted(hit, hit[min(a + CHUNK, len(hit)) - 1] + 2 * int(length.max()), "right")
        h, own = hit[a:stop], hit[min(a + CHUNK, len(hit)) - 1]
        w = at[h]
        n = last[w] - first[w]
        item = of[np.repeat(first[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        key = item.astype(np.int64) << 40 | np.repeat(h, n)
        key.sort()
        item, pos = key >> 40, key & (1 << 40) - 1
        to = np.arange(len(key)) + need[item] - 1
        ok = to < len(key)
        to = np.minimum(to, len(key) - 1)
        ok &= (item[to] == item) & (row[pos[to]] == row[pos]) & (pos[to] - pos < 2 * length[item]) & (pos <= own)
        places, found = places + [pos[ok]], found + [item[ok]]
    return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, start_word, end_word): the best window for each document and item it holds.

    Word positions count the words that aren't signs alone.
    """
    out = "doc_id long, item_id long, cosine double, lcs double, answer double, start_word long, end_word long"
    spark = docs.sparkSession
    items = read_items(benchmark)
    if not items:
        return spark.createDataFrame([], out)
    small_batches(spark)
    rows, df, total, n = corpus_pass(docs)
    if not n:
        return spark.createDataFrame([], out)
    space = latent_space(df, total, n)
    words = np.concatenate([i.words for i in items])
    passage = np.repeat(np.arange(len(items)), [i.n for i in items])
    # Long items are looked for by their parts: a window holds no more of them.
    parts = [-(-i.n // PART) for i in items]
    item_of = np.repeat(np.arange(len(items)), parts)
    part = np.concatenate([np.arange(i.n) * k // i.n for i, k in zip(items, parts)]) + np.repeat(np.cumsum(parts) - parts, [i.n for i in items])
    targets = np.zeros((len(item_of), space.shape[1]), np.float32)
    pair = np.unique(part * TERMS + column_of(words))
    np.add.at(targets, pair // TERMS, space[pair % TERMS])
    # For the cheap test: which columns are words of an item, and how many words it must be to go on.
    member = np.zeros((len(items), TERMS + 1), np.uint8)
    member[passage, column_of(words)] = 1
    least = np.array([i.n if i.n < SHORT else lcs * i.n for i in items])
    length = np.array([i.n for i in items])
    held = spark.sparkContext.broadcast((space, unit(targets), item_of, member, least, length, items, rare_words(items, df, least)))

    def run(batches):
        space, targets, item_of, member, least, length, items, rare = held.value
        names = [x.strip().split()[0] for x in out.split(",")]
        for part in slices(batches, "words"):
            sizes = pc.binary_length(part.column("words")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            words = np.frombuffer(b"".join(part.column("words").to_pylist()), np.uint32)
            starts, row = blocks(bounds)
            if not len(starts):
                continue
            column = column_of(words)
            z = project(space, starts, column)
            # The windows: each passage alone, and with its successor.
            more = np.flatnonzero(row[1:] == row[:-1])
            windows = np.concatenate([np.arange(len(z)), more])
            z = unit(np.concatenate([z, z[more] + z[more + 1]]))
            padded = np.append(column, TERMS)
            best: dict[tuple[int, int], tuple] = {}
            found = [near_runs(words, np.repeat(np.arange(len(sizes)), sizes), rare, length)]
            found[0] = (np.searchsorted(starts, found[0][0], "right") - 1, found[0][1])
            for a in range(0, len(z), 2048):
                w, t = np.nonzero(z[a:a + 2048] @ targets.T >= cosine)
                found.append((windows[a + w], item_of[t]))
            pairs = np.unique(np.concatenate([b for b, _ in found]) * len(items) + np.concatenate([i for _, i in found]))
            block, i = pairs // len(items), pairs % len(items)
            # Twice the item's length before the window and behind it.
            begin = np.maximum(bounds[row[block]], starts[block] - 2 * length[i])
            end = np.minimum(bounds[row[block] + 1], starts[block] + 2 * BLOCK + 2 * length[i])
            with_next = np.full(len(starts), -1)
            with_next[more] = np.arange(len(starts), len(z))
            for k in np.flatnonzero(holds_words(padded, begin, end, i, member, least, length)):
                match = items[i[k]].matches(words[begin[k]:end[k]], lcs, answer)
                if match:
                    at = [block[k], *with_next[[block[k]]][with_next[[block[k]]] >= 0]]
                    near = float((z[at] @ targets[item_of == i[k]].T).max())
                    value = (match[0], match[1], near, -int(begin[k]), int(end[k]))
                    r = int(row[block[k]])
                    best[r, i[k]] = max(best.get((r, i[k]), value), value)
            if best:
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[r], items[i].item_id, c, x, y, -b - int(bounds[r]), e - int(bounds[r])) for (r, i), (x, y, c, b, e) in best.items()]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return rows.mapInArrow(run, out)


def best_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each (doc_id, item_id) of :func:`leaks`."""
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("lcs"), F.desc("answer"), F.desc("cosine"), "start_word")
    return leaks(docs, benchmark).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, named by the hash of doc_id and text; all columns pass."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    gone = kept(docs.sparkSession, "decontaminate-gone",
                lambda: leaks(rows, benchmark).select(F.col("doc_id").alias("__row")).distinct())
    return docs.join(small_side(gone), F.xxhash64("doc_id", "text") == F.col("__row"), "left_anti")
