"""Quality classifier: interpolated modified Kneser-Ney trigrams of trusted text, perplexity per document, quantiles.

Trusted text are the documents labelled as good. Every word of them is in the vocabulary, by its 64-bit hash, however
many there are; a word equal to the one before it stands for "again" (repeated further, it is taught no more). Only counts
are stored, as compressed sorted arrays in a file per shard: of trigrams, of what follows each pair, continuation counts of
pairs and words; probabilities follow from them and three sets of discounts. The unigrams back off to a spelling
model, which also scores the words never seen: Kneser-Ney trigrams of the UTF-8 bytes of each distinct trusted word after
its shape (its tables are bounded by the 2^24 byte trigrams). Up to ``TABLE_ROWS`` trigrams (counted) each task looks the
counts up in sorted arrays; beyond that a slice of texts asks the shards for its distinct words and pairs, and the trigrams
whose pairs are known go to their shards, from where sums come back. Both give the same sums.

Trigrams are counted and texts scored in rounds, each over a part of the contexts or of the documents, so what is shuffled
at a time is a part of the whole; a round's shuffle files go when it ends.

Every fifth trusted document is left out of the counts; they show how clean text that the model hasn't seen scores.

A document's score is its mean negative log probability a word, drawn towards its language's trusted mean by
``PRIOR_WORDS`` words so that short texts aren't judged by a few words. Documents beyond the upper quantile of
their language's left-out trusted scores, widened by ``MARGIN`` times its distance from the middle, are rejected.

Rows: a null or empty text has no words and scores its language's mean (kept); a null lang is a language of its own; a
language without trusted documents takes the quantiles of all; repeated rows are judged each; without any trusted
document nothing is rejected; null labels teach nothing; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.llm.common import MIX, kept, mix, removed, scratch, slices, small_batches, small_side, split_words, stored, string_bytes, string_hashes
from ctxspark.llm.warc import filesystem

TABLE_ROWS = 1_000_000
#: Trusted words and bytes of text to a shard, and shards at least.
SHARD_ROWS, SHARD_BYTES, SHARDS = 1_000_000, 64 << 20, 24
#: Trusted words and bytes of text in one round, and rounds of each at most.
ROUND_WORDS, WORD_ROUNDS, ROUND_BYTES, TEXT_ROUNDS = 2_000_000, 3, 16 << 20, 12
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PRIOR_WORDS = 20
HIGH = 0.99
MARGIN = 0.8
#: Codes: 0 starts a text, 1 repeats the word before, 2 repeats it a second time or more, 3.. shapes, then words or bytes.
START, AGAIN, AGAIN_MORE, SHAPES = 0, 1, 2, 3
ENDS = ".,;:!?"
N_SHAPES = 4 * 4 * 3 * 5
WORD = SHAPES + N_SHAPES
LEAST = -50.0
#: Spelling: the bytes of a word follow its shape, and END follows them.
END = WORD + 256
#: Classes of bytes, and of those that follow 0xC3 (the letters of Latin-1).
IS_END, IS_PAUSE = (np.isin(np.arange(256), [ord(c) for c in x]) for x in (ENDS, ",;:"))
IS_UPPER = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))
IS_LETTER = IS_UPPER | (np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z"))
IS_LATIN = (np.arange(256) >= 0x80) & ~np.isin(np.arange(256), [0x97, 0xB7])
IS_LATIN_UPPER = IS_LATIN & (np.arange(256) < 0x9F)
GRAM = ["key", "k2", "k1", "c2", "c1"]
#: What a row of the tables or on its way between tasks holds.
TRI, PAIR, CONTEXT, FOLLOWED, WORD_COUNT, PART, STAT, TEXT, SUMS = range(9)
FLOW = "shard int, kind int, home long, data binary"
SUM_ROW = "home long, at int, row long, doc_id long, lang string, text_hash long, n_words long, nll double"
INFO = ["row", "doc_id", "lang", "text_hash"]


def shape(word: str) -> int:
    """Letter case (4) x final sign (4) x other signs (3) x length (5)."""
    bare = word.rstrip(ENDS)
    last = 0 if bare == word else 1 if word[len(bare):] in (",", ";", ":") else 2 if len(word) - len(bare) == 1 else 3
    letters = sum(c.isalpha() for c in bare)
    case = 0 if not letters else 1 if bare == bare.lower() else 2 if bare[0].isupper() and bare[1:] == bare[1:].lower() else 3
    odd = len(bare) - letters
    signs = 0 if not odd else 1 if odd <= letters / 3 else 2
    size = min(4, len(bare) // 4)
    return SHAPES + ((case * 4 + last) * 3 + signs) * 5 + size


def shapes(words: pa.Array) -> np.ndarray:
    """The shape of each of ``words`` (none empty); those of ASCII and Latin-1 letters come from the array's buffers."""
    start, data = string_bytes(words)
    if len(start) < 2:
        return np.zeros(0, np.int64)
    first, size = start[:-1], np.diff(start)
    if not size.all():
        return np.array([shape(w) for w in words.to_pylist()], np.int64)
    after = np.append(data[1:], np.uint8(0))
    latin = data == 0xC3
    at = np.arange(len(data))
    end = np.maximum(np.maximum.reduceat(np.where(IS_END[data], -1, at), first) + 1, first)
    bare = at < np.repeat(end, size)
    letter, upper = IS_LETTER[data] | latin & IS_LATIN[after], IS_UPPER[data] | latin & IS_LATIN_UPPER[after]
    length, letters, uppers = (np.add.reduceat(bare & x, first, dtype=np.int64) for x in (data & 0xC0 != 0x80, letter, upper))
    cut = start[1:] - end
    last = np.where(cut == 0, 0, np.where(cut > 1, 3, np.where(IS_PAUSE[data[np.minimum(end, len(data) - 1)]], 1, 2)))
    case = np.where(letters == 0, 0, np.where(uppers == 0, 1, np.where((uppers == 1) & upper[first], 2, 3)))
    odd = length - letters
    signs = np.where(odd == 0, 0, np.where(3 * odd <= letters, 1, 2))
    out = SHAPES + ((case * 4 + last) * 3 + signs) * 5 + np.minimum(4, length // 4)
    other = np.flatnonzero(np.maximum.reduceat((data >= 0xC0) & ~latin, first))
    out[other] = [shape(w) for w in words.take(pa.array(other)).to_pylist()]
    return out


def repeats(bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words equal the one before them in their text, and which of those follow another such word."""
    again = np.concatenate([[False], at[1:] == at[:-1]])
    again[bounds[:-1][bounds[:-1] < len(at)]] = False
    return again, np.concatenate([[False], again[1:] & again[:-1]])


def codes(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the code of each word: the one of ``known``, or its shape's."""
    bounds, words = split_words(texts, lower=False)
    if not len(words):
        return bounds, np.zeros(0, np.int64)
    one = np.array([known.get(w) or shape(w) for w in words.dictionary.to_pylist()], np.int64)
    at = words.indices.to_numpy(zero_copy_only=False)
    out = one[at]
    again, more = repeats(bounds, at)
    out[again] = AGAIN
    out[more] = AGAIN_MORE
    return bounds, out


def pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(mix(x * MIX + y) * MIX + np.uint64(1))


def word_grams(texts: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], pa.DictionaryArray, np.ndarray]:
    """Row offsets; for each word the hashes of its trigram, its bigram, itself, and the contexts of two and one; the
    words; and which are taught: a word repeated further has a code of its own that no table holds."""
    bounds, words = split_words(texts, lower=False)
    if not len(words):
        return bounds, {k: np.zeros(0, np.uint64) for k in GRAM}, words, np.zeros(0, bool)
    at = words.indices.to_numpy(zero_copy_only=False)
    code = string_hashes(words.dictionary)[at]
    again, more = repeats(bounds, at)
    unseen = mix(code[more] + np.uint64(AGAIN_MORE))
    code[again] = AGAIN
    code[more] = unseen
    first = bounds[:-1][np.diff(bounds) > 0]
    before = np.concatenate([np.zeros(1, np.uint64), code[:-1]])
    before[first] = START
    two = np.concatenate([np.zeros(1, np.uint64), before[:-1]])
    two[first] = START
    c2 = pair_hash(two, before)
    return bounds, {"key": pair_hash(c2, code), "k2": pair_hash(before, code), "k1": code, "c2": c2, "c1": before}, words, ~more


def spelling(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and the codes of each word's shape, bytes and end."""
    start, data = string_bytes(words)
    bounds = start + 2 * np.arange(len(start))
    out = np.empty(bounds[-1], np.int64)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[:-1]] = inside[bounds[1:] - 1] = False
    out[inside] = data.astype(np.int64) + WORD
    out[bounds[:-1]], out[bounds[1:] - 1] = shapes(words), END
    return bounds, out


def trigrams(bounds: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The trigram code that ends at each word; two start codes stand before each text."""
    first = np.zeros(len(word) + 1, bool)
    first[bounds[:-1]] = True
    first = first[:-1]
    before = np.concatenate([[0], word[:-1]]) if len(word) else word
    before[first] = START
    two = np.concatenate([[0], before[:-1]]) if len(word) else word
    two[first] = START
    return (two << 32) | (before << 16) | word


def counted(docs: DataFrame, make, schema: str) -> DataFrame:
    """Sum of (key, n) pairs that ``make(texts)`` yields as arrays, pre-aggregated in each task."""
    def run(batches):
        sums: dict = {}
        for part in slices(batches):
            keys, n = make(part.column("text"))
            for k, c in zip(keys, n):
                sums[k] = sums.get(k, 0) + c
            if len(sums) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.int64())], names=["key", "n"])
                sums = {}
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.int64())], names=["key", "n"])

    return docs.mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    def make(texts):
        _, words = split_words(texts, lower=False)
        if not len(words):
            return [], []
        return words.dictionary.to_pylist(), np.bincount(words.indices.to_numpy(zero_copy_only=False)).tolist()

    return counted(docs, make, "key string, n long")


def spelling_model(words: DataFrame) -> Model:
    """The byte trigrams of distinct ``words`` (text)."""
    def make(texts):
        keys, n = np.unique(trigrams(*spelling(texts)), return_counts=True)
        return keys.tolist(), n.tolist()

    return Model(kneser_ney(counted(words, make, "key long, n long"), END + 1))


def spelled(model: Model, words: pa.Array) -> np.ndarray:
    """The log probability of each word's spelling."""
    if not len(words):
        return np.zeros(0)
    bounds, code = spelling(words)
    key, at = np.unique(trigrams(bounds, code), return_inverse=True)
    return np.maximum(np.diff(np.concatenate([[0.0], np.cumsum(model.log_p(key)[at])])[bounds]), LEAST)


def discounts(counts: DataFrame, column: str) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n = {r[0]: r[1] for r in counts.where(F.col(column) <= 4).groupBy(column).count().collect()}
    return discounts_of([n.get(i, 0) for i in range(5)])


def discounts_of(n: list[int]) -> list[float]:
    if not n[1] or not n[2]:
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), float(i)) if n[i] else 0.5 * i for i in (1, 2, 3)]


def level(counts: DataFrame, context, lower: DataFrame, low_key, d: list[float]) -> tuple[DataFrame, DataFrame]:
    """One order: (key, p) interpolated with ``lower`` (low_key, lp), and the context's back-off weight (context, gamma)."""
    one = lambda i: F.count(F.when(F.col("c") == i if i < 3 else F.col("c") >= 3, 1))
    held = (counts.withColumn("context", context).groupBy("context")
            .agg(F.sum("c").alias("total"), ((one(1) * d[0] + one(2) * d[1] + one(3) * d[2]) / F.sum("c")).alias("gamma")))
    off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    p = (counts.withColumn("context", context).withColumn("low", low_key).join(held, "context").join(lower, "low")
         .select("key", "context", ((F.col("c") - off) / F.col("total") + F.col("gamma") * F.col("lp")).alias("p")))
    return p, held.select("context", "gamma")


def kneser_ney(counts: DataFrame, vocabulary: int) -> dict[str, DataFrame]:
    """Probability tables from trigram counts (key, n) with three 16-bit codes in a key: tri (key, context, p), bi (key,
    context, p), two and one (context, gamma), uni (key, p). What the unigrams leave is dealt evenly over the ``vocabulary``."""
    counts = (counts.withColumn("k2", F.expr("key & 4294967295")).withColumn("k1", F.expr("key & 65535"))
              .withColumn("c2", F.expr("shiftright(key, 16)")).withColumn("c1", F.expr("shiftright(key & 4294967295, 16)")))
    tri = stored(counts.select(*GRAM, F.col("n").alias("c")), "quality-tri")
    bi = stored(tri.groupBy(F.col("k2").alias("key"), "k1", "c1").agg(F.count("*").alias("c")), "quality-bi")
    uni = stored(bi.groupBy(F.col("k1").alias("key")).agg(F.count("*").alias("c")), "quality-uni")
    total = uni.agg(F.sum("c"), F.count("*")).first()
    d1 = discounts(uni, "c")
    off = F.when(F.col("c") == 1, d1[0]).when(F.col("c") == 2, d1[1]).otherwise(d1[2])
    held = uni.agg(F.sum(F.col("c") - off)).first()[0] or 0.0
    left = (1 - held / total[0]) if total[0] else 1.0
    uni_p = stored(uni.select("key", ((F.col("c") - off) / max(total[0] or 1, 1) + left / vocabulary).alias("p")), "quality-uni-p")
    lower = lambda df: df.select(F.col("key").alias("low"), F.col("p").alias("lp"))
    bi_p, one = level(bi, F.col("c1"), lower(uni_p), F.col("k1"), discounts(bi, "c"))
    bi_p = stored(bi_p, "quality-bi-p")
    tri_p, two = level(tri, F.col("c2"), lower(bi_p), F.col("k2"), discounts(tri, "c"))
    return {"tri": stored(tri_p, "quality-tri-p"), "two": stored(two, "quality-two"), "bi": bi_p,
            "one": stored(one, "quality-one"), "uni": uni_p, "rest": left / vocabulary}


def logs(p: np.ndarray) -> np.ndarray:
    """A back-off weight may be 0 where nothing is discounted."""
    return np.log(np.maximum(p, np.exp(LEAST)))


def short_logs(p: np.ndarray) -> np.ndarray:
    return logs(p).astype(np.float32)


def sorted_table(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    t = df.select(key, value).toArrow()
    keys, values = t.column(0).to_numpy().astype(np.int64), logs(t.column(1).to_numpy())
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default) -> tuple[np.ndarray, np.ndarray]:
    names, values = table
    if not len(names):
        return np.zeros(len(keys), bool), np.full(len(keys), default, np.float32)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    hit = names[at] == keys
    return hit, np.where(hit, values[at], np.float32(default))


class Model:
    """Tables by which a task looks up log probabilities of distinct trigram codes."""

    def __init__(self, tables: dict):
        self.tri, self.bi, self.uni = (sorted_table(tables[k], "key", "p") for k in ("tri", "bi", "uni"))
        self.two, self.one = (sorted_table(tables[k], "context", "gamma") for k in ("two", "one"))
        self.rest = float(np.log(tables["rest"]))

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Of trigrams with three 16-bit codes in a key."""
        k2 = key & 0xFFFFFFFF
        k1, c2, c1 = k2 & 0xFFFF, key >> 16, k2 >> 16
        hit, p = find(self.tri, key, 0)
        out = p.astype(np.float64)
        miss = np.flatnonzero(~hit)
        hit2, p2 = find(self.bi, k2[miss], 0)
        hit1, p1 = find(self.uni, k1[miss], 0)
        _, g1 = find(self.one, c1[miss], 0)
        _, g2 = find(self.two, c2[miss], 0)
        out[miss] = g2 + np.where(hit2, p2, g1 + np.where(hit1, p1, self.rest))
        return np.maximum(out, LEAST)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a query that wrote its result are removed when it ends, not when the driver collects
    its plan."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def squeezed(*columns: np.ndarray) -> bytes:
    """Numbers as bytes: each column's bytes of equal weight side by side, all compressed."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes, *types: str) -> list[np.ndarray]:
    n, sizes = int.from_bytes(data[:4], "little"), [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(data[4:], n * sum(sizes), codec="zstd"), np.uint8)
    ends = np.cumsum([0, *sizes]) * n
    return [np.ascontiguousarray(raw[i:e].reshape(-1, n).T).view(t).ravel() for i, e, t in zip(ends, ends[1:], types)]


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences; ``np.cumsum`` gives them back."""
    return np.diff(keys, prepend=np.uint64(0))


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ``keys``."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def distinct(*keys: np.ndarray) -> np.ndarray:
    """Sorted; quicker than NumPy's hashing."""
    out = np.sort(np.concatenate(keys))
    return out[starts(out)]


def sharded(keys: np.ndarray, parts: int):
    """(shard, indices) of ``keys``, in their order within a shard."""
    shard = (mix(keys) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    new = starts(shard[order])
    for s, e in zip(new, [*new[1:], len(keys)]):
        yield int(shard[order[s]]), order[s:e]


def messages(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (shard, kind, home, data) of FLOW."""
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["shard", "kind", "home", "data"])


def flow_rows(batches):
    for t in batches:
        yield from zip(*(t.column(c).to_pylist() for c in ("shard", "kind", "home", "data")))


def by_first(rows):
    """(first column, rows) of consecutive rows that agree in it."""
    at, held = None, []
    for r in rows:
        if held and r[0] != at:
            yield at, held
            held = []
        at = r[0]
        held.append(r)
    if held:
        yield at, held


def sums_by(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, new) if len(new) else np.zeros(0, values.dtype)


def classes(new: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Of each group that begins at ``new``: the sum of its counts, and how many of them are 1, 2 and more."""
    return [sums_by(new, x.astype(np.uint64)) for x in (counts, counts == 1, counts == 2, counts > 2)]


def stat(kind: int, counts: np.ndarray) -> tuple:
    """What the discounts of an order need: how many counts are 1, 2, 3 and 4, how many there are, and their sum."""
    n = np.array([*((counts == i).sum() for i in (1, 2, 3, 4)), len(counts), counts.sum()], np.uint64)
    return 0, STAT, kind, n.tobytes()


def in_round(keys: np.ndarray, rounds: int, i: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(40)) % np.uint64(rounds) == i


def contexts_of(gram: dict, at: np.ndarray, parts: int, i: int) -> list[tuple]:
    """A slice's taught trigrams of round ``i`` on their way to the shards of their contexts."""
    _, first, n = np.unique(gram["key"][at], return_index=True, return_counts=True)
    context, c = gram["c2"][at[first]], gram["k1"][at[first]]
    order = np.lexsort((c, context))
    context, c, n = context[order], c[order], n[order].astype(np.uint64)
    return [(s, CONTEXT, i, squeezed(steps(context[j]), c[j], n[j])) for s, j in sharded(context, parts)]


def contexts_counted(shard: int, rows: list[tuple], parts: int):
    """A shard's trigrams (key, n) and pairs (key, words seen before them, how often they were followed, followers seen
    once, twice, more)."""
    context, c, n = joined([r[3] for r in rows if r[1] == CONTEXT], "<u8", "<u8", "<u8")
    order = np.lexsort((c, context))
    context, c, n = context[order], c[order], n[order]
    new = starts(context, c)
    context, c, n = context[new], c[new], sums_by(new, n)
    key = pair_hash(context, c)
    order = np.argsort(key)
    if len(key):
        yield shard, TRI, 0, squeezed(steps(key[order]), n[order])
        yield stat(TRI, n)
    pair, seen = table_of([r[3] for r in rows if r[1] == PAIR], "<u8", "<u8")
    new = starts(context)
    keys = distinct(pair, context[new])
    columns = [np.zeros(len(keys), np.uint64) for _ in range(5)]
    columns[0][np.searchsorted(keys, pair)] = seen[0]
    for column, values in zip(columns[1:], classes(new, n)):
        column[np.searchsorted(keys, context[new])] = values
    yield shard, FOLLOWED, 0, squeezed(steps(keys), *columns)


def pairs_of(gram: dict, at: np.ndarray, parts: int, i: int) -> list[tuple]:
    """A slice's distinct taught trigrams of round ``i`` on their way to the shards of their last pairs."""
    at = at[np.unique(gram["key"][at], return_index=True)[1]]
    b, c, context = (gram[k][at] for k in ("c1", "k1", "c2"))
    order = np.lexsort((c, b))
    b, c, context = b[order], c[order], context[order]
    return [(s, PAIR, i, squeezed(steps(b[j]), c[j], context[j])) for s, j in sharded(pair_hash(b, c), parts)]


def pairs_counted(shard: int, rows: list[tuple], parts: int):
    """A shard's pairs (key, words seen before them), and its share of the counts by word."""
    b, c, context = joined([r[3] for r in rows], "<u8", "<u8", "<u8")
    order = np.lexsort((context, c, b))
    b, c, context = b[order], c[order], context[order]
    new = starts(b, c, context)
    b, c = b[new], c[new]
    new = starts(b, c)
    n = np.diff(np.append(new, len(b))).astype(np.uint64)
    b, c = b[new], c[new]
    key = pair_hash(b, c)
    order = np.argsort(key)
    yield shard, PAIR, rows[0][2], squeezed(steps(key[order]), n[order])
    yield stat(PAIR, n)
    new = starts(b)
    last, n_last = np.unique(c, return_counts=True)
    word = np.unique(np.concatenate([b[new], last]))
    columns = [np.zeros(len(word), np.uint64) for _ in range(5)]
    columns[0][np.searchsorted(word, last)] = n_last
    for column, values in zip(columns[1:], classes(new, n)):
        column[np.searchsorted(word, b[new])] = values
    for s, j in sharded(word, parts):
        yield 0, PART, s, squeezed(steps(word[j]), *(x[j] for x in columns))


def words_counted(shard: int, rows: list[tuple], parts: int):
    """A shard's words (key, words seen before, pairs that begin with it: how often, and those seen once, twice, more)."""
    word, *columns = joined([r[3] for r in rows], *["<u8"] * 6)
    order = np.argsort(word)
    new = starts(word[order])
    columns = [np.add.reduceat(x[order], new) for x in columns]
    yield shard, WORD_COUNT, 0, squeezed(steps(word[order][new]), *columns)
    yield stat(WORD_COUNT, columns[0][columns[0] > 0])


def joined(data: list[bytes], *types: str) -> list[np.ndarray]:
    """The columns of all ``data``, the first one given by its steps."""
    parts = [unsqueezed(d, *types) for d in data]
    return [np.concatenate([np.zeros(0, t), *((np.cumsum(p[i]) if not i else p[i]) for p in parts)]) for i, t in enumerate(types)]


def table_of(data: list[bytes], *types: str) -> tuple:
    """Sorted keys and their columns."""
    keys, *columns = joined(data, *types)
    order = np.argsort(keys, kind="stable")  # which merges what is sorted
    return keys[order], [c[order] for c in columns]


def values_of(table: tuple, keys: np.ndarray) -> list[np.ndarray]:
    """The columns at ``keys``, 0 where a key isn't held."""
    names, columns = table
    if not len(names):
        return [np.zeros(len(keys), c.dtype) for c in columns]
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    hit = names[at] == keys
    return [np.where(hit, c[at], c.dtype.type(0)) for c in columns]


#: The columns of each stored table after its keys.
COLUMNS = {TRI: 1, FOLLOWED: 5, WORD_COUNT: 5}


class Counts:
    """The stored counts of the trusted text, and what turns them into probabilities."""

    def __init__(self, path: str, parts: int, stats: dict[int, np.ndarray]):
        self.path, self.parts = path, parts
        d = {k: discounts_of([0, *(int(x) for x in stats[k][:4])]) if k in stats else [0.5, 0.75, 0.9] for k in (WORD_COUNT, PAIR, TRI)}
        self.d1, self.d2, self.d3 = d[WORD_COUNT], d[PAIR], d[TRI]
        n1, n2, _, _, n, self.total = (int(x) for x in stats[WORD_COUNT]) if WORD_COUNT in stats else [0] * 6
        self.n_trigrams = int(stats[TRI][4]) if TRI in stats else 0
        self.left = (n1 * self.d1[0] + n2 * self.d1[1] + (n - n1 - n2) * self.d1[2]) / self.total if self.total else 1.0

    def shard(self, kind: int, shard: int) -> tuple:
        """A shard of a table, read by a task."""
        fs, root = filesystem(self.path)
        files = fs.get_file_info(pafs.FileSelector(f"{root}/kind={kind}/shard={shard}", allow_not_found=True))
        data = []
        for x in files:
            if x.base_name.endswith(".parquet"):
                with fs.open_input_file(x.path) as f:
                    data += pq.ParquetFile(f).read(columns=["data"]).column("data").to_pylist()
        return table_of(data, *["<u8"] * (1 + COLUMNS[kind]))


def grouped_by_shard(batches, make, parts: int):
    for shard, rows in by_first(flow_rows(batches)):
        yield messages(list(make(shard, rows, parts)))


def count_trusted(trusted: DataFrame, n_words: int, n_bytes: int) -> Counts:
    """Counts of the words of ``trusted`` (text), ``n_words`` of them."""
    spark = trusted.sparkSession
    small_batches(spark)
    parts = max(SHARDS, -(-n_words // SHARD_ROWS), -(-n_bytes // (SHARD_BYTES * TEXT_ROUNDS)))
    rounds = min(max(1, -(-n_words // ROUND_WORDS)), WORD_ROUNDS)
    path = scratch(spark, "quality-counts")

    def count(flow: DataFrame, make) -> None:
        flow = flow.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(lambda b: grouped_by_shard(b, make, parts), FLOW)
        flow.write.partitionBy("kind", "shard").option("compression", "uncompressed").mode("append").parquet(path)

    def taught(of, by: str, i: int) -> DataFrame:
        def run(batches):
            for part in slices(batches):
                _, gram, _, taught = word_grams(part.column("text"))
                # Runs of one word teach nothing: they stay as improbable as a word never seen.
                at = np.flatnonzero(taught & in_round(gram[by], rounds, i))
                if len(at):
                    yield messages(of(gram, at, parts, i))

        return trusted.mapInArrow(run, FLOW)

    if not n_words:
        return Counts(path, parts, {})
    for i in range(rounds):
        count(taught(pairs_of, "k2", i), pairs_counted)
    shares = f"{path}/kind={PART}"
    count(spark.read.schema("home long, data binary").parquet(shares)
          .selectExpr("CAST(home AS INT) AS shard", f"{PART} AS kind", "home", "data"), words_counted)
    removed(spark, shares)
    for i in range(rounds):
        # Pairs and contexts of a key meet in the same shard and round: one table holds both.
        pairs = spark.read.schema(FLOW).parquet(f"{path}/kind={PAIR}").where(F.col("home") == i).selectExpr("shard", f"{PAIR} AS kind", "home", "data")
        count(taught(contexts_of, "c2", i).unionByName(pairs), contexts_counted)
    removed(spark, f"{path}/kind={PAIR}")
    stats: dict[int, np.ndarray] = {}
    for r in spark.read.schema("home long, data binary").parquet(f"{path}/kind={STAT}").groupBy("home").agg(F.collect_list("data")).collect():
        stats[r[0]] = sum(np.frombuffer(d, np.uint64) for d in r[1])
    return Counts(path, parts, stats)


def chunk_keys(gram: dict) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and pairs that a slice asks for."""
    return distinct(gram["k1"], gram["c1"]), distinct(gram["k2"], gram["c2"])


def weights(counts: list[np.ndarray], d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often contexts were seen, their back-off weights, and the logarithms of those (0 where never seen)."""
    n, one, two, more = counts
    gamma = (one * d[0] + two * d[1] + more * d[2]) / n
    return n, gamma, np.where(n > 0, short_logs(gamma), np.float32(0))


def off(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return counts - np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2]))


def lower_orders(gram: dict, base: np.ndarray, model: Counts, words: tuple, pairs: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of trigrams: the log probability if they aren't counted themselves, how often their context is where they may be, and
    what the lower orders add to their own share then.
    ``words`` and ``pairs`` are tables of all the slice's words and pairs, with zeros for those not known; ``base`` is the log
    probability of the words' spelling."""
    (word, (seen, *after)), (pair, (before, *follows)) = words, pairs
    with np.errstate(divide="ignore", invalid="ignore"):
        n2, gamma2, log2 = weights(after, model.d2)
        n3, gamma3, log3 = weights(follows, model.d3)
        at, of = np.searchsorted(word, gram["k1"]), np.searchsorted(word, gram["c1"])
        known, n, gamma = seen[at], n2[of], gamma2[of]
        spelt = np.where(gram["k1"] == AGAIN, 0.0, np.exp(base))
        p1 = off(known, model.d1) / max(model.total, 1) + model.left * spelt
        below = log2[of] + np.where(known > 0, short_logs(p1), np.log(model.left) + base)
        at, of = np.searchsorted(pair, gram["k2"]), np.searchsorted(pair, gram["c2"])
        held = before[at]
        p2 = off(held, model.d2) / n + gamma * p1
        below = log3[of] + np.where(held > 0, short_logs(p2), below)
        return below, np.where(held > 0, n3[of], 0), gamma3[of] * p2


def counted_log(n: np.ndarray, context: np.ndarray, below: np.ndarray, rest: np.ndarray, model: Counts) -> np.ndarray:
    """The log probability of trigrams counted ``n`` times (0: never), with what ``lower_orders`` gives of them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, short_logs(off(n, model.d3) / context + rest), below)


def lookup_sums(docs: DataFrame, speller: Model, model: Counts) -> DataFrame:
    """``docs`` columns plus (n_words, nll) with the tables broadcast."""
    spark, names = docs.sparkSession, docs.columns
    tables = {k: table_of([], *["<u8"] * (1 + n)) for k, n in COLUMNS.items()}
    if model.n_trigrams:
        for k, n in COLUMNS.items():
            rows = spark.read.schema("data binary").parquet(f"{model.path}/kind={k}").collect()
            tables[k] = table_of([r[0] for r in rows], *["<u8"] * (1 + n))
    held = spark.sparkContext.broadcast((speller, model, tables))

    def run(batches):
        speller, model, tables = held.value
        for part in slices(batches):
            bounds, gram, words, _ = word_grams(part.column("text"))
            sums = np.zeros(len(bounds))
            if len(words):
                base = spelled(speller, words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
                _, first, at = np.unique(gram["key"], return_index=True, return_inverse=True)
                gram = {k: g[first] for k, g in gram.items()}
                ones, pairs = chunk_keys(gram)
                below, context, rest = lower_orders(gram, base[first], model, (ones, values_of(tables[WORD_COUNT], ones)),
                                              (pairs, values_of(tables[FOLLOWED], pairs)))
                n = np.where(context > 0, values_of(tables[TRI], gram["key"])[0], 0)
                p = counted_log(n, context, below, rest, model)
                sums = np.concatenate([[0.0], np.cumsum(p[at])])[bounds]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names if c != "text"), pa.array(np.diff(bounds)),
                                              pa.array(-np.diff(sums))], names=[*(c for c in names if c != "text"), "n_words", "nll"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return stored(docs.mapInArrow(run, f"{schema}, n_words long, nll double"), "quality-sums")


def asked(part: pa.RecordBatch, home: int, parts: int):
    """What a slice of texts sends: itself, and its distinct words and pairs to their shards."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(part)
    yield home % parts, TEXT, home, sink.getvalue().to_pybytes()
    _, gram, words, _ = word_grams(part.column("text"))
    if len(words):
        for kind, keys in zip((WORD_COUNT, FOLLOWED), chunk_keys(gram)):
            for s, j in sharded(keys, parts):
                yield s, kind, home, squeezed(steps(keys[j]))


def answered(rows, model: Counts):
    """The counts of the words and pairs that slices asked a shard for, in the order of the keys."""
    at, table = None, None
    for shard, kind, home, data in rows:
        if kind == TEXT:
            yield -1, TEXT, home, data
            continue
        if (shard, kind) != at:
            at, table = (shard, kind), model.shard(kind, shard)
        yield shard, kind, home, squeezed(*values_of(table, np.cumsum(unsqueezed(data, "<u8")[0])))


def combined(home: int, rows: list[tuple], speller: Model, model: Counts):
    """A slice of texts with what the shards answered: the sums of what is known, and the trigrams that may be counted."""
    data = {(r[2], r[1]): r[3] for r in rows}
    part = pa.ipc.open_stream(data[TEXT, -1]).read_next_batch()
    bounds, gram, words, _ = word_grams(part.column("text"))
    nll = np.zeros(part.num_rows)
    if len(words):
        tables = []
        for kind, keys in zip((WORD_COUNT, FOLLOWED), chunk_keys(gram)):
            columns = [np.zeros(len(keys), np.uint64) for _ in range(5)]
            for s, j in sharded(keys, model.parts):
                for column, values in zip(columns, unsqueezed(data[kind, s], *["<u8"] * 5)):
                    column[j] = values
            tables.append((keys, columns))
        base = spelled(speller, words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        _, first, at = np.unique(gram["key"], return_index=True, return_inverse=True)
        gram = {k: g[first] for k, g in gram.items()}
        below, context, _ = lower_orders(gram, base[first], model, *tables)
        of, maybe = np.repeat(np.arange(part.num_rows), np.diff(bounds)), context[at] > 0
        nll = -np.bincount(of[~maybe], weights=below[at[~maybe]], minlength=part.num_rows)
        row_gram, n = np.unique(at[maybe].astype(np.int64) * part.num_rows + of[maybe], return_counts=True)
        at, of = np.divmod(row_gram, part.num_rows)
        for s, j in sharded(gram["c2"][at], model.parts):
            k = at[j]
            yield s, TRI, home, squeezed(steps(gram["key"][k]), context[k].astype(np.uint64), below[k].astype(np.float32), of[j].astype(np.uint32), n[j].astype(np.uint32))
    done = pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, home)), pa.array(np.arange(part.num_rows, dtype=np.int32)), *(part.column(c) for c in INFO),
                                       pa.array(np.diff(bounds)), pa.array(nll)], names=[x.split()[0] for x in SUM_ROW.split(", ")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, done.schema) as out:
        out.write_batch(done)
    yield home % model.parts, SUMS, home, sink.getvalue().to_pybytes()


def looked_up(rows, model: Counts):
    """Sums by text of the trigrams that came to a shard, and those that came with them."""
    names, info = [x.split()[0] for x in SUM_ROW.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    held, table = None, None
    for shard, kind, home, data in rows:
        if kind == SUMS:
            yield pa.ipc.open_stream(data).read_next_batch()
            continue
        if shard != held:
            held, table = shard, model.shard(TRI, shard)
        key, context, below, of, n = unsqueezed(data, "<u8", "<u8", "<f4", "<u4", "<u4")
        below = below.astype(np.float64)
        p = counted_log(values_of(table, np.cumsum(key))[0], context, below, np.exp(below), model)
        text, at = np.unique(of, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(text), home)), pa.array(text.astype(np.int32)), *(pa.nulls(len(text), t) for t in info),
                                          pa.array(-np.bincount(at, weights=p * n))], names=names)


def joined_sums(docs: DataFrame, speller: Model, model: Counts, n_bytes: int) -> DataFrame:
    """The same for tables of any size: slices of texts ask the shards of the tables, a part of the texts at a time."""
    spark, parts = docs.sparkSession, model.parts
    held = spark.sparkContext.broadcast(speller)
    rounds = min(max(1, -(-n_bytes // ROUND_BYTES)), TEXT_ROUNDS)
    path = scratch(spark, "quality-sums")

    def ask(batches):
        for part in slices(batches):
            yield messages(list(asked(part, part.column("row")[0].as_py(), parts)))

    def answer(batches):
        for row in answered(flow_rows(batches), model):
            yield messages([row])

    def combine(batches):
        rows = ((home, shard, kind, data) for shard, kind, home, data in flow_rows(batches))
        for home, group in by_first(rows):
            yield messages(list(combined(home, group, held.value, model)))

    for i in range(rounds):
        some = docs.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(rounds)) == i).select(*INFO, "text")
        flow = some.mapInArrow(ask, FLOW).repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, FLOW)
        flow = flow.repartition(parts, "home").sortWithinPartitions("home").mapInArrow(combine, FLOW)
        flow = flow.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(lambda b: looked_up(flow_rows(b), model), SUM_ROW)
        sums = flow.groupBy("home", "at").agg(*(F.max(c).alias(c) for c in [*INFO, "n_words"]), F.sum("nll").alias("nll"))
        sums.drop("home", "at").write.mode("append").parquet(path)
    return spark.read.schema(sums.drop("home", "at").schema).parquet(path)


def score_documents(docs: DataFrame, labels: DataFrame, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(row, doc_id, lang, text_hash, n_words, nll, score, high, keep) per row of ``docs`` (row, doc_id, text, lang)."""
    good = small_side(labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    # Every fifth trusted document (by its id's hash) is left out of the counts: it shows how unseen clean text scores.
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    trusted = docs.join(good, "doc_id", "left_semi").where(~unseen).select("text")
    text = docs.select("row", "doc_id", "lang", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    with freed_shuffles(docs.sparkSession):
        words = stored(word_counts(trusted).select(F.col("key").alias("text"), "n"), "quality-words")
        speller = spelling_model(words.select("text"))
        n_bytes = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        counts = count_trusted(trusted, words.agg(F.sum("n")).first()[0] or 0, n_bytes)
        sums = lookup_sums(text, speller, counts) if counts.n_trigrams <= table_rows else joined_sums(text, speller, counts, n_bytes)
    sums = sums.withColumn("lang_key", F.coalesce("lang", F.lit("")))
    seen = sums.join(good, "doc_id", "left_semi").where("n_words > 0")
    mean = stored(seen.groupBy("lang_key").agg((F.sum("nll") / F.sum("n_words")).alias("mean")), "quality-mean")
    overall = seen.agg((F.sum("nll") / F.sum("n_words")).alias("m")).first()["m"]
    smooth = (F.col("nll") + PRIOR_WORDS * F.col("mean")) / (F.col("n_words") + PRIOR_WORDS)
    with_mean = lambda df: df.join(F.broadcast(mean), "lang_key", "left").fillna(overall or 0.0, ["mean"])
    # One row a language; quantiles of every trusted document's score.
    fresh = F.when(unseen, F.col("score"))
    cuts = [F.percentile_approx(fresh, q, 10_000).alias(n) for q, n in ((0.5, "mid"), (HIGH, "hi"))]
    q = with_mean(seen).withColumn("score", smooth)
    by, whole = q.groupBy("lang_key").agg(*cuts), q.agg(*cuts).first()
    scored = with_mean(sums).withColumn("score", smooth).join(F.broadcast(by), "lang_key", "left")
    if whole["mid"] is not None:
        scored = scored.fillna({c: whole[c] for c in ("mid", "hi")})
    scored = scored.withColumn("high", F.col("hi") + MARGIN * (F.col("hi") - F.col("mid")))
    keep = F.coalesce((F.col("n_words") == 0) | (F.col("score") <= F.col("high")), F.lit(True))
    return scored.select("row", "doc_id", "lang", "text_hash", "n_words", "nll", "score", "high", keep.alias("keep"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, score, high, keep) per row of ``docs`` (doc_id, text, lang)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text", "lang")
    perplexity = F.exp(F.col("nll") / F.greatest("n_words", F.lit(1)))
    return score_documents(rows, labels).select("doc_id", "lang", "n_words", perplexity.alias("perplexity"), "score", "high", "keep")


def reject_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text, lang) that are kept; all columns pass through.

    Rows of equal doc_id, text and lang have equal scores, so the rejected ones are named by those.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    gone = kept(docs.sparkSession, "quality-rejected", lambda: score_documents(rows, labels).where(~F.col("keep")).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("lang").alias("__lang")).distinct())
    gone = small_side(gone)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")) & F.col("lang").eqNullSafe(F.col("__lang"))
    return docs.join(gone, same, "left_anti")
