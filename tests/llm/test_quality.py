import collections
import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from ctxspark.llm import quality as ql
from tests.llm.conftest import prose


def counts_of(sequences):
    tri = collections.Counter()
    for s in sequences:
        padded = [ql.START, ql.START, *s]
        tri.update((padded[i], padded[i + 1], padded[i + 2]) for i in range(len(s)))
    return tri


def reference(tri, vocabulary):
    """Interpolated modified Kneser-Ney as the definition has it: a function (a, b, c) -> p."""
    bi, uni = collections.Counter(), collections.Counter()
    for a, b, c in tri:
        bi[b, c] += 1
    for b, c in bi:
        uni[c] += 1

    def discount(counts):
        n = collections.Counter(min(c, 5) for c in counts.values())
        if not n[1] or not n[2]:
            return [0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), float(i)) if n[i] else 0.5 * i for i in (1, 2, 3)]

    d3, d2, d1 = discount(tri), discount(bi), discount(uni)

    def back(counts, d):
        total, gamma = collections.Counter(), collections.Counter()
        for k, c in counts.items():
            total[k[:-1]] += c
            gamma[k[:-1]] += d[min(c, 3) - 1]
        return total, gamma

    t3, g3 = back(tri, d3)
    t2, g2 = back(bi, d2)
    all1 = sum(uni.values())
    rest = sum(d1[min(c, 3) - 1] for c in uni.values()) / all1

    def p(a, b, c):
        p1 = (max(uni[c] - d1[min(uni[c], 3) - 1], 0) if uni[c] else 0) / all1 + rest / vocabulary
        p2 = p1
        if t2[b,]:
            p2 = ((bi[b, c] - d2[min(bi[b, c], 3) - 1]) if bi[b, c] else 0) / t2[b,] + g2[b,] / t2[b,] * p1
        if not t3[a, b]:
            return p2
        return ((tri[a, b, c] - d3[min(tri[a, b, c], 3) - 1]) if tri[a, b, c] else 0) / t3[a, b] + g3[a, b] / t3[a, b] * p2

    return p


def test_kneser_ney_equals_its_definition(spark):
    r = random.Random(3)
    sequences = [[min(int(r.expovariate(0.3)) + 3, 30) for _ in range(r.randint(1, 60))] for _ in range(40)]
    tri = counts_of(sequences)
    p = reference(tri, 31)
    keys = [((a << 32) | (b << 16) | c, n) for (a, b, c), n in tri.items()]
    tables = ql.kneser_ney(spark.createDataFrame(keys, "key long, n long"), 31)
    model = ql.Model(tables)
    for _ in range(500):
        a, b, c = (r.randrange(32) for _ in range(3))
        assert model.log_p(np.array([(a << 32) | (b << 16) | c]))[0] == pytest.approx(math.log(p(a, b, c)), abs=1e-4)
    assert sum(math.exp(model.log_p(np.array([(3 << 32) | (4 << 16) | c]))[0]) for c in range(31)) == pytest.approx(1, abs=1e-4)


def test_codes():
    known = {"the": 900}
    bounds, word = ql.codes(pa.array(["the the the the cat", "cat", "", "Cat! CAT 12"]), known)
    assert bounds.tolist() == [0, 5, 6, 6, 9]
    assert word[:4].tolist() == [900, ql.AGAIN, ql.AGAIN_MORE, ql.AGAIN_MORE]
    assert word[4] == word[5] == ql.shape("cat") and len({*word[5:].tolist()}) == 4
    key = ql.trigrams(bounds, word.copy())
    assert key[5] == word[5] and key[1] == (900 << 16) | ql.AGAIN and key[0] == 900


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    common = "of the and to in a is".split()
    clean = lambda: " ".join(r.choice(common) if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
                             for _ in range(r.randint(20, 200)))
    rows = [(i, clean(), "en" if i % 2 else "de") for i in range(400)]
    junk = [(1000 + i, " | ".join(clean().upper().split()), "en") for i in range(20)] + [(1100 + i, "again " * 80, "de") for i in range(5)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, clean(), None), (2003, clean(), "xx"), (0, rows[0][1], "de"), (None, clean(), "en")]
    labels = [(i, 1, 0) for i in range(300)] + [(1000, 0, 0), (None, 1, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS row", "2 AS n_words", "3 AS keep").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_text_stays(corpus):
    docs, labels = corpus
    got = ql.quality(docs, labels).collect()
    assert len(got) == docs.count()
    gone = {x["doc_id"] for x in got if not x["keep"]}
    assert gone >= {*range(1000, 1020), *range(1100, 1105)} and len(gone) <= 25 + 4
    assert not gone & {2000, 2001, 2002, 2003}
    kept = ql.reject_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(got) - sum(not x["keep"] for x in got)


def test_joined_and_broadcast_tables_agree(corpus):
    docs, labels = corpus
    rows = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id", "text", "lang")
    a, b = ({x["row"]: x for x in ql.score_documents(rows, labels, n).collect()} for n in (10**9, 0))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["score"] == pytest.approx(b[k]["score"], rel=1e-4) and a[k]["n_words"] == b[k]["n_words"]


def test_without_trusted_documents_or_rows(spark, corpus):
    docs, labels = corpus
    assert {x["keep"] for x in ql.quality(docs, labels.where("quality = 7")).collect()} == {True}
    assert ql.quality(docs.where("doc_id = -1"), labels).collect() == []
    assert ql.reject_low_quality(docs.where("doc_id = -1"), labels).collect() == []
    assert prose(random.Random(1), 3)


def test_words_beyond_any_list_are_told_apart(spark):
    """Thousands of trusted words, none of them frequent: text whose words got random consonants in place goes."""
    r = random.Random(5)
    stems = ["".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(2500)]
    text = lambda: " ".join(r.choice(stems) for _ in range(80))
    garbled = lambda: " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in w) for w in text().split())
    rows = [(i, text(), "en") for i in range(400)] + [(1000 + i, garbled(), "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    gone = {x["doc_id"] for x in ql.quality(docs, labels).collect() if not x["keep"]}
    assert gone >= {*range(1000, 1030)} and len(gone) <= 30 + 6


def test_shapes_of_a_column_equal_those_of_single_words():
    r = random.Random(9)
    words = ["".join(r.choice("abAZ.,;:!?12-éÄß×÷Þ語_µ") for _ in range(r.randint(1, 14))) for _ in range(20000)] + ["...", "A.", "?!", "x"]
    assert ql.shapes(pa.array(["skipped", *words]).slice(1)).tolist() == [ql.shape(w) for w in words]
    bounds, code = ql.spelling(pa.array(["Où!", "a"]))
    assert bounds.tolist() == [0, 6, 9] and code[6:].tolist() == [ql.shape("a"), ql.WORD + ord("a"), ql.END]
    assert code[1:5].tolist() == [ql.WORD + b for b in "Où!".encode()]


def test_rounds_and_shards_agree_with_one_table_and_store_little(spark, corpus, monkeypatch):
    """Trigrams counted and texts scored in parts give the sums of one table; what is stored stays far below a row of
    numbers a trigram."""
    docs, labels = corpus
    rows = docs.selectExpr("monotonically_increasing_id() AS row", "doc_id", "text", "lang")
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    a = {x["row"]: x for x in ql.score_documents(rows, labels, 10**9).collect()}
    for name, value in (("SHARDS", 5), ("SHARD_ROWS", 10**6), ("ROUND_WORDS", 10_000), ("ROUND_BYTES", 100_000)):
        monkeypatch.setattr(ql, name, value)
    before = {*folder.glob("llm-quality-*")}
    b = {x["row"]: x for x in ql.score_documents(rows, labels, 0).collect()}
    made = sum(f.stat().st_size for d in {*folder.glob("llm-quality-*")} - before for f in d.rglob("*.parquet"))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["nll"] == pytest.approx(b[k]["nll"], rel=1e-4) and a[k]["keep"] == b[k]["keep"]
        assert [a[k][c] for c in ("doc_id", "lang", "text_hash", "n_words")] == [b[k][c] for c in ("doc_id", "lang", "text_hash", "n_words")]
    words = sum(len((t or "").split()) for (t,) in {(x["text"],) for x in docs.where("doc_id < 300").collect()})
    assert made < 50 * words
