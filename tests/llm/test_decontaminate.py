import random

import numpy as np
import pytest

from ctxspark.llm import decontaminate as dc
from tests.llm.conftest import prose


def test_common_subsequence_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 20))] for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        assert dc.Item.common(dc.Item._masks(np.array(a)), len(a), b) == row[-1][-1]


def test_latent_space_finds_the_leading_directions():
    r = np.random.default_rng(5)
    base = r.standard_normal((400, 12)) * np.linspace(20, 4, 12)
    a = base @ r.standard_normal((12, dc.TERMS)).astype(np.float32)
    gram_omega = a.T @ (a @ dc.test_matrix())
    n = 400
    df = np.full(dc.TERMS, n // 4)
    space = dc.latent_space(df, gram_omega, n)
    idf = np.log((n + 1) / (n // 4 + 0.5)) + 1e-3
    z = a @ space[:, :12 - dc.COMMON]
    u, s, _ = np.linalg.svd(a * idf, full_matrices=False)
    assert np.allclose(np.linalg.norm(z, axis=0), 1, atol=0.02)  # divided by the singular values
    assert np.linalg.svd(u[:, dc.COMMON:12].T @ z)[1].min() > 0.98


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(11)
    items = [prose(r, n, 3000) + ". " + prose(r, 6, 3000) + "." for n in (12, 20, 30, 45, 60)]
    items += ["", None, "rare tiny item", "...!!!"]
    docs = []
    for i in range(300):
        words = prose(r, r.randint(1, 400), 3000).split()
        docs.append((i, " ".join(words)))
    truth = set()
    for i in range(40):
        k = i % 5
        words = items[k].split()
        if i >= 20:  # a paraphrase: some words changed, some put in
            for _ in range(len(words) // 8):
                words[r.randrange(len(words) - 7)] = "changed"
            words.insert(len(words) // 2, "inserted")
        docs.append((1000 + i, f"{prose(r, r.randint(0, 150), 3000)}\n{' '.join(words).upper() if i % 2 else ' '.join(words)} {prose(r, r.randint(0, 150), 3000)}"))
        truth.add((1000 + i, k))
    docs += [(2000, None), (2001, ""), (None, items[3]), (2002, "rare tiny item"), (2003, items[4]), (2003, items[4]), (2004, "!!! ...")]
    truth |= {(None, 3), (2002, 7), (2003, 4)}
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS lcs").repartition(3)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    return d, b, truth


def test_leaks_and_paraphrases_are_found_alone(world):
    docs, items, truth = world
    got = dc.best_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth and len(got) == len(truth)
    assert all(0.6 <= r["lcs"] <= 1 and r["start_word"] < r["end_word"] for r in got)


def test_without_leaks(world):
    docs, items, truth = world
    out = dc.without_leaks(docs, items)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - {i for i, _ in truth}


def test_empty_tables(world):
    docs, items, _ = world
    assert dc.leaks(docs.where("false"), items).collect() == []
    assert dc.leaks(docs, items.where("false")).collect() == []
    assert dc.leaks(docs.where("doc_id >= 2000 and doc_id < 2002"), items).collect() == []
    assert dc.without_leaks(docs, items.where("false")).count() == docs.count()


def test_verbatim_items_of_any_length_are_found(spark):
    r = random.Random(4)
    items = [prose(r, n - 12, 3000) + ". " + prose(r, 12, 3000) + "." for n in (150, 220, 500)]
    docs = [(i, prose(r, r.randint(50, 900), 3000)) for i in range(150)]
    docs += [(1000 + i, f"{prose(r, 7 * i, 3000)} {items[i % 3]} {prose(r, 50, 3000)}") for i in range(30)]
    got = dc.best_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                        spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(1000 + i, i % 3) for i in range(30)}
    assert all(x["lcs"] == 1 for x in got)


@pytest.mark.parametrize("changed", [0, 0.2, 0.35])
def test_every_text_that_the_rules_accept_is_found(spark, changed):
    """Short and paraphrased items in texts of their own kind of words, against the rules applied at every place."""
    r = random.Random(int(100 * changed))
    items = [prose(r, n, 300) for n in (3, 5, 7, 9, 12, 15, 18, 24, 32, 40) for _ in range(4)]
    docs = []
    for i, item in enumerate(items * 4):
        words = item.split()
        if len(words) >= 8:
            for p in r.sample(range(len(words)), int(changed * len(words))):
                words[p] = f"w{r.randrange(300)}"
        docs.append((i, f"{prose(r, r.randint(0, 200), 300)} {' '.join(words)} {prose(r, r.randint(0, 200), 300)}"))
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in dc.best_leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    truth = set()
    for d, text in docs:
        words = dc.terms(dc.pa.array([text]))[1]
        for item in dc.read_items(b.where(f"item_id = {d % len(items)}")) if d < 12 or d % 5 == 0 else []:
            n = item.n
            least = n if n < dc.SHORT else dc.LCS * n
            for a in range(len(words)):
                # a text of 1.5 times the item's length lies in one of the compared runs wherever they begin
                held = words[a:a + n + n // 2].tolist()
                if dc.Item.common(item.masks, n, held) >= least and dc.Item.common(item.answer_masks, n - item.answer, held) >= dc.ANSWER * (n - item.answer):
                    truth.add((d, item.item_id))
    assert len(truth) > 20 and truth <= got
