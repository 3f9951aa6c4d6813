import itertools
import random
import zlib

import pytest

from ctxspark.llm.toxicity import TermAutomaton, allowed_edits, quoted, score_toxicity
from tests.llm.conftest import prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(1)
    terms = ["scum", "loser", "closer", "worthless", "disgusting", "a"]
    automaton = TermAutomaton(terms)
    words = {"".join(r.choice("loserwthcumdigna") for _ in range(r.randint(0, 11))) for _ in range(3000)}
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(r.randint(0, 3)):
                p = r.randrange(len(w) + 1)
                w[p:p + r.randint(0, 1)] = r.choice([[], ["é"], ["o"], ["s"]])
            words.add("".join(w))
    for w in words:
        reach = [d for t in terms if (d := distance(w, t)) <= allowed_edits(t)]
        assert automaton.match(w) == min(reach, default=None), w


def test_context_tells_quotation():
    assert quoted(["he", "said"], "idiot") == 1 and quoted(["he", "is"], "idiot") == 0
    assert quoted(["the", '"total'], 'idiot"') == 1 and quoted(['"total', 'fool"', "is"], "idiot") == 0
    assert quoted([], "«idiot»") == 1


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def scored(spark):
    r = random.Random(9)
    bad = ["rotter", "scoundrel"]
    rows, labels = [], []
    for i in range(600):
        words = prose(r, 60).split()
        toxic = int(i % 6 == 0)
        if toxic:
            for w in bad:
                words.insert(r.randrange(60), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    rows += [(1000, "you rottr scoundrrel"), (1001, None), (1002, ""), (None, "you scoundrel rotter"), (1003, "ROTTER, Scoundrel!"), (0, rows[0][1])]
    labels += [(None, 1, 1), (5, 1, None), (0, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "0 AS toxic", "'x' AS near").repartition(3)
    return rows, labels, score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()


def test_scores(scored):
    rows, labels, got = scored
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    for x in got:
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
        assert x["held_out"] == (x["doc_id"] is not None and held(x["doc_id"]))
    assert all(by[i]["predicted"] == int(i % 6 == 0) for i in range(600))
    assert by[1000]["predicted"] == by[1003]["predicted"] == by[None]["predicted"] == 1
    assert by[1001]["score"] == by[1002]["score"] < 0.3


def test_held_out_labels_teach_nothing(spark):
    ids = [i for i in range(400) if held(i)]
    docs = spark.createDataFrame([(i, "rotter plain" if i % 2 else "other plain") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids] + [(i, 1, 0) for i in range(400) if not held(i)], "doc_id long, quality int, toxic int")
    assert {x["score"] for x in score_toxicity(docs, labels).collect()} == {0.0}  # one class is left


@pytest.mark.parametrize("docs,labels", list(itertools.product([[], [(1, "a b")]], [[], [(1, 1, 1)]])))
def test_empty_tables(spark, docs, labels):
    got = score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert [x["score"] for x in got] == [1.0 if labels and not held(1) else 0.0] * len(docs)


def test_rare_terms_are_learned_in_a_long_tailed_lexicon(spark):
    r = random.Random(6)
    terms = ["".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiou") for _ in range(5)) for _ in range(60)]
    rows, labels = [], []
    for i in range(3000):
        words = prose(r, 30).split()
        toxic = i % 2
        if toxic:
            words.insert(r.randrange(30), terms[i // 2 % 60])  # each in less than 2 % of the toxic texts
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    got = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                         spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(x["predicted"] == x["doc_id"] % 2 for x in got)
