"""Toxicity scores: misspelled lexicon terms by Levenshtein automata, context windows, a logistic score.

The lexicon is learned from labelled documents: words that are significantly more frequent in toxic texts and
near absent from clean ones, however rare.
All terms share a trie; the Levenshtein automata of all terms, intersected with that trie, are one deterministic
automaton whose states are made when first met: a state is the set of (trie node, edits so far) that the letters read
can have led to, and it is dead as soon as no term is within reach. Each distinct word of a task runs through it once.
Short terms allow no edit, then one, and from ``TWO_EDITS`` letters on two.

Each hit is weighed by its context window: inside quotation marks or after a reporting verb it counts as quoted, else as
abuse. A logistic regression (Spark ML, over all labelled documents that may be learned from) turns the counts into a
score from 0 to 1.

Rows: a null text is empty and scores as a text without hits; every row gives one row; a null doc_id has no label and
isn't held out; labels that repeat a doc_id count once, as toxic if any says so; null labels teach nothing; where
the labels hold one class only, every score is that class's share; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import slices, small_side, split_words, stored

ONE_EDIT, TWO_EDITS = 5, 8
#: Terms that the trie holds at most, the most significant ones, and words let through by chance.
MOST_TERMS, CHANCE = 50_000, 0.1
WINDOW = 6
#: Fixed signs and words of quotation.
QUOTES = "\"'`“”„«»‘’"
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes asked word term".split())
STRIP = re.compile(r"^\W+|\W+$")
FEATURES = ["abuse", "quoted", "near", "harmless", "density"]


def allowed_edits(term: str) -> int:
    return (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)


class TermAutomaton:
    """Levenshtein automata of the terms intersected with their trie, determinised on demand.

    ``match(word)`` is the fewest edits to a term that allows them, or None.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.reach, self.accepts = [-1], [-1]
        for term in sorted(set(terms)):
            edits, node = allowed_edits(term), 0
            self.reach[0] = max(self.reach[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(-1)
                    self.accepts.append(-1)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            self.accepts[node] = edits
        self.letters = {c for kids in self.children for c in kids}
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.score: list[int | None] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, best: dict[int, int]) -> dict[int, int]:
        """With the trie letters that the word may leave out; ``best`` is the fewest edits by node."""
        todo = list(best)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = best[node] + 1
                if e <= self.reach[child] and e < best.get(child, 9):
                    best[child] = e
                    todo.append(child)
        return {n: e for n, e in best.items() if e <= self.reach[n]}

    def _state(self, best: dict[int, int]) -> int:
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.score.append(min((e for n, e in key if e <= self.accepts[n]), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for node, e in self.members[state]:
            best[node] = min(best.get(node, 9), e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                best[child] = min(best.get(child, 9), e + (letter != c))
        self.steps[state, c] = to = self._state(self._closed({n: e for n, e in best.items() if e <= self.reach[n]}))
        return to

    def match(self, word: str) -> int | None:
        state, steps, dead = self.start, self.steps, self.dead
        for c in word:
            if c not in self.letters:
                c = ""
            to = steps.get((state, c))
            state = self._step(state, c) if to is None else to
            if state == dead:
                return None
        return self.score[state]


def core(word: str) -> str:
    return word.lower() if word.isalnum() else STRIP.sub("", word.lower())


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows whose crc32(doc_id) mod 4 is not 2."""
    of = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.where(~held_out()).select("doc_id", "text").join(small_side(of), "doc_id")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_counts(texts: DataFrame, kept) -> DataFrame:
    """(word, toxic, n): the texts of each label that hold a word of ``kept()``, a test made once in each task."""
    def run(batches):
        test, counts = kept(), {}
        for part in slices(batches):
            bounds, words = split_words(part.column("text"))
            cores = [w if w and test(w) else "" for w in map(core, words.dictionary.to_pylist())]
            at = words.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, int)
            for i, toxic in enumerate(part.column("toxic").to_pylist()):
                for w in {cores[j] for j in np.unique(at[bounds[i]:bounds[i + 1]])} - {""}:
                    counts[w, toxic] = counts.get((w, toxic), 0) + 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts]), pa.array([t for _, t in counts], pa.int32()),
                                              pa.array(list(counts.values()), pa.int64())], names=["word", "toxic", "n"])

    return texts.mapInArrow(run, "word string, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def by_class(texts: DataFrame, kept) -> DataFrame:
    """(word, toxic, clean): the number of texts of each class that hold a word of ``kept()``."""
    n = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    return document_counts(texts, kept).groupBy("word").agg(n(1).alias("toxic"), n(0).alias("clean"))


def learn(train: DataFrame, least_docs: int = 4, precision: float = 0.9) -> tuple[list[str], list[str]]:
    """(lexicon, harmless): words in at least ``least_docs`` toxic texts whose texts are toxic by ``precision`` when both
    classes weigh the same and more often than by chance, and words within the automaton's reach that fail that precision.
    Chance is a likelihood ratio test against the share of toxic texts; of as many words as stand in ``least_docs`` toxic
    texts, ``CHANCE`` pass it by chance. Texts that repeat count once. Words are selected in Spark; collected are the
    ``MOST_TERMS`` most significant terms at most, and the harmless spellings near them."""
    texts = train.groupBy(F.xxhash64("text").alias("h")).agg(F.max("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    texts = stored(texts.select("text", "toxic"), "toxicity-train")
    n = dict(texts.groupBy("toxic").count().collect())
    if not n.get(1) or not n.get(0):
        return [], []
    share = n[1] / (n[0] + n[1])
    toxic, clean = F.col("toxic") / n[1], F.col("clean") / n[0]
    fails = toxic < precision * (toxic + clean)
    tested = stored(by_class(texts, lambda: lambda w: len(w) > 2).where(F.col("toxic") >= least_docs), "toxicity-words")
    both = F.col("toxic") + F.col("clean")
    gain = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * p))).otherwise(0.0)
    ratio = gain("toxic", share) + gain("clean", 1 - share)
    chosen = (tested.where(~fails).withColumn("ratio", ratio).where(F.col("ratio") >= float(np.log(max(tested.count(), 1) / CHANCE)))
              .orderBy(F.desc("ratio"), "word").limit(MOST_TERMS))
    lexicon = sorted(r["word"] for r in chosen.select("word").collect())
    if not lexicon:
        return [], []

    def near():
        automaton, terms = TermAutomaton(lexicon), frozenset(lexicon)
        return lambda w: w not in terms and automaton.match(w) is not None

    return lexicon, sorted(r["word"] for r in by_class(texts, near).where(fails).select("word").collect())


def features(docs: DataFrame, lexicon: list[str], harmless: list[str]) -> DataFrame:
    """(doc_id, h, FEATURES): what the automaton and the context windows find in each whole text."""
    def run(batches):
        automaton = TermAutomaton(lexicon)
        terms, known = frozenset(lexicon), frozenset(harmless)
        for part in slices(batches):
            bounds, words = split_words(part.column("text"), lower=False)
            out = np.zeros((part.num_rows, len(FEATURES)))
            if len(words):
                names = words.dictionary.to_pylist()
                cores = [core(w) for w in names]
                match = automaton.match
                edits = np.array([-1 if e is None else e for e in map(match, cores)])
                at = words.indices.to_numpy(zero_copy_only=False)
                hits = np.flatnonzero(edits[at] >= 0)
                for p, row in zip(hits, np.searchsorted(bounds, hits, "right") - 1):
                    word = names[at[p]]
                    if cores[at[p]] in terms:
                        window = [names[j] for j in at[max(bounds[row], p - WINDOW):p]]
                        out[row, quoted(window, word)] += 1
                    else:
                        out[row, 3 if cores[at[p]] in known else 2] += 1
                n = np.diff(bounds)
                out[:, 4] = 100 * (out[:, 0] + out[:, 1] + out[:, 2]) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id")] + [pa.array(np.log1p(c)) for c in out.T],
                                             names=["doc_id", *FEATURES])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def quoted(window: list[str], word: str) -> int:
    """1 where the hit stands in quotation marks opened in its window, or right after a reporting verb; else 0."""
    marks = sum(w[0] in QUOTES for w in window) - sum(w.rstrip(".,;:!?")[-1:] in QUOTES and len(w) > 1 for w in window)
    return int(word[0] in QUOTES or marks > 0 or any(core(w) in REPORTING for w in window[-2:]))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, learned from the labels that may be learned from."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    lexicon, harmless = learn(labelled(docs, labels))
    found = stored(features(docs, lexicon, harmless), "toxicity-features")
    of = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Equal feature rows of equal label are one weighted row, so the solver's input grows with their kinds only.
    train = (found.where(~held_out()).join(small_side(of), "doc_id")
             .groupBy(*FEATURES, F.col("toxic").cast("double").alias("label")).agg(F.count("*").cast("double").alias("weight"))
             .select(array_to_vector(F.array(*FEATURES)).alias("features"), "label", "weight"))
    train = stored(train, "toxicity-rows")
    share = dict(train.groupBy("label").agg(F.sum("weight")).collect())
    total = sum(share.values())
    if len(share) < 2:
        score = F.lit(share.get(1.0, 0.0) / total if total else 0.0)
    else:
        model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=100).fit(train)
        logit = F.lit(float(model.intercept))
        for f, c in zip(FEATURES, model.coefficients):
            logit = logit + F.col(f) * float(c)
        score = 1 / (1 + F.exp(-logit))
    return found.select("doc_id", held_out().alias("held_out"), score.alias("score"),
                        (score >= threshold).cast("int").alias("predicted"))
