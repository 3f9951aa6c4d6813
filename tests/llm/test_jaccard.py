import random

import numpy as np
import pytest

from ctxspark.llm import jaccard as jc
from tests.llm.conftest import prose


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i:i + k]) for i in range(len(w) - k + 1)))


def brute(pairs, k, percent):
    sets = [shingles(t, k) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(pairs, sets))), key=str)


def copies(rng, words, n, most):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,percent,hot", [(3, 90, 4096), (5, 80, 4096), (3, 90, 16), (3, 70, 16)])
def test_components_equal_brute_force(docs_of, rng, monkeypatch, k, percent, hot):
    monkeypatch.setattr(jc, "HOT_ROWS", hot)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    for size, most in ((40, 8), (100, 10), (16, 2), (64, 3)):
        texts += copies(rng, prose(rng, size, 5000).split(), 25, most)
    line = " " + prose(rng, 30) + " "
    texts += [prose(rng, 40) + line + prose(rng, 40) for _ in range(30)]  # share a passage, don't link
    texts += ["", None, " \t\n", "one", "ONE", "one two", "one  two", "é two", texts[70], texts[70], texts[71].upper()]
    rng.shuffle(texts)
    pairs = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1000, "one two"), (None, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jc.jaccard_components(docs_of(pairs), k, percent).collect()), key=str)
    assert got == brute(pairs, k, percent)


def test_size_of_links_at_the_border(docs_of):
    words = [f"a{i}" for i in range(40)]
    pairs = [(1, " ".join(words)), (2, " ".join(words[:-2])), (3, " ".join(words[:-4])), (4, " ".join(words[:-5]))]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jc.jaccard_components(docs_of(pairs), 3, 90).collect()), key=str)
    assert got == brute(pairs, 3, 90)


def test_bitmap_difference_never_exceeds_the_sets_difference():
    r = np.random.default_rng(1)
    for _ in range(100):
        a = np.unique(r.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 2**63, 20).astype(np.uint64)]))
        bits = int(np.bitwise_count(jc.signature(a) ^ jc.signature(b)).sum())
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [70, 80, 90, 100])
def test_prefix_and_difference_bounds(percent):
    for n in range(1, 60):
        for m in range(n, 60):
            for both in range(n + 1):
                if 100 * both >= percent * (n + m - both):
                    assert n + m - 2 * both <= jc.most_difference(n, m, percent)
                    assert both > n - jc.prefix_size(n, percent) and both > m - jc.prefix_size(m, percent)


def test_keep_one_per_group(docs_of, rng):
    base = prose(rng, 60)
    near = base.split()
    near[-1] = "other"
    pairs = [(7, base), (5, " ".join(near)), (5, " ".join(near)), (9, prose(rng, 50)), (1, ""), (2, None), (3, ""), (None, base)]
    docs = docs_of(pairs)
    out = jc.keep_one_per_group(docs, 5, 80)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([5, 9, 1, 2, 3, None], key=str)


def test_empty_table(docs_of):
    assert jc.jaccard_components(docs_of([])).collect() == []
    assert jc.keep_one_per_group(docs_of([])).collect() == []


def test_every_link_between_near_copies_is_counted(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(5000)}" for _ in range(400)]
    docs = [(i, " ".join([*words, *(f"x{i}y{j}" for j in range(r.randint(1, 30)))])) for i in range(60)]
    docs += [(100, docs[0][1])]
    grams = {i: {tuple(t.split()[j:j + 3]) for j in range(len(t.split()) - 2)} for i, t in docs}
    exact = {i: sum(i % 100 != j and 10 * len(a & b) >= 9 * len(a | b) for j, b in grams.items() if j < 100) for i, a in grams.items()}
    got = jc.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 3, 90).collect()
    assert {x["doc_id"]: x["n_links"] for x in got} == exact and max(exact.values()) > 20


def test_wide_bitmaps_fold_to_narrow_ones():
    r = np.random.default_rng(2)
    for n in (1, 255, 256, 1023, 1024, 5000):
        s = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        bits = jc.wide_bits(len(s))
        assert bits >= 512 and len(s) <= bits and (bits == 512 or bits <= 4 * len(s))
        narrow, wide = jc.folded([jc.signature(s).tobytes(), jc.signature(s, bits).tobytes()])
        assert (narrow == wide).all() and (narrow == jc.signature(s)).all()


def test_links_of_long_texts_equal_brute_force(docs_of, rng):
    # sets of 250 to 1,500 shingles around the borders of the bands, with shared passages that don't link
    line = " " + prose(rng, 200) + " "
    texts = [prose(rng, rng.randint(300, 900)) + line + prose(rng, 400) for _ in range(6)]
    for size, most in ((255, 6), (1020, 25), (1030, 30), (1500, 60)):
        base = prose(rng, size, 5000).split()
        texts += copies(rng, base, 8, most) + [" ".join(base[: size * 93 // 100])]
    pairs = list(enumerate(texts))
    got = jc.jaccard_components(docs_of(pairs), 3, 90).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(pairs, 3, 90)
    sets = [shingles(t, 3) for t in texts]
    assert {r["doc_id"]: r["n_links"] for r in got} == {
        i: len({b for j, b in enumerate(sets) if b != a and 100 * len(a & b) >= 90 * len(a | b)}) for i, a in enumerate(sets)}
