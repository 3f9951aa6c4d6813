import collections

import pytest

from ctxspark.llm import suffix_dedup as sd
from tests.llm.conftest import prose


def brute(pairs, least):
    """Word positions by (doc_id, kind); ids are unique here."""
    words = {i: (t or "").encode().lower().split() for i, t in pairs}
    count = collections.Counter(tuple(w[s:s + least]) for w in words.values() for s in range(len(w) - least + 1))
    whole = collections.Counter(t for _, t in pairs)
    first_of, seen, out = {}, set(), collections.defaultdict(set)
    for i, t in sorted(pairs):
        w = words[i]
        copy = first_of.setdefault(t, i) != i
        for s in range(len(w) - least + 1):
            g = tuple(w[s:s + least])
            if count[g] > 1:
                out[i, "repeat" if g in seen else "first"].update(range(s, s + least))
            seen.add(g)
        if whole[t] > 1 and len(w) >= least:
            out[i, "repeat" if copy else "first"] = set(range(len(w)))
    return {k: v for k, v in out.items() if v}


def covered(rows):
    out = collections.defaultdict(set)
    for r in rows:
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50
        out[r["doc_id"], r["kind"]].update(range(r["start_word"], r["end_word"]))
    return out


@pytest.mark.parametrize("hot", [20_000, 5])
def test_spans_equal_brute_force(docs_of, rng, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_ROWS", hot)
    passages = [prose(rng, n, 10**6) for n in (50, 51, 60, 49, 120, 300)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 80), 10**6)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages).split()
            a = rng.randint(0, len(p) // 3)
            parts += [" ".join(p[a:] if rng.random() < 0.5 else p), prose(rng, rng.randint(0, 60), 10**6)]
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "again " * 120, "tick tock " * 70, passages[0].upper(), passages[2].replace(" ", "\n"), prose(rng, 49, 10**6), "", None]
    pairs = list(enumerate(texts))
    assert dict(covered(sd.repeated_passages(docs_of(pairs)).collect())) == brute(pairs, 50)


def test_repeated_rows_and_null_ids(docs_of, rng):
    text, other = prose(rng, 70, 10**6), prose(rng, 80, 10**6)
    got = sd.repeated_passages(docs_of([(4, text), (None, text), (None, other + " " + text), (6, other)])).collect()
    kinds = {(r["doc_id"], r["kind"], r["start_word"], r["end_word"]) for r in got}
    assert (4, "first", 0, 70) in kinds and (None, "repeat", 0, 70) in kinds and (6, "first", 0, 80) in kinds
    assert sd.repeated_passages(docs_of([])).collect() == []
    assert sd.repeated_passages(docs_of([(1, "short"), (2, "short")])).collect() == []


def test_remove_repeats(docs_of, rng):
    passage = prose(rng, 55, 10**6)
    docs = docs_of([(1, "x " + passage), (2, "y\n" + passage + " z"), (3, None)])
    out = {r["doc_id"]: r["text"] for r in sd.remove_repeats(docs, sd.repeated_passages(docs)).collect()}
    assert out == {1: "x " + passage, 2: "y\nz", 3: None}
