import heapq
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ctxspark.llm import mixing as mx


def targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), cap=2):
    """Sources above their cap are set to it and the excess reshared by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def sainte_lague(votes, seats):
    heap = [(-v / 0.5, name, 0) for name, v in votes.items() if v > 0]
    heapq.heapify(heap)
    won = Counter()
    for _ in range(seats if heap else 0):
        _, name, k = heapq.heappop(heap)
        won[name] += 1
        heapq.heappush(heap, (-votes[name] / (k + 1.5), name, k + 1))
    return won


def corpus(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, source string, code int, key string, target double").repartition(3)


def made(rng, counts, longest=120):
    n = iter(range(10**6))
    return [(next(n), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(longest))), s) for s, c in counts.items() for _ in range(c)]


def test_highest_quotients_equal_one_seat_at_a_time(spark, rng):
    kinds = [{i: rng.random() * 50 for i in range(40)}, {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.0}, {i: 0.6 for i in range(100)} | {100: 1e4}, {0: 0.0}, {7: 3.5}]
    groups = {(k, seats): votes for k, votes in enumerate(kinds) for seats in (0, 1, 3, 17, 400, 5000)}
    df = spark.createDataFrame([(f"{k}-{seats}", p, v, seats) for (k, seats), vs in groups.items() for p, v in vs.items()],
                               "g string, p int, votes double, seats long")
    got = {(r.g, r.p): r.quota for r in mx.highest_quotients(df, "g", "p").collect()}
    want = {g: sainte_lague(vs, g[1]) for g, vs in groups.items()}
    assert got == {(f"{k}-{seats}", p): want[k, seats][p] for (k, seats), vs in groups.items() for p in vs}


@pytest.mark.parametrize("shard_rows", [4096, 20])
def test_mix_meets_targets_and_bounds(spark, rng, monkeypatch, shard_rows):
    monkeypatch.setattr(mx, "SHARD_ROWS", shard_rows)
    rows = made(rng, {"a": 100, "b": 40, "c": 7, "": 30, None: 25, "z": 1, "é": 300})
    rows += [(None, "x y z", "b"), (None, None, "b"), (5, "again", "a"), (5, "again", "a"), (10**7, None, "empty"), (10**7 + 1, " \t", "empty")]
    size = {i: len((t or "").split()) for i, (_, t, _) in enumerate(rows)}
    total = Counter()
    for i, (_, _, s) in enumerate(rows):
        total[s] += size[i]
    want = targets(dict(total))
    out = mx.mix(corpus(spark, rows)).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r.source_size == total[r.source] and r.target == pytest.approx(float(want[r.source]))
        got = sum((s["end"] - s["start"]) * s["times"] for s in r.spans)
        assert 0 <= got <= 2 * r.size and all(0 <= s["start"] < s["end"] <= r.size and s["times"] in (1, 2) for s in r.spans)
        taken[r.source] += got
    for s, t in want.items():
        block = max(1, min(mx.BLOCK_WORDS, total[s] // mx.FINEST))
        assert abs(taken[s] - t) <= 2 * block * max(1, -(-len(rows) // shard_rows)), s
    assert sum(want.values()) == Fraction(3, 2) * sum(total.values())


def test_reruns_agree_whatever_the_partitions(spark, rng):
    rows = made(rng, {"a": 60, "b": 30, None: 10})
    rows += rows[:5]
    one = sorted(map(tuple, mx.mixture_digest(corpus(spark, rows)).collect()))
    two = sorted(map(tuple, mx.mixture_digest(corpus(spark, rows[::-1]).repartition(7)).collect()))
    other = sorted(map(tuple, mx.mixture_digest(corpus(spark, rows), seed=12).collect()))
    assert one == two and one != other


def test_texts_are_the_taken_words(spark, rng):
    rows = made(rng, {"a": 30, "b": 5}) + [(900, "", "a"), (901, None, "c")]
    words = {i: (t or "").split() for i, t, _ in rows}
    counted = Counter()
    for r in mx.mixed_texts(corpus(spark, rows)).collect():
        piece = r.text.split()
        assert words[r.doc_id][r.start:r.start + len(piece)] == piece
        counted[r.doc_id] += r.times * len(piece)
    digest = {r.doc_id: r.taken for r in mx.mixture_digest(corpus(spark, rows)).collect()}
    assert digest == {i: counted[i] for i in words}


def test_very_long_text_and_nothing(spark):
    df = corpus(spark, [(1, "a " * 200_000, "s"), (2, "b", "s"), (3, "c", "t")])
    got = {r.doc_id: r for r in mx.mixture_digest(df).collect()}
    assert got[1].size == 200_000 and sum(r.taken for r in got.values()) == pytest.approx(300_003, abs=70)
    assert mx.mixture_digest(df.where("false")).collect() == []
    empty = mx.mixture_digest(df.withColumn("text", F.lit(None).cast("string"))).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 3
