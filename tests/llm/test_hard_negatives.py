import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxspark.llm import hard_negatives as hn

LIMIT = 2**63 - 1


def exact(x):
    return math.floor(256 * x) if abs(x) < 2**52 else 256 * int(x)


def brute(rows, every=50):
    ok = [(j, i, y, [exact(float(x)) for x in v]) for j, (i, y, v) in enumerate(rows)
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: max(-LIMIT, min(LIMIT, sum(x * z for x, z in zip(a, b))))
    out = []
    for j, i, y, v in ok:
        if i % every:
            continue
        others = sorted((-score(v, w), n, k, z) for k, n, z, w in ok if k != j)
        for s, p, _, _ in [o for o in others if o[3] == y][:5]:
            inside = [(-t, n) for t, n, _, z in others if z != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, p, at + 1, n, -s, t) for at, (t, n) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], f"vec_id long, label int, embedding array<{kind}>, row int, v string, k int")
    return sorted(map(tuple, hn.mine(df.repartition(3), F.col("label")).collect()))


@pytest.mark.parametrize("dim", [1, 7, 64, 200])
@pytest.mark.parametrize("size", [1.0, 1e4, 1e12, 1e38])
def test_residue_product_is_exact(dim, size):
    r = np.random.default_rng(dim)
    a, b = (r.normal(0, size, (n, dim)) for n in (5, 9))
    a[0, 0], b[0] = size * 3, -size * 3
    got = hn.scores(hn.ResidueMatrix(a), hn.ResidueMatrix(b), slice(0, 5), slice(0, 9))
    want = [[max(-LIMIT, min(LIMIT, sum(exact(x) * exact(y) for x, y in zip(u, w)))) for w in b] for u in a]
    assert got.tolist() == want


def test_moduli_are_distinct_primes_and_cover_the_range():
    for bits in (1, 20, 62, 300, 2100):
        ps = hn.moduli(bits)
        assert len(set(ps)) == len(ps) and math.prod(ps) > 2 ** (bits + 1)
        assert all(p % d for p in ps for d in range(2, int(p**0.5) + 1))


@pytest.mark.parametrize("kind", ["gauss", "ties", "large", "copies"])
def test_mining_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hn, "CELL_BYTES", 8 * 6 * 40)
    monkeypatch.setattr(hn, "LEAST_CELL_ROWS", 40)
    monkeypatch.setattr(hn, "ROW_BLOCK", 16)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 2)
    r = random.Random(3)
    make = {"gauss": lambda: [r.gauss(0.4, 1) for _ in range(6)], "ties": lambda: [float(r.randrange(3)) for _ in range(6)],
            "large": lambda: [r.choice([1e9, 3e9, -1e9, 0.5, 1e30]) for _ in range(6)],
            "copies": lambda: [1.0] * 6 if r.random() < 0.5 else [r.choice([0.7, 0.8]) for _ in range(6)]}[kind]
    rows = [(i, r.choice([0, 0, 0, 1, 2]), make()) for i in range(260)]
    rows += [(300, 0, None), (350, 1, [1.0, None, 2.0]), (400, 0, [float("nan")] * 6), (450, 0, [float("inf")] * 6), (None, 0, make()),
             (500, None, make()), (50, 0, make()), (50, 0, make()), (550, 0, [1.0, 2.0]), (600, 0, []), (650, 77, make())]
    got = mined(spark, rows, "double" if kind == "large" else "float")
    if kind != "large":
        rows = [(i, y, v and [x if x is None else float(np.float32(x)) for x in v]) for i, y, v in rows]
    assert got == brute(rows)
    assert got


def test_nothing_to_mine(spark):
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]
