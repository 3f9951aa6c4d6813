import numpy as np
import pyarrow as pa
import pytest

from ctxspark.llm.common import components, range_hashes, slices, split_words, string_hashes, word_hashes


def test_words_are_ascii_white_space_runs_with_a_to_z_lowered():
    texts = ["  A b\x0bc\x1cD\x85 ", "", None, "É\tÉ x\x0c\r\ny"]
    bounds, words = split_words(pa.array(texts))
    plain = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(p) for p in plain]
    assert [w.encode() for w in words.to_pylist()] == [w for p in plain for w in p]


def test_equal_strings_hash_equally_wherever_they_stand():
    a, b = pa.array(["x", "", "ab", "é", "ba"]), pa.array(["zzz", "ab", "é", "x", "", "ba"]).slice(1)
    left, right = dict(zip(a.to_pylist(), string_hashes(a))), dict(zip(b.to_pylist(), string_hashes(b)))
    assert left == right and len(set(left.values())) == 5


def test_range_hashes_are_content_hashes():
    v = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    h = range_hashes(v, np.array([0, 3, 1, 4]), np.array([3, 6, 3, 7]))
    assert h[0] == h[1] and h[2] != h[3]


def test_slices_keep_rows_and_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 0, 50, 5, 5)] + [None])], names=["text"])
    parts = list(slices(iter([batch]), max_bytes=20))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 20 for p in parts)
    assert list(slices(iter([batch.slice(0, 0)]))) == []


def test_word_hashes_of_an_empty_batch_of_words():
    bounds, words = word_hashes(pa.array(["", " "]))
    assert bounds.tolist() == [0, 0, 0] and len(words) == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (9, 8), (3, 1)], [(i, i + 1) for i in range(30)] + [(50, 40)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
