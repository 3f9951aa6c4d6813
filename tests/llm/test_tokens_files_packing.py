import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ctxspark.llm.packing import cut, pack, packing_digest, sequences
from ctxspark.llm.token_files import decode_block, encode_block, read_token_files, token_digest, write_token_files
from ctxspark.llm.tokens import WordEncoder, default_vocabulary

TEXTS = ["Hello, world. It's 3.5%!", "", None, "ÀÉ naïve Straße… 漢字 'tis", "a <|endoftext|>b <|startoftext|>", "x" * 5000,
         "word " * 3000, "tab\tand\x0bodd\x1cspace here", "the cat."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_gives_the_librarys_ids(library):
    r = random.Random(3)
    letters = "aB é.,!?'s<|endoftext|>\x85 \x1c\x0b\n1%&Á İß'T|;:é"
    texts = TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for most in (600_000, 3):
        encoder = WordEncoder(default_vocabulary(), most)
        at = 0
        for part in (texts[:700], texts[700:]):
            n, ids = encoder.encode(pa.array(part, pa.string()))
            at = 0
            for text, size in zip(part, n):
                assert ids[at:at + size].tolist() == library(text)
                at += size


@pytest.mark.parametrize("values", [
    [], [7], [0] * 4000, list(np.random.default_rng(1).integers(0, 49408, 5000)), [2**64 - 1, 2**60, 2**60 - 1, 0] + [1] * 200,
    list(np.random.default_rng(2).integers(0, 2, 3000)), list((np.random.default_rng(3).zipf(1.2, 4000) % 2**62)), [1] * 59 + [2**30] + [1] * 1300])
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    data = encode_block(values)
    assert (decode_block(data) == values).all() and len(decode_block(data)) == len(values)
    assert (decode_block(data, 1) == values[1024:]).all()


def test_simple8b_packs_small_values():
    assert len(encode_block(np.ones(60_000, np.uint64))) < 60_000 / 60 * 8 * 1.2


def test_token_files(spark, docs_of, library, tmp_dir):
    pairs = [(100 - 3 * i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (97, "same id"), (97, "same id")]
    got = token_digest(docs_of(pairs), default_vocabulary(), 2).collect()
    ids = {(i, t): library(t) + [2] for i, t in pairs}
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, crc(ids[p]) if p[0] else 0))
    expected, at = [], 0
    for p in order:
        expected.append((p[0], at, len(ids[p]), crc(ids[p])))
        at += len(ids[p])
    key = lambda r: (r[1], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    path = f"{tmp_dir}/files"
    write_token_files(docs_of(pairs[:3]), path, default_vocabulary(), 2, buckets=3)
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read_token_files(spark, path).collect()}
    assert back == {i: ids[i, t] for i, t in pairs[:3]}


def test_token_files_of_an_empty_table(docs_of):
    assert token_digest(docs_of([]), default_vocabulary()).collect() == []


@pytest.mark.parametrize("n", [*range(1, 300), 1023, 1024, 1025, 1700, 2047, 2048, 2049, 10_000])
def test_cut_covers_each_id_once_and_fits_its_class(n):
    at = 0
    for start, size, k in cut(n, 2048, 0.97):
        assert start == at and size > 0 and k * size <= 2048 and (size * k >= 0.97 * 2048 or k * (size + 1) > 2048)
        at += size
    assert at == n


@pytest.mark.parametrize("capacity", [2048, 32])
def test_packing(docs_of, library, capacity):
    r = random.Random(5)
    pairs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "ab cd " * r.randint(0, 300)) for i in range(150)] + [(1, ""), (None, "no id")]
    packed = pack(docs_of(pairs), default_vocabulary(), 1, capacity)
    rows = packed.collect()
    by, sequence = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        by[x["doc_id"]].append(x)
        sequence[x["sequence_id"]].append(x)
    for i, t in pairs:
        if i == 1:
            continue
        ids, at = library(t) + [1], 0
        for x in sorted(by[i], key=lambda x: x["start"]):
            assert x["start"] == at and x["ids_crc32"] == crc(ids[at:at + x["length"]]) and x["doc_tokens"] == len(ids)
            at += x["length"]
        assert at == len(ids)
    assert sum(x["length"] for x in by[1]) == 2  # two rows of that id, one end id each
    pad = total = 0
    for parts in sequence.values():
        at = 0
        for x in sorted(parts, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= capacity
        total, pad = total + at, pad + (0 if at & (at - 1) == 0 else capacity - at)
    assert pad <= 0.04 * total
    digest = packing_digest(docs_of(pairs), default_vocabulary(), 1, capacity)
    assert digest.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted((x["length"] for x in digest.collect())) == sorted(x["length"] for x in rows)
    for s in sequences(packed).collect():
        whole = np.frombuffer(s["ids"], "<u4")
        assert len(whole) == s["length"] == sum(x["length"] for x in sequence[s["sequence_id"]])
        for x in sequence[s["sequence_id"]]:
            assert crc(whole[x["offset"]:x["offset"] + x["length"]]) == x["ids_crc32"]


def test_packing_an_empty_table(docs_of):
    assert packing_digest(docs_of([]), default_vocabulary()).collect() == []
