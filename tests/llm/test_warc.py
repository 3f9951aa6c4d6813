import base64
import gzip
import hashlib
import io

import pytest

from ctxspark.llm.warc import member, page_record, read_warc, records, verified, warc_round_trip, write_warc


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


ROWS = [(5, "http://a/", "<p>same</p>"), (3, "http://b/\r\nX: y", "<p>same</p>"), (9, None, "é" * 70_000), (8, "http://c/", None),
        (7, "http://d/", ""), (None, "http://e/", "<p>same</p>"), (3, "http://b2/", "<p>same</p>"), (None, "u", "lone"), (11, "u", "\r\n\r\n WARC/1.1")]


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS n").repartition(2)


@pytest.mark.parametrize("least,segment", [(0, 64 << 20), (0, 300), (5, 64 << 20)])
def test_round_trip(spark, tmp_dir, least, segment):
    path = f"{tmp_dir}/warc"
    manifest = write_warc(table(spark, ROWS), path, least, segment)
    got = sorted(map(tuple, read_warc(manifest, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    expected = []
    for i, _, html in ROWS:
        payload = (html or "").encode()
        first = min((j for j, _, h in ROWS if (h or "").encode() == payload and j is not None), default=None)
        again = len(payload) >= least and first is not None and i != first
        expected.append((i, len(payload), b32(payload), "revisit" if again else "response", first if again else None))
    assert got == sorted(expected, key=str)
    names = [r["segment"] for r in manifest.collect()]
    assert len(names) > 2 if segment == 300 else names
    for name in names:  # plain gzip reads the same members
        assert gzip.open(f"{path}/{name}").read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_empty_table(spark):
    assert warc_round_trip(table(spark, [])).collect() == []


def test_damaged_archives_are_refused():
    good = page_record(1, "u", b"payload", None)
    assert [f["warc-type"] for f, _ in records(io.BytesIO(good + good))] == ["response"] * 2
    with pytest.raises(ValueError):
        list(records(io.BytesIO(good[:-30])))
    with pytest.raises(ValueError):
        list(records(io.BytesIO(member([("A", "b")], b"x")[:-8])))
    fields, block = next(records(io.BytesIO(good)))
    with pytest.raises(ValueError):
        verified(fields, block.replace(b"payload", b"pay1oad"))


def test_reader_takes_small_chunks():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(7)

    data = b"".join(page_record(i, None, b"x" * i, None) for i in range(20))
    assert [verified(f, b)[1] for f, b in records(Slow(data))] == list(range(20))
