"""WARC archives: a gzip member per record, written by Spark tasks, read back record by record.

Writing: the payload digest groups equal payloads; the smallest page_id of a group keeps the payload (response), the
others point to it (revisit, identical-payload-digest). Each task writes segments of at most ``SEGMENT_BYTES`` under
names of its own attempt and returns them; the stored manifest lists the segments of the attempts that succeeded, so a
lost executor or a speculative copy leaves at most unlisted files. Files go through ``pyarrow.fs`` (file, hdfs, s3, gs,
abfs), to a folder that all executors share.

Reading: a segment is read in chunks; zlib inflates each member as its bytes arrive, the record is framed by its
Content-Length, and block and payload digests are verified. One record at a time is in memory.

Rows: a null html is an empty payload; a null url leaves WARC-Target-URI out; line ends in a url are percent-encoded; a
null page_id is never a group's smallest unless all of its group are null (then all are responses) and comes back null;
rows that repeat the smallest page_id with the same payload are all responses; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import scratch, stored

SEGMENT_BYTES = 64 << 20
READ_BYTES = 1 << 18
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop-style path (``file:/x`` has one slash) and the path in it."""
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{PAGE}{'' if page_id is None else page_id}>"),
              ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
              ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")]
    return member(fields, block)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an open archive."""
    z, held, data = zlib.decompressobj(31), bytearray(), b""
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                break
        held += z.decompress(data)
        data = z.unused_data
        if not z.eof:
            continue
        head, found, rest = bytes(held).partition(b"\r\n\r\n")
        if not found or not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        lines = head.decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError("the record's length differs from its Content-Length")
        yield fields, rest[:size]
        z, held = zlib.decompressobj(31), bytearray()
    if held or not z.eof and z.unconsumed_tail:
        raise ValueError("the archive ends within a record")


def verified(fields: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload that the record holds and the length of the full payload; raises where a digest differs."""
    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"block digest of {fields['warc-record-id']}")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "response" and (len(payload) != size or fields["warc-payload-digest"] != f"sha1:{sha1_base32(payload)}"):
        raise ValueError(f"payload digest of {fields['warc-record-id']}")
    return payload, size


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``path``; the manifest (segment, records, bytes), stored."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1("html")))
    first = (rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("digest", "first"))
    rows = (rows.join(first, "digest", "left")
            .select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")))

    def run(batches):
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        task = TaskContext.get()
        out, name, made = None, "", []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None or out.tell() >= segment_bytes:
                    if out is not None:
                        made[-1][2] = out.tell()
                        out.close()
                    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    info = b"software: ctxspark\r\nformat: WARC File Format 1.1\r\n"
                    out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", DATE),
                                      ("WARC-Block-Digest", f"sha1:{sha1_base32(info)}"), ("Content-Type", "application/warc-fields")], info))
                    made.append([name, 0, 0])
                out.write(page_record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"]))
                made[-1][1] += 1
        if out is not None:
            made[-1][2] = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["segment", "records", "bytes"])

    return stored(rows.mapInArrow(run, "segment string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, path: str) -> DataFrame:
    """The listed segments' page records: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload);
    ``payload`` is null for a revisit."""
    def run(batches):
        fs, folder = filesystem(path)
        for batch in batches:
            for name, expected in zip(batch.column("segment").to_pylist(), batch.column("records").to_pylist()):
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        payload, n = verified(fields, block)
                        of = lambda k: (lambda v: int(v) if v else None)(fields.get(k, "")[len(PAGE) + 1:-1])
                        kind = fields["warc-type"]
                        rows.append((of("warc-record-id"), fields.get("warc-target-uri"), n, fields["warc-payload-digest"][5:], kind,
                                     of("warc-refers-to"), payload if kind == "response" else None))
                        size, seen = size + len(payload), seen + 1
                        if size > 1 << 22 or len(rows) >= 4096:
                            yield as_batch(rows)
                            rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{name} holds {seen} records, not {expected}")
                if rows:
                    yield as_batch(rows)

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("segment", "records").repartition(n, "segment").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write, read back: (page_id, payload_bytes, payload_digest, record_type, refers_to) per page."""
    path = path or scratch(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, path), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
