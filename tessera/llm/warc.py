"""WARC archives: a writer of one gzip member a record, and a sequential reader.

``write`` makes archives in a folder from tasks and returns their manifest, which is
committed as a table: a task that runs twice leaves files that no manifest names, and they
are never read. ``read`` goes through each archive from front to back: zlib is fed blocks
as they come, a member ends where zlib says so, the record's block is framed by its
Content-Length, and block and payload digests are verified.

Payloads are not sent twice: of records with equal payloads of at least ``MIN_REVISIT``
bytes, those with the smallest id are responses, the others revisits that refer to it.

Defined cases: a null html is an empty payload; a null url leaves the target out; rows
with an equal id and payload are all responses if theirs is the smallest id; a null id is
written as such and never referred to while another id has the payload; an empty table
makes no archive and reads back as no rows. Records with a broken gzip stream, a wrong
length or digest raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut, new_path

MIN_REVISIT = 100
BLOCK = 1 << 18
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, payload`` with ``digest`` and ``refers_to`` (null: a response).

    Only ids and digests are grouped; the join on the digest has both sides dealt for it alone, so that a
    payload that many pages share is split over tasks.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    twice = rows.filter(F.octet_length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    twice = cut(twice.filter("n > 1").select("digest", "first_id"), "payloads")
    joined = rows.join(twice, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """The bytes of one WARC record."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        *([("WARC-Target-URI", header_safe(url))] if url is not None else []),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(typed: DataFrame, folder: str, level: int = 3, rotate: int = 1 << 28) -> DataFrame:
    """Write the rows of ``record_types`` as archives of up to about ``rotate`` bytes; returns their manifest."""

    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, done, path, n, size = None, [], "", 0, 0
        try:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if out is None:
                        path, n, size = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(path, compression=None)
                    refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                    raw = record(None if pd.isna(row.page_id) else int(row.page_id), row.url, row.payload, row.digest, refers)
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = gz.compress(raw) + gz.flush()
                    out.write(member)
                    n, size = n + 1, size + len(member)
                    if size >= rotate:
                        out.close()
                        out = None
                        done.append((path, n, size))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((path, n, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return cut(typed.mapInPandas(archives, MANIFEST), "manifest")


def members(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member of a stream, one at a time."""
    z, parts, fed = zlib.decompressobj(31), [], False
    for block in blocks:
        while block:
            fed = True
            parts.append(z.decompress(block))
            block = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts, fed = zlib.decompressobj(31), [], False
    if fed:
        raise ValueError("the archive ends within a gzip member")


def parse(raw: bytes) -> tuple:
    """The row of RECORD for one record's bytes."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version != "WARC/1.1" or not end:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block isn't as long as Content-Length says")
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"{fields['WARC-Record-ID']}: the block has another digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload has another length or digest")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("WARC-Refers-To"), size, digest, None if revisit else payload


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of the manifest, see RECORD; archives are dealt evenly over the tasks."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({k: "Int64" for k in ("page_id", "refers_to", "payload_bytes")})
        for batch in batches:
            for path, n in zip(batch["path"], batch["records"], strict=True):
                with store.open_input_stream(path, compression=None) as source:
                    rows, held, seen = [], 0, 0
                    for raw in members(iter(lambda s=source: s.read(BLOCK), b"")):
                        row = parse(raw)
                        rows.append(row if payloads else (*row[:-1], None))
                        held, seen = held + len(raw) * payloads, seen + 1
                        if held >= 1 << 24 or len(rows) >= 10_000:
                            yield frame(rows)
                            rows, held = [], 0
                    if seen != n:
                        raise ValueError(f"{path}: {seen} records, the manifest says {n}")
                    yield frame(rows)

    n = max(1, manifest.count())
    return manifest.repartition(n).mapInPandas(records, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back."""
    folder = new_path(spark, "warc")
    return read(write(record_types(pages), folder), folder, payloads)
