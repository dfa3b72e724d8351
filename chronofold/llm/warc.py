"""WARC archives: one gzip member per record, written and read as streams.

Writing: equal payloads are found by digest and length, and counted before anything is joined; the
page with the largest id of a payload of at least REVISIT_BYTES is its response, the others are
revisit records without the payload. Each task writes archives of at most ARCHIVE_BYTES of payload;
a file appears under its name only when it is whole, so a lost task leaves nothing behind.

Reading: a sequential reader inflates member after member piece by piece, takes the header up to the
empty line, frames the block by Content-Length and verifies block and payload digests.

Cases: null html is an empty payload; rows that share the largest id of a payload are responses
all; a null page id is never the one referred to; line ends in URLs are escaped; a damaged archive
raises; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, store

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20  # payload after which a task begins another archive
READ_BYTES = 1 << 16
ROWS = 64  # records in a batch that the reader gives
SALTS = 16  # parts into which a payload's pages are dealt for the join with its response
ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, size: int, digest: str) -> bytes:
    """The uncompressed record; a revisit has the response's HTTP header, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "about:blank")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _digest(block)),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """`data` as one gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(source) -> Iterator[Iterator[bytes]]:
    """For each gzip member of a stream the pieces of its content, inflated as they are read."""
    waiting = source.read(READ_BYTES)
    while waiting:
        inflate = zlib.decompressobj(31)

        def pieces(inflate=inflate) -> Iterator[bytes]:
            nonlocal waiting
            while not inflate.eof:
                if not waiting and not (waiting := source.read(READ_BYTES)):
                    raise ValueError("the archive ends inside a gzip member")
                piece = inflate.decompress(waiting, READ_BYTES)
                waiting = inflate.unconsumed_tail if not inflate.eof else inflate.unused_data
                yield piece
            if not waiting:
                waiting = source.read(READ_BYTES)

        yield pieces()


def parse(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of a record whose length and digests are right."""
    data = bytearray()
    for piece in pieces:
        data += piece
        if (end := data.find(b"\r\n\r\n")) >= 0:
            break
    else:
        raise ValueError("a record without the end of its header")
    version, *lines = bytes(data[:end]).decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    for piece in pieces:
        data += piece
    size = int(fields["Content-Length"])
    block = bytes(data[end + 4 : end + 4 + size])
    if len(block) != size or bytes(data[end + 4 + size :]) != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block is not {size} bytes long")
    if _digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] != "revisit" and _digest(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload's digest is wrong")
    return fields, http, payload


def _page(field: str | None) -> int | None:
    text = (field or "").strip("<>").removeprefix(ID)
    return int(text) if text else None


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages into archives in `folder`; returns the manifest (archive, records, payload_bytes)."""
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    known = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    large = known.filter(F.col("size") >= REVISIT_BYTES)
    common = large.groupBy("sha1", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    dealt = known.withColumn("salt", salt).join(salted, ["sha1", "size", "salt"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, done, count, size, number = None, [], 0, 0, 0

        def close() -> None:
            nonlocal out, count, size
            out.close()
            system.move(part, name)
            done.append((name, count, size))
            out, count, size = None, 0, 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{base}/{task.partitionId():05d}-{number:05d}.warc.gz"
                    part = f"{name}.{task.taskAttemptId()}"
                    out, number = system.open_output_stream(part, compression=None), number + 1
                page, target, payload, refers_to, length, sha1 = row
                digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
                out.write(member(record(page, target, payload or b"", refers_to, length, digest)))
                count, size = count + 1, size + length
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "payload_bytes"])

    # A revisit's payload is not needed any more and stays behind.
    ready = dealt.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), refers.alias("refers_to"), "size", "sha1")
    return store(ready.mapInArrow(run, "archive string, records bigint, payload_bytes bigint"), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of all archives of a manifest, one task for an archive or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(name, compression=None) as source:
                    for pieces in members(source):
                        fields, http, payload = parse(pieces)
                        length = next(int(line[15:]) for line in http.decode().split("\r\n") if line.startswith("Content-Length:"))
                        sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], length, sha1, _page(fields.get("WARC-Refers-To")), payload))
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    parts = manifest.select("archive").repartition("archive")
    return parts.mapInArrow(run, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """All pages through archives in the shared folder."""
    folder = scratch(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
