"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Writing: each record is a gzip member of its own, so that an archive can be entered at any member. Of rows with equal
payloads of at least ``dedup_bytes`` bytes one, that of the smallest id, is a response and the others are revisit records
that refer to it and keep only the HTTP header. Digests meet in one aggregation, so a payload that a third of all rows
share is combined before the shuffle.

Reading: archives are cut into byte ranges of ``split_bytes``, dealt out as rows. A task looks for the gzip magic in its
range, takes a candidate for a member only if its header decodes to a WARC version line, and owns the records that start
inside its range, reading past its end for the last one. A magic number inside compressed data fails that test.

Archives live in the shared folder and are reached through ``pyarrow.fs``, which opens what its URI names.

Defined cases: a null payload is empty; a null id is written as the id ``null`` and read back as null, ordered after all
others; of rows that repeat both id and payload one is the response; an empty table gives no archive and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, shared_folder, store

SPLIT_BYTES = 4 << 20
FILE_BYTES = 64 << 20
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 16
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, archive string, offset long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}"] if url is not None else []
    head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def roles(pages: DataFrame, dedup_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (text), revisit and refers_to of each row."""
    # an id that is null sorts last: structs compare field by field, and false comes before true
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("row")).withColumn("sha1", F.sha1("payload"))
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = rows.groupBy("sha1").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha1", "first")
    merged = rows.join(first, "sha1", "left")
    again = (F.octet_length("payload") >= dedup_bytes) & F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    return merged.select("page_id", "url", "payload", F.coalesce(again, F.lit(False)).alias("revisit"), F.when(again, F.col("first.page_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, dedup_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every row as a record and returns archive, bytes and records of each archive file. A task that is run again writes files of its own; only those that the returned table names count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = store(folder)
        where.create_dir(path, recursive=True)
        out, name, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, payload.encode(), refers_to, revisit)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name}", size, n))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], ["archive", "bytes", "records"])

    return kept(roles(pages, dedup_bytes).mapInArrow(write, "archive string, bytes long, records long"), "archives")


def _members(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a WARC record that starts in [start, end)."""
    at, held, base = start, b"", start  # held: bytes from base on
    while at < end:
        if at - base > _READ * 4 or at < base or not held:
            held, base = b"", at
        hit = held.find(MAGIC, at - base)
        while hit < 0 and base + len(held) < end + 2:
            keep = max(at - base, len(held) - 2)
            held, base, at = held[keep:], base + keep, max(at, base + keep)
            source.seek(base + len(held))
            more = source.read(min(_READ * 4, end + 2 - base - len(held)))
            if not more:
                break
            held += more
            hit = held.find(MAGIC)
        if hit < 0 or base + hit >= end:
            return
        at = base + hit
        content, after = _member(source, held[hit:], at)
        if content is None:
            at += 1
        else:
            yield at, content
            at = after


def _member(source: pa.NativeFile, known: bytes, at: int) -> tuple[bytes | None, int]:
    """The decoded member at this offset and the offset after it, or None if no WARC record is there. known: bytes read already."""
    inflate, out, fed, piece = zlib.decompressobj(31), [], 0, known
    try:
        while True:
            if not piece:
                source.seek(at + fed)
                piece = source.read(_READ)
                if not piece:
                    return None, at
            fed += len(piece)
            out.append(inflate.decompress(piece))
            if (len(out) == 1 or sum(map(len, out[:-1])) < 5) and not b"WARC/".startswith((seen := b"".join(out)[:5])) and seen != b"WARC/":
                return None, at
            if inflate.eof:
                content = b"".join(out)
                return (content if content.startswith(b"WARC/") else None), at + fed - len(inflate.unused_data)
            piece = b""
    except zlib.error:
        return None, at


def _parsed(content: bytes) -> tuple:
    head, _, block = content.partition(b"\r\n\r\n")
    field = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    block = block[: int(field[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    number = lambda x: int(n) if (n := x[len(b"<urn:page:") : -1]) != b"null" else None
    kind, said = field[b"WARC-Type"].decode(), field[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    revisit = kind == "revisit"
    if not revisit and (digest(payload) != said or len(payload) != length):
        raise ValueError(f"the payload of {field[b'WARC-Record-ID'].decode()} doesn't match its digest")
    url = field.get(b"WARC-Target-URI")
    return number(field[b"WARC-Record-ID"]), url.decode() if url is not None else None, kind, number(field[b"WARC-Refers-To"]) if revisit else None, None if revisit else payload, length, said


def read_archives(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives (columns archive and bytes), read by byte ranges. payloads: whether to return payloads too."""
    ranges = archives.select("archive", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / split_bytes))).alias("k")).selectExpr("archive", f"k * {split_bytes} AS start", f"least((k + 1) * {split_bytes}, bytes) AS stop")
    count = archives.select(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "archive", "offset"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

        for batch in batches:
            for archive, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, path = store(archive)
                rows, held = [], 0
                with where.open_input_file(path) as source:
                    for offset, content in _members(source, start, stop):
                        row = _parsed(content)
                        rows.append((*row[:4], row[4] if payloads else None, *row[5:], archive, offset))
                        held += len(content) if payloads else 200
                        if held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    # a range is some MB of work behind a row of a few bytes: dealt out evenly, not by the rows' own size
    return ranges.repartition(max(1, min(int(count), 10_000)), F.xxhash64("archive", "start")).mapInArrow(read, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/weft-warc-{uuid.uuid4().hex}"
