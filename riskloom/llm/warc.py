"""WARC archives of web pages in Zstandard frames with a shared dictionary.

The bank's tables hold the addresses of pages (digital events) but no page bodies, so this operator
is kept general: it archives any table of id, address and body.

File layout, after the public specification for WARC in Zstandard: a skippable frame with the
dictionary, then one frame per record. Between frames stands an empty skippable frame.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.frames import read_files, write_frames
from riskloom.llm.texts import arrow_rows, only
from riskloom.session import materialize

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:riskloom:page:{}>"
DATE = "1970-01-01T00:00:00Z"

DICTIONARY_SAMPLE = 200         # pages that the dictionary is trained on, the first by digest
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 16 << 10         # of each of them
LEVEL = 3
STEP = 16 << 10
FILE_BYTES = 64 << 20           # of an archive, and one record more


class ArchiveError(ValueError):
    """A frame, header or length of an archive is not as it has to be."""


def page_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary trained on a bounded sample of bodies; empty when there are too few to train on."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.substring(body, 1, SAMPLE_BYTES).alias("b"), F.sha1(body.cast("binary")).alias("d")).filter("b != ''")
    # Digests first, then their bodies, so that tasks send short rows and never a body that is not needed.
    first = rows.select("d").orderBy("d").limit(DICTIONARY_SAMPLE).agg(F.array_distinct(F.collect_list("d")).alias("d")).first()["d"]
    chosen = rows.filter(F.col("d").isin(first)).groupBy("d").agg(F.max("b").alias("b")) if first else rows.limit(0)
    sample = [r["b"].encode("utf-8") for r in chosen.orderBy("d").collect()]
    if len(sample) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:     # the sample has too little in common
        return b""


def skippable(payload: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(payload)) + payload


def record(page_id, url: str | None, body: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the length of the body it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if revisit else http + body
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {RECORD_ID.format(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_ID.format(refers_to)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32_sha1(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def _headers(block: bytes, first: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(first):
        raise ArchiveError(f"expected {first!r} and a blank line, found {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[A-Za-z0-9-]+", name):
            raise ArchiveError(f"bad header line {line[:80]!r}")
        fields[name.decode().lower()] = value.strip().decode("utf-8")
    return fields, rest


def parse(data: bytes) -> dict:
    """The checked content of one record."""
    fields, rest = _headers(data, b"WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-payload-digest", "content-length"):
        if name not in fields:
            raise ArchiveError(f"{name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"content length {length}, but {len(rest) - 4} bytes follow")
    http, body = _headers(rest[:length], b"HTTP/1.")
    kind, size = fields["warc-type"], int(http["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != size or base32_sha1(body) != digest):
        raise ArchiveError("body and its length or digest differ")
    if kind == "revisit" and body:
        raise ArchiveError("a revisit with a body")

    def page_of(name: str) -> str | None:
        found = re.fullmatch(re.escape(RECORD_ID).replace(r"\{\}", "(.*)"), fields.get(name, ""))
        return found[1] if found and found[1] != "None" else None

    return {"page_id": page_of("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": page_of("warc-refers-to"), "url": fields.get("warc-target-uri"), "body": body if kind == "response" else None}


def read_archive(content: bytes) -> Iterator[dict]:
    """Every record of one archive, one frame at a time."""
    view, at, first, unpacker = memoryview(content), 0, True, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise ArchiveError("cut off inside a frame header")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise ArchiveError("cut off inside a skippable frame")
            if first and magic == DICTIONARY_FRAME and size:
                held = bytes(view[at + 8:at + 8 + size])
                if held[:4] == struct.pack("<I", ZSTD_FRAME):       # the dictionary may be compressed itself
                    held = zstandard.ZstdDecompressor().decompress(held)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
        elif magic == ZSTD_FRAME:
            reader = unpacker.decompressobj()
            parts = []
            while not reader.eof:                   # in steps, as what is left over is copied
                if at >= len(view):
                    raise ArchiveError("cut off inside a frame")
                parts.append(reader.decompress(view[at:at + STEP]))
                at = min(at + STEP, len(view))
            at -= len(reader.unused_data)
            yield parse(b"".join(parts))
        else:
            raise ArchiveError(f"no frame begins at byte {at}")
        first = False


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   smallest_revisit: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """One record per page, archives of bounded size, each with the dictionary in front.

    Of records with equal bodies of at least `smallest_revisit` bytes, those with the smallest page_id
    are responses and the others revisits of it; smaller ones are all responses. A null body is empty.
    Rows that repeat the smallest id are all responses; a row with a null id is a revisit if another
    row has its body and an id. Other columns are ignored; an empty table gives no record.
    """
    rows = only(pages, page_id=page_id, url=url, html=html)
    body = F.coalesce(F.col("html"), F.lit(""))
    slim = rows.select("page_id", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size"))
    firsts = slim.filter(F.col("size") >= smallest_revisit).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    later = slim.filter(F.col("size") >= smallest_revisit).join(firsts.filter("n > 1 AND refers_to IS NOT NULL"), "digest").filter(
        "NOT (page_id <=> refers_to)").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct()
    later = materialize(later, "revisits")
    dictionary = page_dictionary(rows)
    marked = rows.withColumn("_sha", F.sha1(body.cast("binary")))
    if not later.isEmpty():
        marked = marked.join(later, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest")), "left")
    else:
        marked = marked.withColumn("refers_to", F.lit(None).cast(rows.schema["page_id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if held is not None:
            held.precompute_compress(level=LEVEL)       # digested once per task instead of once per record
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)
        lead, gap = skippable(dictionary), EMPTY_FRAME.encode("latin-1")
        made, size = [lead], 0
        for b in batches:
            for page, address, text, refers in arrow_rows(b, "page_id", "url", "html", "refers_to"):
                data = (text or "").encode("utf-8", "replace")
                made.append(packer.compress(record(page, address, data, base32_sha1(data), refers, refers is not None)))
                size += len(made[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([gap.join(made)], pa.binary())], ["piece"])
                    made, size = [lead], 0
        if len(made) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([gap.join(made)], pa.binary())], ["piece"])

    # A row is an archive.
    write_frames(marked.select("page_id", "url", "html", "refers_to").mapInArrow(run, "piece binary"), "piece", path, EMPTY_FRAME, 1)


def read_archives(spark, path: str, id_type: str = "bigint") -> DataFrame:
    """Every record of the archives in a folder; a bad frame, header, length or digest is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "body"]
        for b in batches:
            for (content,) in arrow_rows(b, "content"):
                held: list[dict] = []
                size = 0
                for found in read_archive(content):
                    held.append(found)
                    size += found["payload_bytes"]
                    if size > 8 << 20:
                        yield _batch(held, names)
                        held, size = [], 0
                if held:
                    yield _batch(held, names)

    raw = read_files(spark, path).mapInArrow(
        run, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, body binary")
    return raw.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def archive_folder(spark, label: str) -> str:
    """A new folder for archives in the shared folder of the session."""
    import uuid

    from riskloom.session import shared_folder
    return os.path.join(shared_folder(spark), "riskloom", f"{label}-{uuid.uuid4().hex}")
