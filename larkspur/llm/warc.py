"""Seekable Zstandard bundles of web records, with an index from record to frame and offset within the frame.

Each task cuts its pages into bundles without any shuffle. A bundle is a row: independent frames, each a group of whole
WARC records; a skippable frame at the end is the seek table of the public seekable format (sizes of each frame, count,
magic); the index maps record identifiers to (frame, offset within it, length). A reader fetches the footer, then one frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import integer

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records, before compression, after which a frame or a bundle is closed.
FRAME, BUNDLE = 1 << 20, 1 << 24
DATE = "1970-01-01T00:00:00Z"

ENTRY = pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
SCHEMA = pa.schema([("bundle_id", pa.string()), ("n_frames", pa.int32()), ("n_records", pa.int32()), ("content", pa.binary()), ("entries", pa.list_(ENTRY))])
DDL = "bundle_id string, n_frames int, n_records int, content binary, entries array<struct<page_id: bigint, record_id: string, frame: int, offset: bigint, length: bigint>>"


def record(page_id: int | None, url: str | None, body: bytes | None, date: str = DATE) -> tuple[str, bytes]:
    """The record's identifier, a digest of all it says, and its bytes. A null body has no payload and says so; a null url no target."""
    digest = hashlib.sha256(repr((page_id, url)).encode() + b"\0" + (b"-" if body is None else b"+" + body)).hexdigest()
    name = f"<urn:uuid:{digest[:8]}-{digest[8:12]}-5{digest[13:16]}-a{digest[17:20]}-{digest[20:32]}>"
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
        if "\r" in url or "\n" in url:  # as it was, for reading
            head.append("X-Target-URI: " + json.dumps(url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append("X-Null-Payload: 1" if body is None else f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body or b'')}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + (body or b"") + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes | None]:
    """A record's headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if "X-Target-URI" in fields:
        fields["WARC-Target-URI"] = json.loads(fields.pop("X-Target-URI"))
    return fields, None if "X-Null-Payload" in fields else rest[: int(fields["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: (compressed, original) bytes of each frame, without checksums (each frame has its own)."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """(start, compressed length) of each frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    width = 12 if flags & 0x80 else 8
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    table, start, found = bundle[-9 - count * width : -9], 0, []
    for i in range(count):
        size = struct.unpack_from("<I", table, i * width)[0]
        found.append((start, size))
        start += size
    return found


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes | None]:
    """One record: only its own frame is decompressed."""
    start, size = read_seek_table(bundle)[frame]
    return parse(zstandard.ZstdDecompressor().decompress(bundle[start : start + size])[offset : offset + length])


class _Bundle:
    def __init__(self, level: int):
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.content, self.frames, self.entries, self.open, self.held, self.size = [], [], [], [], 0, 0

    def add(self, page_id: int | None, url: str | None, body: bytes | None, frame: int) -> None:
        name, data = record(page_id, url, body)
        if self.held and self.held + len(data) > frame:
            self.close_frame()
        self.entries.append({"page_id": page_id, "record_id": name, "frame": len(self.frames), "offset": self.held, "length": len(data)})
        self.open.append(data)
        self.held += len(data)
        self.size += len(data)

    def close_frame(self) -> None:
        if self.held:
            self.content.append(self.zstd.compress(b"".join(self.open)))
            self.frames.append((len(self.content[-1]), self.held))
            self.open, self.held = [], 0

    def row(self) -> pa.RecordBatch:
        self.close_frame()
        content = b"".join(self.content) + seek_table(self.frames)
        row = {"bundle_id": hashlib.sha256(content).hexdigest(), "n_frames": len(self.frames), "n_records": len(self.entries), "content": content, "entries": self.entries}
        return pa.RecordBatch.from_pylist([row], SCHEMA)


def bundle(pages: DataFrame, frame: int = FRAME, size: int = BUNDLE, level: int = 3) -> DataFrame:
    """One row a bundle: bundle_id (digest of content), n_frames, n_records, content, entries.

    pages has page_id, an integer (any other kind is a TypeError), url and html; other columns, whatever their names, are not read. Every row is a record, repeated rows too (their records have
    the same identifier and an entry each); any of the columns may be null, and reading tells null from empty. A record
    longer than a frame has a frame of its own, whole. All records bear the same date, as pages have none. An empty table gives no bundle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Bundle(level)
        for batch in batches:
            ids, urls, bodies = batch.column(0), batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                now.add(ids[i].as_py(), urls[i].as_py(), bodies[i].as_py(), frame)
                if now.size >= size:
                    yield now.row()
                    now = _Bundle(level)
        if now.entries:
            yield now.row()

    return pages.select(integer(pages, "page_id").alias("page_id"), "url", F.col("html").cast("binary")).mapInArrow(cut, DDL)


def index(bundles: DataFrame) -> DataFrame:
    """(record_id, page_id, bundle_id, frame, offset, length): a row a record."""
    return bundles.select("bundle_id", F.explode("entries").alias("e")).select("e.record_id", "e.page_id", "bundle_id", "e.frame", "e.offset", "e.length")


def restore(bundles: DataFrame) -> DataFrame:
    """(page_id, url, html) of every record, frame by frame: the inverse of bundle()."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                frames, zstd, now, data = read_seek_table(row["content"]), zstandard.ZstdDecompressor(), -1, b""
                out = []
                for e in row["entries"]:
                    if e["frame"] != now:
                        now = e["frame"]
                        start, length = frames[now]
                        data = zstd.decompress(row["content"][start : start + length])
                    head, body = parse(data[e["offset"] : e["offset"] + e["length"]])
                    out.append({"page_id": e["page_id"], "url": head.get("WARC-Target-URI"), "html": None if body is None else body.decode()})
                yield pa.RecordBatch.from_pylist(out, schema)

    return bundles.select("content", "entries").mapInArrow(read, "page_id long, url string, html string")
