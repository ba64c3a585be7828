"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is its frames followed by a seek table in a skippable
frame, so any Zstandard reader can read all of it and a seeking reader can decompress one frame alone. The index maps
each record to its bundle, frame, and offset in the frame's plain bytes.

Bundles are rows of a table that Spark writes, so they land wherever Spark can write and each task's output is
committed as a whole; export_bundles() copies them out as .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.llm.common import rows, staged, utf8

#: Plain bytes after which a frame is closed, and packed bytes after which a bundle is.
FRAME, BUNDLE = 1 << 18, 1 << 23

# Fixed values of the seekable format: skippable frame, its footer, and that entries hold no checksums.
SKIPPABLE, SEEKABLE, NO_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0

INDEX = "array<struct<page_id:long,frame:int,offset:int,length:int>>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record if refers_to is given: its HTTP head still tells the payload's length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC headers, HTTP headers and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


class BundleWriter:
    def __init__(self, frame: int = FRAME, level: int = 3):
        self.limit, self.packer = frame, zstandard.ZstdCompressor(level=level)
        self.frames, self.sizes, self.index, self.plain, self.size = [], [], [], bytearray(), 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.plain and len(self.plain) + len(data) > self.limit:
            self.close_frame()
        self.index.append({"page_id": page_id, "frame": len(self.frames), "offset": len(self.plain), "length": len(data)})
        self.plain += data

    def close_frame(self) -> None:
        if self.plain:
            self.frames.append(self.packer.compress(bytes(self.plain)))
            self.sizes.append((len(self.frames[-1]), len(self.plain)))
            self.size += len(self.frames[-1])
            self.plain = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), NO_CHECKSUMS, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries)) + entries


class BundleReader:
    def __init__(self, data: bytes):
        count, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        self.data, self.frames, at = data, [], 0
        table = len(data) - 9 - count * width
        for i in range(count):
            packed, plain = struct.unpack_from("<II", data, table + i * width)
            self.frames.append((at, packed, plain))
            at += packed
        self.reader, self.held = zstandard.ZstdDecompressor(), (-1, b"")

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.held[0] != frame:
            at, packed, plain = self.frames[frame]
            self.held = frame, self.reader.decompress(self.data[at : at + packed], max_output_size=plain)
        return self.held[1][offset : offset + length]


def _sha(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_payload: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE) -> DataFrame:
    """A table (bundle string, data binary, records array) in the shared folder, one WARC record for each row of pages.

    Of the rows with equal payloads (SHA-1 and length) of at least least_payload bytes, those with the smallest id are
    responses and the others revisit it; shorter ones are all responses. Null html is an empty payload, null urls give
    no target, rows without an id are responses unless a row with an id has their payload. An empty table gives none.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    size = F.octet_length("payload")
    firsts = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least_payload).groupBy("digest").agg(F.min("id").alias("first"))
    told = source.join(firsts, "digest", "left").select("id", "url", "payload", "digest", F.when((size >= least_payload) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number, part = BundleWriter(frame_bytes), 0, 0

        def done() -> pa.RecordBatch:
            data = writer.finish()
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}"]), pa.array([data], pa.binary()), pa.array([writer.index], kind)], ["bundle", "data", "records"])

        kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for page, url, body, digest, refers, part in rows([batch.slice(i, 64)]):
                    writer.add(page, record(page, url, body, _sha(digest), refers, date))
                    if writer.size >= bundle_bytes:
                        yield done()
                        writer, number = BundleWriter(frame_bytes), number + 1
        if writer.index:
            yield done()

    return staged(told.mapInArrow(run, f"bundle string, data binary, records {INDEX}"), "warc", compression="uncompressed")


def read_bundles(bundles: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per record, read through the seek table and index: id, payload_bytes and payload_digest of the full payload, record_type, refers_to, target, payload (null for revisits), bundle, frame, offset, length."""
    schema = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target", pa.string()), ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda urn: int(urn[10:-1]) if urn and len(urn) > 11 else None
        for batch in batches:
            for i in range(batch.num_rows):
                bundle, data, index = (c[i].as_py() for c in batch.columns)
                reader, out = BundleReader(data), []
                for e in index:
                    warc, http, body = parse(reader.read(e["frame"], e["offset"], e["length"]))
                    whole, size = warc["WARC-Type"] == "response", int(http["Content-Length"])
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if number(warc["WARC-Record-ID"]) != e["page_id"] or whole and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                        raise ValueError(f"bundle {bundle}: record {e} is damaged")
                    out.append((e["page_id"], size, digest, warc["WARC-Type"], number(warc.get("WARC-Refers-To")), warc.get("WARC-Target-URI"), body if whole else None, bundle, e["frame"], e["offset"], e["length"]))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    read = bundles.select("bundle", "data", "records").mapInArrow(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, payload binary, bundle string, frame int, offset int, length int")
    return read.withColumnRenamed("id", id_col)


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as <folder>/<bundle>.warc.zst, a folder mounted on each executor; returns (bundle, path, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, data = batch.column(0).to_pylist(), utf8(batch.column(1))
            paths = [os.path.join(folder, f"{n}.warc.zst") for n in names]
            for path, x in zip(paths, data, strict=True):
                with open(f"{path}.part", "wb") as f:
                    f.write(x)
                os.replace(f"{path}.part", path)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(paths), pa.array([len(x) for x in data], pa.int64())], ["bundle", "path", "bytes"])

    return bundles.select("bundle", "data").mapInArrow(run, "bundle string, path string, bytes long")
