"""WARC in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; frames follow each other in a bundle, which ends with a
footer seek table (a skippable frame of the Zstandard seekable format). The index maps a record to its bundle,
frame and the offset inside the decompressed frame, so one record costs one frame. Bundles are rows of a
Parquet table in the shared folder: the writer's commit makes each appear once, whatever executors are lost;
export() writes them as .warc.zst files.

Of records with equal payloads of at least min_payload bytes, the one with the smallest page_id is a response
and the others revisit it; smaller ones are all responses. Rows that share that smallest page_id are all
responses. A null page_id ranks last: such a row is a response only if its payload has no other holder. Null
html counts as empty, a null url leaves its header out. Only page_id, url and html are read. An empty table
gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import own_key, staged

#: Raw bytes from which a frame, and a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 16 << 20
LEVEL = 3

#: Fixed by the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _of_uri(uri: str) -> int | None:
    inner = uri[len("<urn:page:") : -1]
    return int(inner) if inner else None


def record(page_id, url: str | None, payload: bytes, first, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header, which tells the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_uri(first)}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of the given compressed and raw sizes."""
    body = b"".join(struct.pack("<II", c, r) for c, r in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames_of(read, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame; read(offset, length) gives bytes of the bundle."""
    count, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    table, out, at = read(size - 9 - count * width, count * width), [], 0
    for i in range(count):
        c, r = struct.unpack_from("<II", table, i * width)
        out.append((at, c, r))
        at += c
    return out


def read_record(read, size: int, frame: int, offset: int, length: int) -> dict:
    """One record by its place in the index; only its frame is read and decompressed."""
    at, c, raw = frames_of(read, size)[frame]
    data = zstandard.ZstdDecompressor().decompress(read(at, c), max_output_size=raw)
    return next(parse(data[offset : offset + length]))


def parse(data: bytes):
    """The records of one decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        told = int(http.rsplit(b"Content-Length: ", 1)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != told or payload_digest(payload) != digest):
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        refers = head.get("WARC-Refers-To")
        yield {
            "page_id": _of_uri(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload_bytes": told, "payload_digest": digest,
            "record_type": head["WARC-Type"], "refers_to": _of_uri(refers) if refers else None, "payload": payload,
        }
        at = end + 4 + size + 4


class Bundler:
    """Collects records into frames and a bundle."""

    def __init__(self):
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.clear()

    def clear(self):
        self.frames, self.sizes, self.index, self.open, self.open_bytes, self.raw = [], [], [], [], 0, 0

    def add(self, page_id, data: bytes):
        self.index.append({"page_id": page_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(data)})
        self.open.append(data)
        self.open_bytes += len(data)
        self.raw += len(data)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self):
        if self.open:
            packed = self.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def bundle(self) -> tuple[bytes, list[dict]]:
        self.close_frame()
        out = b"".join(self.frames) + seek_table(self.sizes), self.index
        self.clear()
        return out


_INDEX = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
_BUNDLE = pa.schema([("bundle_id", pa.string()), ("content", pa.binary()), ("records", _INDEX)])
BUNDLE_DDL = "bundle_id string, content binary, records array<struct<page_id:bigint,frame:int,offset:bigint,length:bigint>>"


def _pack(batches):
    from pyspark import TaskContext

    part, made, bundler = TaskContext.get().partitionId(), 0, Bundler()

    def emit():
        nonlocal made
        content, index = bundler.bundle()
        made += 1
        return pa.RecordBatch.from_pylist([{"bundle_id": f"{part:06d}-{made:05d}", "content": content, "records": index}], schema=_BUNDLE)

    for batch in batches:
        cols = [batch.column(c) for c in ("page_id", "url", "html", "first", "revisit")]
        for i in range(batch.num_rows):
            page_id, url, html, first, revisit = (c[i].as_py() for c in cols)
            bundler.add(page_id, record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), first, revisit))
            if bundler.raw >= BUNDLE_BYTES:
                yield emit()
    if bundler.index:
        yield emit()


def pack(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """The bundles as rows: bundle_id, content (the archive's bytes), records (the index of what it holds)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    firsts = rows.select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("first")).select(own_key("digest").alias("digest2"), "first")
    both = rows.join(firsts, rows["digest"] == firsts["digest2"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_payload)
    return both.select("page_id", "url", "html", "first", revisit.alias("revisit")).mapInArrow(_pack, BUNDLE_DDL)


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
ROW_DDL = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _unpack(batches):
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_buffer().to_pybytes()
            for at, c, raw in frames_of(lambda o, n: data[o : o + n], len(data)):
                rows = [{k: r[k] for k in _ROW.names} for r in parse(expand(data[at : at + c], max_output_size=raw))]
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


def unpack(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, read from the archives; responses are checked against their digests."""
    return bundles.select("content").mapInArrow(_unpack, ROW_DDL)


def index(bundles: DataFrame) -> DataFrame:
    """page_id, bundle_id, frame, offset, length."""
    return bundles.select("bundle_id", F.explode("records").alias("r")).select("r.page_id", "bundle_id", "r.frame", "r.offset", "r.length")


def archive(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """pack(), written to the shared folder and read back."""
    return staged(pack(pages, min_payload), "warc-bundles")


def export(bundles: DataFrame, uri: str) -> DataFrame:
    """Write each bundle as <uri>/<bundle_id>.warc.zst on a file system that all executors reach; gives the files' names and sizes."""

    def write(batches):
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(uri)
        target.create_dir(root, recursive=True)
        for batch in batches:
            for bundle_id, content in zip(batch.column("bundle_id").to_pylist(), batch.column("content")):
                data, path = content.as_buffer(), f"{root}/{bundle_id}.warc.zst"
                with target.open_output_stream(path + ".part") as out:
                    out.write(data)
                target.move(path + ".part", path)
                yield pa.RecordBatch.from_pylist([{"file": path, "bytes": data.size}], schema=pa.schema([("file", pa.string()), ("bytes", pa.int64())]))

    return bundles.select("bundle_id", "content").mapInArrow(write, "file string, bytes bigint")
