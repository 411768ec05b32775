"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames that are compressed on their own; a bundle is a
run of frames followed by a seek table in a skippable frame (the public seekable
format), so a reader that has the end of a bundle can open any one frame. The
index maps a record to its bundle, its frame and its place within the frame.

Bundles are rows of a table, written by Spark: a lost task is written again
and no half-written archive is ever seen. ``save_files`` copies them out as
``.warc.zst`` files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priceloom.functions.scale import settle
from priceloom.llm.common import bounded_batches, table

# Payloads below this size are always stored.
REVISIT_BYTES = 1000
# A frame is closed at this many bytes before compression, a bundle at this many after it.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 8 << 20
LEVEL = 3
# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_BUNDLE = "bundle_id string, content binary, records array<struct<page_id:long,frame:int,offset:long,length:long>>"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decide(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages that revisit another: _id, _sha, _refers. ``pages`` has page_id and html.

    Only narrow columns move: the largest page_id per payload is a map-side combined
    aggregate, joined back to the pages that share their payload.
    """
    keys = settle(
        pages.select(F.col("page_id").alias("_id"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("_p"))
        .select("_id", F.length("_p").alias("_bytes"), F.sha1("_p").alias("_sha"), F.xxhash64("_p").alias("_more"))
        .where(F.col("_bytes") >= least),
        "payload-keys",
    )
    same = ["_sha", "_more", "_bytes"]
    shared = keys.groupBy(*same).agg(F.max("_id").alias("_refers"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return keys.join(shared, same).where(~F.col("_id").eqNullSafe(F.col("_refers"))).select("_id", "_sha", "_refers").distinct()


def _uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit keeps the response's headers and leaves out the payload."""
    sha = hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}",
        *([f"WARC-Profile: {IDENTICAL_PAYLOAD}", f"WARC-Refers-To: {_uri(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: compressed and plain size of each frame."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_places(bundle: bytes) -> list[tuple[int, int, int]]:
    """From the footer: where each frame starts, its compressed and its plain size."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    sizes = list(struct.iter_unpack("<II", bundle[-9 - 8 * count:-9]))
    places, at = [], 0
    for packed, plain in sizes:
        places.append((at, packed, plain))
        at += packed
    return places


class _Bundler:
    """Collects records into frames and frames into bundles."""

    def __init__(self, frame_bytes: int, bundle_bytes: int):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True).compress
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self._start()

    def _start(self):
        self.frames, self.sizes, self.index, self.packed = [], [], [], 0
        self.open, self.open_size = [], 0

    def _close_frame(self):
        if self.open:
            data = self.pack(b"".join(self.open))
            self.frames.append(data)
            self.sizes.append((len(data), self.open_size))
            self.packed += len(data)
            self.open, self.open_size = [], 0

    def add(self, page_id, data: bytes):
        if self.open and self.open_size + len(data) > self.frame_bytes:
            self._close_frame()
        self.index.append({"page_id": page_id, "frame": len(self.frames), "offset": self.open_size, "length": len(data)})
        self.open.append(data)
        self.open_size += len(data)
        if self.open_size >= self.frame_bytes:
            self._close_frame()
        return self.finish() if self.packed >= self.bundle_bytes else None

    def finish(self):
        self._close_frame()
        if not self.frames:
            return None
        content = b"".join(self.frames) + seek_table(self.sizes)
        row = (hashlib.sha256(content).hexdigest()[:32], content, self.index)
        self._start()
        return row


def write_bundles(
    pages: DataFrame, least: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Bundles of all ``pages`` (page_id, url, html): bundle_id, content, records; the caller writes them as a table.

    A null html is an empty payload, a null url an empty target. Of equal payloads of
    ``least`` bytes or more the one with the largest page_id is the response; further
    rows with that same page_id are responses too. A null page_id revisits as any other.
    Other columns are not read. An empty table gives no bundle.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    pages = pages.select("page_id", F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    revisits = settle(decide(pages, least), "revisits")
    # the small side is hashed, so the pages are not sorted; ids spread them evenly however many share a payload
    marked = pages.withColumn("_hash", F.sha1(F.col("html").cast("binary"))).join(
        revisits.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_sha")), "left"
    ).select("page_id", "url", "html",
             F.col("_sha").isNotNull().alias("revisit"), F.col("_refers").alias("refers_to"))
    arrow = pa.schema([
        ("bundle_id", pa.string()), ("content", pa.binary()),
        ("records", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = _Bundler(frame_bytes, bundle_bytes)

        def out(row):
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, revisit, refers = (batch.column(c)[i].as_py() for c in range(5))
                row = bundler.add(page_id, record(page_id, url, html.encode("utf-8"), refers, revisit))
                if row:
                    yield out(row)
        row = bundler.finish()
        if row:
            yield out(row)

    return marked.mapInArrow(run, _BUNDLE)


def _page(uri: str) -> int | None:
    name = uri[len("<urn:page:"):-1]
    return None if name == "null" else int(name)


def _read(record_parts: tuple[dict[str, str], bytes]) -> tuple:
    """The record as a row; a stored payload must have the digest that the record names."""
    headers, block = record_parts
    head, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    sha = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != sha):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    refers = _page(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return _page(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, sha.hex(), kind, refers, payload if kind == "response" else None


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the bundles, frame by frame: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    bounded_batches(bundles.sparkSession)
    ddl = _RECORD + (", payload binary" if with_payload else "")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 7 if with_payload else 6]
    names = [part.split()[0] for part in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                bundle = batch.column(0)[i].as_py()
                for start, packed, plain in frame_places(bundle):
                    data, at, rows = unpack(bundle[start:start + packed], max_output_size=plain), 0, []
                    while at < len(data):
                        headers, block, at = parse(data, at)
                        rows.append(_read((headers, block)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=t) for c, t in zip(list(zip(*rows))[: len(types)], types)], names=names
                    )

    return bundles.select("content").mapInArrow(run, ddl)


def index(bundles: DataFrame) -> DataFrame:
    """page_id -> bundle_id, frame, offset within the plain frame, length."""
    return bundles.select("bundle_id", F.explode("records").alias("r")).select("r.page_id", "bundle_id", "r.frame", "r.offset", "r.length")


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the ``wanted`` page_ids, opening only the frames that hold them."""
    bounded_batches(bundles.sparkSession)
    places = index(bundles).join(wanted.select("page_id").distinct(), "page_id")
    asked = places.groupBy("bundle_id").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("asked"))
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                bundle, rows = batch.column(0)[i].as_py(), []
                places, opened = frame_places(bundle), {}
                for spot in sorted(batch.column(1)[i].as_py(), key=lambda s: (s["frame"], s["offset"])):
                    if spot["frame"] not in opened:
                        start, packed, plain = places[spot["frame"]]
                        opened = {spot["frame"]: unpack(bundle[start:start + packed], max_output_size=plain)}
                    headers, block, _ = parse(opened[spot["frame"]], spot["offset"])
                    rows.append(_read((headers, block)))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    return bundles.join(asked, "bundle_id").select("content", "asked").mapInArrow(run, _RECORD + ", payload binary")


def save_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Copy bundles out as ``<folder>/<bundle_id>.warc.zst``; any store that Arrow reaches. Returns the paths written.

    A bundle is written under a name of its own and then renamed, so a repeated
    task leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for batch in batches:
            names = []
            for bundle_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{root}/{bundle_id}.warc.zst"
                part = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string())], names=["path"])

    return bundles.select("bundle_id", "content").mapInArrow(run, "path string")


def op3_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as bundles and read back."""
    bundles = settle(write_bundles(table(spark, sf_dir, "pages")), "warc")
    return read_bundles(bundles).drop("url")


ORACLE = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), d AS (
    SELECT *, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d
"""
