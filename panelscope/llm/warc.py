"""WARC archives in seekable Zstandard bundles.

Records are gathered into frames that are compressed independently; a bundle is a run of frames followed by
the seek table of the seekable format (a skippable frame, so any Zstandard reader can read the whole).  An
index maps a record's page to bundle, frame and its offset in the frame, so one record costs the
decompression of one frame.

Bundles are rows of a table (one archive each), because a shared store need not be a file system that
Python can open; ``export`` writes them as files where a folder is mounted.

Defined results.  Only page_id, url and html are read.  Null html is an empty payload, a null url leaves
out its header, line breaks in urls are escaped.  Among records with equal payloads of at least 100 bytes those with the
smallest page_id are responses (all of them, if an id is repeated) and the others revisit it; where all ids are null, all are responses.
An empty table gives no bundles.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import conform, heavy_join, read, settle
from panelscope.llm.registry import query
from panelscope.session import scratch_path

#: Payloads from this size on are stored once.
LEAST_SHARED = 100
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
DATE = "2026-01-01T00:00:00Z"

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

BUNDLES = "bundle string, archive binary, records array<struct<page_id: long, frame: int, offset: long, length: long>>"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _page(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(text: str) -> int | None:
    digits = text.strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def record(page_id, url, kind: str, refers_to, payload: bytes, size: int, digest: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_page(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_page(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http = block.index(b"\r\n\r\n") + 4
    size = next(int(x.split(b": ")[1]) for x in block[:http].split(b"\r\n") if x.startswith(b"Content-Length: "))
    payload, url = block[http:], head.get("WARC-Target-URI")
    if head["WARC-Type"] == "response" and len(payload) != size:
        raise ValueError("a payload is cut")
    return {
        "page_id": _page_of(head["WARC-Record-ID"]),
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": head["WARC-Type"],
        "refers_to": _page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
        "payload_bytes": size,
        "payload_digest": hashlib.sha256(payload).hexdigest() if head["WARC-Type"] == "response" else head["WARC-Payload-Digest"].partition(":")[2],
        "payload": payload if head["WARC-Type"] == "response" else None,
    }, end + 4 + int(head["Content-Length"]) + 4


class Bundle:
    """A seekable archive in the making."""

    def __init__(self, level: int = 3):
        self.codec = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open = bytearray()
        self.size = 0

    def add(self, page_id, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > FRAME_BYTES:
            self.flush()
        self.index.append({"page_id": page_id, "frame": len(self.frames), "offset": len(self.open), "length": len(data)})
        self.open += data

    def flush(self) -> None:
        if self.open:
            frame = self.codec.compress(bytes(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), len(self.open)))
            self.size += len(frame)
            self.open = bytearray()

    def close(self) -> bytes:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and whole size of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entries = archive[len(archive) - 9 - 8 * count : len(archive) - 9]
    found, at = [], 0
    for packed, whole in struct.iter_unpack("<II", entries):
        found.append((at, packed, whole))
        at += packed
    return found


def frame(archive: bytes, table: list[tuple[int, int, int]], n: int) -> bytes:
    at, packed, whole = table[n]
    return zstandard.ZstdDecompressor().decompress(archive[at : at + packed], max_output_size=max(1, whole))


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("bundle", pa.string()),
        ("archive", pa.binary()),
        ("records", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))),
    ])
    part, bundle, made = TaskContext.get().partitionId(), Bundle(), 0

    def done() -> pa.RecordBatch:
        row = {"bundle": f"{part:06d}-{made:06d}.warc.zst", "archive": bundle.close(), "records": bundle.index}
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        for n in range(batch.num_rows):
            page_id, url, html, first, size, digest = (batch.column(c)[n].as_py() for c in range(6))
            kind = "response" if first is None or first == page_id else "revisit"
            bundle.add(page_id, record(page_id, url, kind, first, (html or "").encode(), size, digest))
            if bundle.size >= BUNDLE_BYTES:
                yield done()
                bundle, made = Bundle(), made + 1
    if bundle.index:
        yield done()


def write_bundles(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write an archive table for the pages and return it: bundle, archive, records."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit("")).cast("binary")
    hashed = conform(pages, "page_id", "url", "html").withColumns({"size": F.octet_length(html).cast("long"), "digest": F.sha2(html, 256)})
    shared = hashed.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = settle(shared.where("n > 1"), "warc-shared")
    joined = heavy_join(hashed, shared, ["digest"], "n", pages.count(), "left")
    rows = joined.select("page_id", "url", "html", "first", "size", "digest").sortWithinPartitions("page_id")
    path = path or scratch_path(spark, "warc")
    rows.mapInArrow(_bundled, BUNDLES).write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(BUNDLES).parquet(path)


def index(bundles: DataFrame) -> DataFrame:
    """Where each record lies: bundle, frame, offset in the frame, length."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.page_id", "bundle", "r.frame", "r.offset", "r.length")


def _records(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for value in batch.column("archive"):
            archive = value.as_py()
            table = seek_table(archive)
            for n in range(len(table)):
                data, at, found = frame(archive, table, n), 0, []
                while at < len(data):
                    row, at = parse(data, at)
                    found.append(row if keep else row | {"payload": None})
                yield pa.RecordBatch.from_pylist(found, pa.schema(list(zip(names, types, strict=True))))


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives, frame by frame."""
    return bundles.select("archive").mapInArrow(lambda b: _records(b, payloads), RECORDS)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of the wanted page_ids: only the frames that hold them are decompressed."""
    spots = index(bundles).join(wanted.select("page_id").distinct(), "page_id")
    by_bundle = spots.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("spots"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for value, spot in zip(batch.column("archive"), batch.column("spots"), strict=True):
                archive, frames, found = value.as_py(), {}, []
                table = seek_table(archive)
                for s in spot.as_py():
                    if s["frame"] not in frames:
                        frames = {s["frame"]: frame(archive, table, s["frame"])}
                    found.append(parse(frames[s["frame"]], s["offset"])[0])
                yield pa.RecordBatch.from_pylist(found, pa.schema(list(zip(names, types, strict=True))))

    return bundles.select("bundle", "archive").join(by_bundle, "bundle").select("archive", "spots").mapInArrow(pick, RECORDS)


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of a folder that all executors have mounted; returns names and sizes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = batch.column("bundle").to_pylist(), []
            for name, value in zip(names, batch.column("archive"), strict=True):
                data = value.as_py()
                partial = os.path.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}")
                with open(partial, "wb") as f:
                    f.write(data)
                os.replace(partial, os.path.join(folder, name))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["bundle", "bytes"])

    return bundles.select("bundle", "archive").mapInArrow(put, "bundle string, bytes long")


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_SHARED} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""


@query("op2_warc_bundles", SQL)
def _op2(spark, sf_dir):
    bundles = write_bundles(read(spark, sf_dir, "pages"))
    return read_bundles(bundles, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
