"""WARC archives in seekable Zstandard bundles.

Layout of a bundle file:

    [frame 0][frame 1]...            independent zstd frames, whole records in each
    [skippable frame 0x184D2A5D]     record map: JSON lines, zlib-compressed:
                                     record id, frame number, offset in the frame, length
    [skippable frame 0x184D2A5E]     seek table of the public seekable format: per frame
                                     (compressed size, size), then the footer
                                     (number of frames, descriptor, magic 0x8F92EAB1)

So any zstd reader restores the WARC stream, and a reader that has the file's
end can fetch one record by decompressing one frame. The record map's frame is
listed in the seek table with size 0.

Writing: payload digests first (a slim table: row key, digest, length); the
largest page of each digest with at least ``MIN_REVISIT`` bytes is the
response, the others revisit it. The page rows are then dealt once, by row
key, with their slim decision, and each task streams them into frames and
closes a bundle at ``BUNDLE_BYTES``; memory is one bundle plus one record.
Spark's own text writer puts the bytes of a bundle into a file of its own in
any file system it knows, with its commit protocol, so a lost or repeated task
leaves no partial file: the last four bytes of the footer are the writer's
"line separator".

Defined cases
* null html: empty payload; null url: the record has no target URI;
* null page_id: a record with id ``null``; it never is the response of another page (a page
  with an id is preferred), ties between equal ids go to one of the equal rows;
* repeated rows: one record each, record ids end in a running number per task;
* very long pages: a frame of their own; control characters in a url are percent-coded;
* empty table: no files, empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeze, shared_path

MIN_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
# Fixed values of the zstd frame format and its seekable extension.
SKIP_MAP = 0x184D2A5D
SKIP_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
MAGIC_BYTES = struct.pack("<I", SEEK_MAGIC)

RECORD_SCHEMA = ("bundle string, frame int, frame_offset long, record_length long, record_id string, "
                 "record_type string, page_id long, target_uri string, refers_to long, payload_bytes long, "
                 "payload_digest string")


def warc_record(record_id: str, kind: str, page_id, url: str | None, digest: str, size: int, refers_to,
                payload: bytes) -> bytes:
    """One WARC 1.1 record; a revisit carries no payload."""
    uri = None if url is None else "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Page-ID: {_id(page_id)}",
            *([f"WARC-Target-URI: {uri}"] if uri is not None else []), f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Payload-Length: {size}", "Content-Type: text/html"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To-Page: {_id(refers_to)}"]
        payload = b""
    return ("\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""])).encode() + payload + b"\r\n\r\n"


def _id(x) -> str:
    return "null" if x is None else str(x)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[:int(fields["Content-Length"])]


class Bundle:
    """Collects records into frames and seals them with map and seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard
        self.zstd, self.limit = zstandard.ZstdCompressor(level=level), frame_bytes
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.map: list[str] = []
        self.open, self.open_bytes, self.packed, self.raw = [], 0, 0, 0

    def add(self, record_id: str, record: bytes) -> None:
        if self.open and self.open_bytes + len(record) > self.limit:
            self._frame()
        self.map.append(json.dumps([record_id, len(self.sizes), self.open_bytes, len(record)]))
        self.open.append(record)
        self.open_bytes += len(record)

    def _frame(self) -> None:
        data = b"".join(self.open)
        packed = self.zstd.compress(data)
        self.parts.append(packed)
        self.sizes.append((len(packed), len(data)))
        self.packed, self.raw = self.packed + len(packed), self.raw + len(data)
        self.open, self.open_bytes = [], 0

    def sealed(self) -> bytes:
        if self.open:
            self._frame()
        body = zlib.compress("\n".join(self.map).encode())
        record_map = struct.pack("<II", SKIP_MAP, len(body)) + body
        sizes = [*self.sizes, (len(record_map), 0)]
        table = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IB", len(sizes), 0) + MAGIC_BYTES
        return b"".join([*self.parts, record_map, struct.pack("<II", SKIP_SEEK, len(table)), table])


def frames_of(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each data frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    sizes = struct.iter_unpack("<II", data[-9 - 8 * n:-9])
    out, at = [], 0
    for packed, raw in sizes:
        out.append((at, packed, raw))
        at += packed
    return out


def map_of(data: bytes) -> list[tuple[str, int, int, int]]:
    """(record id, frame, offset in the frame, length) of each record."""
    at, packed, _ = frames_of(data)[-1]
    body = zlib.decompress(data[at + 8:at + packed])
    return [tuple(json.loads(x)) for x in body.decode().split("\n")] if body else []


def read_record(data: bytes, record_id: str) -> tuple[dict[str, str], bytes]:
    """Random access: decompress only the frame that holds the record."""
    import zstandard
    frames = frames_of(data)
    for rid, frame, off, length in map_of(data):
        if rid == record_id:
            at, packed, raw = frames[frame]
            return parse_record(zstandard.ZstdDecompressor().decompress(data[at:at + packed], max_output_size=raw)[off:off + length])
    raise KeyError(record_id)


def _decisions(pages: DataFrame) -> DataFrame:
    """Every row that revisits another: (key, refers_to, refers_null)."""
    slim = freeze(pages.select("key", "page_id", "digest", "size"), "warc-digests")
    big = slim.where(F.col("size") >= MIN_REVISIT)
    # the largest page of each payload; rows of one id are told apart by key
    first = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "key")
    best = freeze(big.groupBy("digest", "size").agg(F.max(first).alias("best"), F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > 1).select("digest", "size", "best"), "warc-best")
    return freeze(big.join(best, ["digest", "size"]).where(F.col("key") != F.col("best.key"))
                  .select("key", F.col("best.page_id").alias("refers_to"), F.lit(True).alias("revisit")).distinct(),
                  "warc-revisits")


def write_bundles(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write one WARC record per row into bundle files below ``path``."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
                     F.coalesce(F.col(html), F.lit("")).alias("html"))
    body = F.encode("html", "UTF-8")
    p = p.select("page_id", "url", "html", F.sha1(body).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    # A row's key is its content, so it is the same in every run of a task. Equal rows share a
    # key and are one decision; the writer numbers them.
    p = p.withColumn("key", F.xxhash64("page_id", "url", "digest", "size"))
    spark = pages.sparkSession
    # The only shuffle of the payloads; the join to the decisions uses the same partitioning.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    j = (p.repartition(n, "key").join(_decisions(p), "key", "left")
         .select("key", "page_id", "url", "html", "digest", "size", "revisit", "refers_to")
         .sortWithinPartitions("page_id", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, seen = None, {}
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(k)[i].as_py() for k, f in enumerate(batch.schema.names)}
                if row["page_id"] != last:  # rows of one id are next to each other
                    seen, last = {}, row["page_id"]
                copy = seen[row["key"]] = seen.get(row["key"], 0) + 1
                # one of several equal rows is the response, its copies revisit it
                revisit = bool(row["revisit"]) or copy > 1 and row["size"] >= MIN_REVISIT
                refers = row["refers_to"] if row["revisit"] else row["page_id"]
                rid = f"{_id(row['page_id'])}:{row['key'] & 0xFFFFFFFFFFFFFFFF:016x}:{copy}"
                rec = warc_record(rid, "revisit" if revisit else "response", row["page_id"], row["url"], row["digest"],
                                  row["size"], refers, row["html"].encode())
                bundle = bundle or Bundle(frame_bytes)
                bundle.add(rid, rec)
                if bundle.packed >= bundle_bytes:
                    yield _out(bundle)
                    bundle = None
        if bundle:
            yield _out(bundle)

    def _out(bundle: Bundle) -> pa.RecordBatch:
        # the writer's separator completes the footer
        return pa.RecordBatch.from_arrays([pa.array([bundle.sealed()[:-4]], pa.binary())], names=["data"])

    (j.mapInArrow(run, "data binary").select(F.expr("cast(data as string)").alias("value")).write
     .option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", MAGIC_BYTES.decode("latin-1"))
     .text(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles below ``path``: place (bundle file, frame,
    offset in the frame, length) and headers. Frames are decompressed one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes()
                frames, by_frame = frames_of(data), {}
                for rid, frame, off, length in map_of(data):
                    by_frame.setdefault(frame, []).append((rid, off, length))
                for frame, recs in by_frame.items():
                    at, packed, raw = frames[frame]
                    text = z.decompress(data[at:at + packed], max_output_size=raw)
                    rows = [_row(name, frame, rid, off, length, text) for rid, off, length in recs]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_NAMES)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD_SCHEMA)


_NAMES = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in RECORD_SCHEMA.split(", ")]


def _row(name: str, frame: int, rid: str, off: int, length: int, text: bytes) -> tuple:
    head, body = parse_record(text[off:off + length])
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
    kind = head["WARC-Type"]
    if head["WARC-Record-ID"] != f"<urn:page:{rid}>":
        raise ValueError(f"record map of {name} is off at {rid}")
    if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"payload of {rid} in {name} differs from its digest")
    num = lambda x: None if x in (None, "null") else int(x)
    return (name, frame, off, length, rid, kind, num(head["WARC-Page-ID"]), head.get("WARC-Target-URI"),
            num(head.get("WARC-Refers-To-Page")), size, digest)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(record_id, payload) of the ``wanted`` rows of an index: only their frames are decompressed."""
    import zstandard  # noqa: F401  (fail early on the driver)
    at = wanted.select("bundle", "record_id")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("bundle"), "content")
    j = files.join(at.groupBy("bundle").agg(F.collect_list("record_id").alias("ids")), "bundle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_buffer().to_pybytes()
                for rid in batch.column(2)[i].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([read_record(data, rid)[1]], pa.binary())],
                                                     names=["record_id", "payload"])

    return j.select("bundle", "content", "ids").mapInArrow(run, "record_id string, payload binary")


def archive(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write the pages to bundles and read the archives back (see ``read_index``)."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_bundles(pages, path, **kw)
    return read_index(spark, path)
