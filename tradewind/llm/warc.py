"""WARC records in seekable Zstandard bundles, and an index from record ids to frames.

A bundle is a run of independent Zstandard frames of about FRAME bytes of records each, ended by a
seek table in a skippable frame (the Zstandard seekable format: compressed and plain size of every
frame, their number, and a magic number at the very end). A reader fetches the table from the end of
the file, then any one frame. The index, a Parquet table, names for each record its bundle, its frame
and its offset inside that frame.

Records with equal payloads of LEAST_REVISIT bytes or more: the one with the smallest id holds the payload, the
others are revisits that name it. Payload digests find them, grouped before the shuffle, so a payload
that a third of the pages share is no heavy group; the html itself is shuffled once, by page id.

Each task writes bundles under names of its own and returns their index, so a task that runs again
leaves an unnamed file behind and nothing else. Bundles go to the folder in spark.checkpoint.dir or
one given, through pyarrow's file systems (local and shared mounts, HDFS, S3, GCS).

Null payloads are empty; a null url leaves its header out. Records without an id stay responses, as do
rows that repeat the id and payload of a response. An empty table gives no bundle and an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm import common
from tradewind.sources import scratch

LEAST_REVISIT = 100
FRAME = 256 << 10
BUNDLE = 64 << 20
LEVEL = 6

# Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

INDEX = "page_id bigint, bundle string, frame int, offset bigint, record_bytes bigint"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP header without the payload."""
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parsed(frame: bytes, offset: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at offset of a frame, and the offset of the next one."""
    end = frame.index(b"\r\n\r\n", offset)
    version, *lines = frame[offset:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at offset {offset}")
    headers = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, frame[start:stop], stop + 4


class BundleWriter:
    """Writes records into frames and frames into one bundle."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.file = system.open_output_stream(path, compression=None)  # the frames are compressed already
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.pending, self.pending_bytes, self.bytes = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.pending_bytes >= FRAME:
            self.end_frame()
        at = len(self.sizes), self.pending_bytes
        self.pending.append(data)
        self.pending_bytes += len(data)
        return at

    def end_frame(self) -> None:
        if self.pending:
            packed = self.codec.compress(b"".join(self.pending))
            self.file.write(packed)
            self.sizes.append((len(packed), self.pending_bytes))
            self.bytes += len(packed)
            self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.file.close()


class BundleReader:
    """Frames of a bundle by number, found through the seek table at its end."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {uri}")
        self.file.seek(size - 9 - 8 * frames)
        table = self.file.read(8 * frames)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        self.file.seek(self.starts[number])
        packed, plain = self.sizes[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def revisits(pages: DataFrame) -> DataFrame:
    """id, digest, refers_to of the pages whose payload stands in a page with a smaller id."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    found = pages.select(
        F.col("page_id").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")
    ).filter(F.col("size") >= LEAST_REVISIT)
    least = found.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last"))
    return (
        found.join(least.filter("refers_to < last"), "digest").filter("id > refers_to")
        .select("id", "digest", "refers_to").distinct()
    )


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) into bundles below folder; the stored index of their records."""
    own = common.renamed_clear(pages, ("page_id", "url", "html"))
    # By id and digest: rows that repeat an id may have different payloads.
    digest = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
    again = revisits(own).withColumnRenamed("digest", "twin")
    marked = own.withColumn("digest", digest).join(
        again, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("twin")), "left"
    ).withColumn("revisit", F.col("refers_to").isNotNull())
    struct_ = T.StructType.fromDDL(INDEX)
    target = common.to_arrow(struct_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                writer = writer or BundleWriter(folder)
                data = record(
                    row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], row["revisit"], date
                )
                frame, offset = writer.add(data)
                rows.append((row["page_id"], writer.uri, frame, offset, len(data)))
                if writer.bytes + writer.pending_bytes >= BUNDLE:
                    writer.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), target)], schema=target)
        if writer:
            writer.close()

    columns = marked.select("page_id", "url", "html", "refers_to", "revisit")
    return scratch.written(columns.mapInArrow(run, struct_), "warc-index")


READ = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, "
    "payload binary"
)


def read(index: DataFrame) -> DataFrame:
    """The records that rows of an index name, READ by column; revisits have a null payload.

    Rows are brought together by bundle and frame, and each frame is fetched and unpacked once.
    """
    struct_ = T.StructType.fromDDL(READ)
    target = common.to_arrow(struct_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, uri, frame, number = None, None, b"", None
        for batch in batches:
            rows = []
            for bundle, wanted, offset in zip(*[batch.column(c).to_pylist() for c in ("bundle", "frame", "offset")]):
                if bundle != uri:
                    if reader:
                        reader.close()
                    reader, uri, number = BundleReader(bundle), bundle, None
                if wanted != number:
                    frame, number = reader.frame(wanted), wanted
                rows.append(described(*parsed(frame, offset)[:2]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), target)], schema=target)
        if reader:
            reader.close()

    tasks = common.shuffle_tasks(index.sparkSession)
    near = index.repartition(tasks, "bundle", F.floor(F.col("frame") / 16)).sortWithinPartitions("bundle", "frame", "offset")
    return near.mapInArrow(run, struct_)


def described(headers: dict[str, str], block: bytes) -> tuple:
    """A record as a row of READ; the digest of a response is computed from what was read."""
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = headers["WARC-Type"] == "revisit"
    stated = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest = stated if revisit else hashlib.sha256(payload).hexdigest()
    if digest != stated or not revisit and len(payload) != size:
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    number = [int(headers[k]) if k in headers else None for k in ("X-Page-Id", "X-Refers-To-Page")]
    return (
        number[0], headers.get("WARC-Target-URI"), headers["WARC-Type"], size, digest, number[1],
        None if revisit else payload,
    )


def op4_warc_bundles(spark, sf_dir: str) -> DataFrame:
    index = write(common.table(spark, sf_dir, "pages"), scratch.new_path(spark, "warc"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
