"""WARC archives as seekable Zstandard bundles.

Method: a task writes the records of its rows to one bundle: about FRAME_BYTES of records make an independent Zstandard
frame; the file ends with a skippable frame that holds the seek table (compressed and plain size of every frame, the public
seekable format). An index maps every record to (bundle, frame, offset in the plain frame), so that one record is read by
decompressing one frame. Equal payloads of at least least_bytes are stored once; the other records are revisits.
Archives are read by the index: its frames are dealt to as many tasks as there are bundles, each reads its frames where
they lie, holds them against the bundle's seek table, and takes the records at their offsets.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.textarrays import bounded, released, small_batches
from tessella.plans.shared import fresh_path, materialize

FRAME_BYTES = 1 << 20
#: A bundle's plain bytes; a task that has more writes several.
BUNDLE_BYTES = 64 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

#: The index, after page_id (a long, or a string if the pages' is one).
INDEX = "bundle string, frame int, frame_at long, frame_size long, record_at long, record_size long"


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, refers_to: int | str | None) -> bytes:
    """A WARC/1.1 record of a page: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    block = b"" if refers_to is not None else payload
    line = lambda x: "" if x is None else str(x).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", *([] if page_id is None else [f"X-Page-ID: {line(page_id)}"]), f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{refers_to}')}>", f"X-Refers-To-Page: {line(refers_to)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(plain: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record begins) of the record at a place."""
    end = plain.index(b"\r\n\r\n", at)
    lines = plain[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["Content-Length"])
    block = plain[end + 4 : end + 4 + size]
    if len(block) != size or plain[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut short")
    return headers, block, end + 8 + size


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, plain) sizes."""
    body = b"".join(struct.pack("<II", c, p) for c, p in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame of an open bundle."""
    f.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    if size < 17 + 8 * count:
        raise ValueError("seek table doesn't match the file")
    f.seek(size - 17 - 8 * count)
    if struct.unpack("<II", f.read(8)) != (SKIPPABLE, 8 * count + 9):
        raise ValueError("no seek table")
    out, at = [], 0
    for c, p in struct.iter_unpack("<II", f.read(8 * count)):
        out.append((at, c, p))
        at += c
    if at + 8 + 8 * count + 9 != size:
        raise ValueError("seek table doesn't match the file")
    return out


class Bundle:
    """Writes one file. The name is new for every attempt of a task; only the index tells which files count."""

    def __init__(self, folder: str, id_type: pa.DataType) -> None:
        self.id_type = id_type
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.store, path = fs.FileSystem.from_uri(self.uri)
        self.out = self.store.open_output_stream(path, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.rows: list[tuple] = []
        self.pending: list[tuple[int | str | None, int, int]] = []
        self.size = self.at = self.plain = 0
        self.press = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, page_id: int | str | None, data: bytes) -> None:
        self.pending.append((page_id, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.cut()

    def cut(self) -> None:
        if not self.held:
            return
        frame = self.press.compress(b"".join(self.held))
        self.out.write(frame)
        self.rows += [(p, self.uri, len(self.frames), self.at, len(frame), at, n) for p, at, n in self.pending]
        self.frames.append((len(frame), self.size))
        self.at += len(frame)
        self.plain += self.size
        self.held, self.pending, self.size = [], [], 0

    def close(self) -> pa.RecordBatch:
        self.cut()
        self.out.write(seek_table(self.frames))
        self.out.close()
        names = ["page_id", "bundle", "frame", "frame_at", "frame_size", "record_at", "record_size"]
        types = [self.id_type, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*self.rows, strict=True), types, strict=True)], names)


@released()
def _write(batches: Iterator[pa.RecordBatch], folder: str, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    bundle = None
    for batch in small_batches(batches, "html"):
        for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
            bundle = bundle or Bundle(folder, id_type)
            bundle.add(page, record(page, url, (html or "").encode(), digest, refers))
            if bundle.plain >= BUNDLE_BYTES:
                yield bundle.close()
                bundle = None
    if bundle:
        yield bundle.close()


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 100) -> DataFrame:
    """Writes pages(page_id, url, html, ...) to bundles in a folder that the cluster shares; returns the index.

    Of rows with equal html of at least least_bytes bytes, the smallest page_id (of equal ones all) is a response and
    the others are revisits of it. Null html is empty. Rows with a null page_id are written; among equal payloads they
    are revisits if any row has an id, else responses. Repeated rows make repeated records. Ids are strings or whole numbers
    (what casts to long); "smallest" is by their own order. Other columns are ignored; an empty table writes nothing.
    """
    spark = bounded(pages).sparkSession
    kind = "string" if pages.schema["page_id"].dataType.simpleString() == "string" else "long"
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast(kind).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # Which digests recur is a small table; the pages themselves are dealt once, by the join, which splits skewed keys.
    first = materialize(rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "digests")
    rows = rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return materialize(rows.mapInArrow(partial(_write, folder=folder, id_type=pa.string() if kind == "string" else pa.int64()), f"page_id {kind}, {INDEX}"), "index")


def unline(text: str | None, id_type: pa.DataType) -> int | str | None:
    """An id back from its header."""
    if text is None:
        return None
    return unquote(text) if pa.types.is_string(id_type) else int(text)


@released()
def _read(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Frames (bundle, frame, frame_at, frame_size, records) to the rows of their records."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [id_type, pa.int64(), pa.string(), pa.string(), id_type]
    unpack, held, f, table = zstandard.ZstdDecompressor(), None, None, []
    try:
        for batch in batches:
            for row in batch.to_pylist():
                uri = row["bundle"]
                if uri != held:
                    if f:
                        f.close()
                    store, path = fs.FileSystem.from_uri(uri)
                    f, held = store.open_input_file(path), uri
                    table = read_seek_table(f, f.size())
                if row["frame"] >= len(table) or table[row["frame"]][:2] != (row["frame_at"], row["frame_size"]):
                    raise ValueError(f"frame {row['frame']} of {uri} isn't where the index has it")
                f.seek(row["frame_at"])
                try:
                    plain = unpack.decompress(f.read(row["frame_size"]), max_output_size=table[row["frame"]][2])
                except zstandard.ZstdError as e:
                    raise ValueError(f"frame {row['frame']} of {uri} is damaged") from e
                out = []
                for at in row["records"]:
                    head, block, end = parse(plain, at["record_at"])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    page = unline(head.get("X-Page-ID"), id_type)
                    if page != at["page_id"] or end - at["record_at"] != at["record_size"]:
                        raise ValueError(f"the record at {at['record_at']} of frame {row['frame']} in {uri} isn't that of the index")
                    if head["WARC-Type"] == "response" and (sha256(block).hexdigest() != digest or len(block) != int(head["X-Payload-Length"])):
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} in {uri} is damaged")
                    out.append((page, int(head["X-Payload-Length"]), digest, head["WARC-Type"], unline(head.get("X-Refers-To-Page"), id_type)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
    finally:
        if f:
            f.close()


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the index.

    Payloads are read back from the bundles, a task for each bundle (64 MB of records), and checked against index, seek table and digests;
    what doesn't agree is an error. An empty index gives an empty result.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    where = F.struct("record_at", "record_size", "page_id")
    frames = index.groupBy("bundle", "frame", "frame_at", "frame_size").agg(F.sort_array(F.collect_list(where)).alias("records"))
    bundles = index.agg(F.count_distinct("bundle").alias("n")).first()["n"]
    frames = frames.repartitionByRange(max(1, bundles), "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return frames.mapInArrow(partial(_read, id_type=pa.string() if kind == "string" else pa.int64()), f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")


def read_record(where: dict) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, by its row of the index: one seek, one frame."""
    store, path = fs.FileSystem.from_uri(where["bundle"])
    with store.open_input_file(path) as f:
        f.seek(where["frame_at"])
        plain = zstandard.ZstdDecompressor().decompress(f.read(where["frame_size"]))
    head, block, _ = parse(plain, where["record_at"])
    return head, block


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
