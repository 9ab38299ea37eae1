"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding some whole records, then two skippable frames: a
record map (record identifier, frame, offset in the frame, length) and a seek table with each frame's compressed and
decompressed size. A reader takes the seek table from the end of the file, finds a record in the map and decompresses
only its frame; a plain Zstandard reader sees one WARC stream. Records whose payload another record has already are
revisits: they carry headers and no payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, new_folder, prepare, read_whole, small, write_whole

#: Frames are closed at this many bytes of records, bundles at this many compressed bytes.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 32 << 20
LEVEL = 3
#: Copies of the table of responses, so that a payload with very many records is dealt to many tasks.
SALT = 32
#: Fixed values of the format: skippable frames, seek table footer.
_MAP_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
#: The tables have no capture time; every record carries this date.
DATE = "1970-01-01T00:00:00Z"
_MAP = np.dtype([("id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u8")])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_uri(text: str) -> int | None:
    name = text[len("<urn:page:") : -1]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, response: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit states the length and digest of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else "WARC-Target-URI: " + url)
    head += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if not response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "stated_length": stated}


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.map: list[tuple[int, int, int, int, int]] = []
        self.open: list[bytes] = []
        self.at = self.size = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.map.append((page_id or 0, page_id is None, len(self.frames), self.at, len(data)))
        self.open.append(data)
        self.at += len(data)
        if self.at >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.at))
            self.size += len(frame)
            self.open, self.at = [], 0

    def finish(self) -> bytes:
        self._close()
        rows = self.compressor.compress(np.array(self.map, _MAP).tobytes())
        seek = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _FOOTER_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", _MAP_MAGIC, len(rows)), rows, struct.pack("<II", _SEEK_MAGIC, len(seek)), seek])


class BundleReader:
    def __init__(self, data: bytes):
        import zstandard

        n, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != _FOOTER_MAGIC:
            raise ValueError("no seek table")
        table = len(data) - 9 - 8 * n
        self.sizes = np.frombuffer(data, "<u4", 2 * n, table).reshape(-1, 2)
        self.starts = np.r_[0, np.cumsum(self.sizes[:, 0], dtype=np.int64)]
        at = int(self.starts[-1])
        magic, length = struct.unpack_from("<II", data, at)
        if magic != _MAP_MAGIC:
            raise ValueError("no record map")
        self.data, self.unpack = data, zstandard.ZstdDecompressor()
        self.map = np.frombuffer(self.unpack.decompress(data[at + 8 : at + 8 + length], max_output_size=_MAP.itemsize << 24), _MAP)
        self.last: tuple[int, bytes] = (-1, b"")
        self.rows: dict[int, int] | None = None

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.last = (k, self.unpack.decompress(self.data[self.starts[k] : self.starts[k + 1]], max_output_size=int(self.sizes[k, 1])))
        return self.last[1]

    def record(self, row: int) -> dict:
        m = self.map[row]
        at = int(m["offset"])
        return parse_record(self.frame(int(m["frame"]))[at : at + int(m["length"])])

    def find(self, page_id: int) -> dict | None:
        """The record of an identifier, the first if there are several: one look into the map, one frame decompressed."""
        if self.rows is None:
            some = np.flatnonzero(self.map["null"] == 0)
            self.rows = dict(zip(self.map["id"][some[::-1]].tolist(), some[::-1].tolist()))
        row = self.rows.get(page_id)
        return None if row is None else self.record(row)


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with response and refers_to: of equal payloads of at least least_bytes bytes, the record with the largest page_id is the response.

    Only digests are grouped; the table of payloads that occur twice is broadcast when its counted size allows it,
    else joined by digest with a salt, so that one payload's records go to many tasks.
    """
    spark = pages.sparkSession
    own = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    keyed = pages.select("page_id", "url", "html", own.alias("sha1"), F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"))
    twice = keyed.groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("last"), F.max("bytes").alias("b")).where(F.col("n") > 1).where(F.col("b") >= least_bytes)
    twice = keep(twice.select(F.col("sha1").alias("s"), "last"), "payloads")
    if small(twice, 64):
        joined = keyed.join(F.broadcast(twice), F.col("sha1") == F.col("s"), "left")
    else:
        salted = twice.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = keyed.withColumn("y", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(salted, (F.col("sha1") == F.col("s")) & (F.col("y") == F.col("z")), "left")
    return joined.select("page_id", "url", "html", (F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last"))).alias("response"), F.col("last").alias("refers_to"))


_FILES = pa.schema([("name", pa.string()), ("n_records", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int64()), ("frame_offset", pa.int64())])


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write every page's record; returns the files that count, materialised (files of lost tasks are never named)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        writer = BundleWriter()

        def close() -> pa.RecordBatch:
            nonlocal writer
            name, n = f"{uuid.uuid4().hex}.warc.zst", len(writer.map)
            write_whole(f"{folder}/{name}", writer.finish())
            writer = BundleWriter()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], schema=_FILES)

        for batch in batches:
            for page_id, url, html, response, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = (html or "").encode()
                writer.add(page_id, record(page_id, url, payload, digest(payload), response, refers_to))
                if writer.size >= bundle_bytes:
                    yield close()
        if writer.map:
            yield close()

    chosen = roles(pages.select(F.col("page_id").cast("long"), "url", "html"), least_bytes)
    return keep(chosen.mapInArrow(run, "name string, n_records long"), "warc-files")


def read_bundles(files: DataFrame, folder: str) -> DataFrame:
    """Every record, found through its bundle's map and parsed; a response's payload is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                bundle = BundleReader(read_whole(f"{folder}/{name}"))
                out = []
                for row in range(len(bundle.map)):
                    r = bundle.record(row)
                    stated, kind = r["WARC-Payload-Digest"].removeprefix("sha1:"), r["WARC-Type"]
                    if kind == "response" and (digest(r["payload"]) != stated or len(r["payload"]) != r["stated_length"]):
                        raise ValueError(f"{name}: record {row} is damaged")
                    out.append((_from_uri(r["WARC-Record-ID"]), r.get("WARC-Target-URI"), r["stated_length"], stated, kind, _from_uri(r["WARC-Refers-To"]) if kind == "revisit" else None, name, int(bundle.map["frame"][row]), int(bundle.map["offset"][row])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _READ)], schema=_READ)

    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("name").repartition(parts, "name").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame long, frame_offset long")


def archived(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages as WARC bundles and read the records back.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, frame_offset. Null html: an
    empty payload. Null url: no target header. Null page_id: named "none"; among equal payloads the largest page_id
    that is not null is the response, and if all are null each is a response. Repeated rows of the response's page_id
    are responses alike. Very long payloads: whole; a frame takes one in full and is closed after it. Empty table: no file, no rows. Other
    columns are not read.
    """
    spark = prepare(pages.sparkSession)
    folder = folder or new_folder(spark, "warc")
    return read_bundles(write_bundles(pages, folder, least_bytes), folder)
