"""Token-id shards with a minimal perfect hash index.

Texts are encoded, put in ascending key order over the whole corpus and written as shards: `<shard>.bin` holds raw
ids (16 bits wide where the vocabulary allows, else 32), `<shard>.idx` holds the keys' minimal perfect hash: a
displacement for each bucket of keys, and for each slot a fingerprint, the first document of the key and how many
there are. A lookup hashes the key, reads one slot, compares the fingerprint and has the payload's place: constant
time, no search. Each key has one slot; the fingerprint (32 bits) tells keys that were never stored.

The manifest keeps each shard's lowest and highest key. Shards are ranges of keys, so a key's range names the one shard
that may hold it (or the few over which a key with very many documents extends), and find() opens no other.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, keep, new_folder, prepare, read_whole, write_whole
from .tokens import encoder, vocabulary

MAGIC = b"TSIX0001"
#: A shard is closed when its payload reaches this many bytes.
SHARD_BYTES = 32 << 20
_NULL_KEY = np.uint64(0x9E3779B97F4A7C15)
_HEAD = struct.Struct("<8sIIQQQ")


def _mix(x: np.ndarray, seed) -> np.ndarray:
    """64-bit finaliser over keys, vectorised."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(seed, np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray, per_bucket: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key) of a minimal perfect hash over distinct unsigned 64-bit keys.

    Hash and displace: buckets, largest first, try seeds until all their keys fall on free slots; a bucket of one key
    stores its slot itself, as a negative number.
    """
    n = len(keys)
    buckets = max(1, -(-n // per_bucket))
    of = (_mix(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    ends = np.cumsum(sizes)
    shift = np.zeros(buckets, np.int32)
    slot = np.zeros(n, np.int64)
    free = np.ones(n, bool)
    single = []
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] == 0:
            break
        rows = order[ends[b] - sizes[b] : ends[b]]
        if sizes[b] == 1:
            single.append((b, rows[0]))
            continue
        tries = 1
        while True:
            seeds = np.arange(tries, tries + 64, dtype=np.uint64)
            at = (_mix(keys[rows][:, None], seeds[None, :]) % np.uint64(n)).astype(np.int64)
            good = free[at].all(0)
            good &= (np.diff(np.sort(at, 0), axis=0) > 0).all(0)
            if good.any():
                k = int(np.argmax(good))
                shift[b], slot[rows] = tries + k, at[:, k]
                free[at[:, k]] = False
                break
            tries += 64
    for (b, row), at in zip(single, np.flatnonzero(free)):
        shift[b], slot[row] = -at - 1, at
    return shift, slot


def find_slot(keys: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    d = shift[(_mix(keys, 0) % np.uint64(len(shift))).astype(np.int64)].astype(np.int64)
    hashed = (_mix(keys, np.maximum(d, 0).astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    return np.where(d < 0, -d - 1, hashed)


class Shard:
    """An index file, opened. Keys are longs or null."""

    def __init__(self, data: bytes):
        magic, self.width, buckets, self.n_keys, self.n_docs, self.n_tokens = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token index")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.shift, self.prints = take("<i4", buckets), take("<u4", self.n_keys)
        self.first, self.count = take("<u4", self.n_keys), take("<u4", self.n_keys)
        self.offsets = take("<u8", self.n_docs + 1)
        self.keys, self.is_null = take("<i8", self.n_docs), take("u1", self.n_docs).astype(bool)

    @staticmethod
    def hashed(keys: np.ndarray, is_null: np.ndarray) -> np.ndarray:
        return np.where(is_null, _NULL_KEY, keys.astype("<i8").view(np.uint64))

    def lookup(self, keys: np.ndarray, is_null: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key; number 0: not in this shard."""
        keys = np.asarray(keys, np.int64)
        if not self.n_keys:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        h = self.hashed(keys, np.zeros(len(keys), bool) if is_null is None else is_null)
        slot = find_slot(h, self.shift, self.n_keys)
        there = self.prints[slot] == (_mix(h, 7) >> np.uint64(32)).astype(np.uint32)
        return self.first[slot].astype(np.int64), np.where(there, self.count[slot], 0).astype(np.int64)


def index_bytes(keys: np.ndarray, is_null: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """keys: in file order, equal ones side by side."""
    h = Shard.hashed(keys, is_null)
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    distinct = h[starts]
    shift, slot = build_hash(distinct) if len(h) else (np.zeros(1, np.int32), np.zeros(0, np.int64))
    prints, first, count = (np.zeros(len(distinct), "<u4") for _ in range(3))
    prints[slot] = (_mix(distinct, 7) >> np.uint64(32)).astype(np.uint32)
    first[slot] = starts
    count[slot] = np.diff(np.r_[starts, len(h)])
    offsets = np.r_[0, np.cumsum(lengths)].astype("<u8")
    head = _HEAD.pack(MAGIC, width, len(shift), len(distinct), len(h), int(offsets[-1]))
    return b"".join([head, shift.astype("<i4").tobytes(), prints.tobytes(), first.tobytes(), count.tobytes(), offsets.tobytes(), keys.astype("<i8").tobytes(), is_null.astype("u1").tobytes()])


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write shards under folder; returns the manifest, materialised: partition, shard (within it), name, n_docs, n_tokens, low, high, nulls.

    low and high are the shard's lowest and highest key (null if it has none), nulls whether it holds null keys.

    Partitions are ranges of keys (null first), and of a hash of the texts where keys are equal, so (partition, shard)
    is key order and a key with very many rows is dealt to many shards. Only files that the manifest names count: a lost
    or repeated task leaves files of other names behind.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        enc, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        keys, nulls, lengths, payload, size = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal shard, size
            name = f"{part:06d}-{shard:06d}-{uuid.uuid4().hex}"
            write_whole(f"{folder}/{name}.bin", b"".join(payload))
            write_whole(f"{folder}/{name}.idx", index_bytes(np.array(keys, np.int64), np.array(nulls, bool), np.array(lengths, np.int64), width))
            out = pa.RecordBatch.from_pylist([{"partition": part, "shard": shard, "name": name, "n_docs": len(keys), "n_tokens": sum(lengths), **_range(keys, nulls)}], schema=_MANIFEST)
            for x in (keys, nulls, lengths, payload):
                x.clear()
            shard, size = shard + 1, 0
            return out

        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size >= shard_bytes:
                    yield close()
                ids = enc.encode(t or "")
                if width == 2:
                    ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                keys.append(k or 0)
                nulls.append(k is None)
                lengths.append(len(ids) // width + 1)
                payload += (ids, end)
                size += len(ids) + width
        if keys:
            yield close()

    return keep(rows.mapInArrow(run, "partition int, shard int, name string, n_docs long, n_tokens long, low long, high long, nulls boolean"), "token-manifest")


def _range(keys: list[int], nulls: list[bool]) -> dict:
    """The keys are in order, null ones first."""
    some = len(keys) - sum(nulls)
    return {"low": keys[-some] if some else None, "high": keys[-1] if some else None, "nulls": nulls[0]}


_MANIFEST = pa.schema([("partition", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("nulls", pa.bool_())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard_name", pa.string()), ("shard_offset", pa.int64())])


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each stored document, found through its shard's index and read from its payload.

    doc_id, start (ids before it in the corpus), n_tokens, ids_crc32 (over 32-bit ids), shard_name, shard_offset.
    """
    before = Window.orderBy("partition", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("name", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(read_whole(f"{folder}/{name}.idx"))
                payload = np.frombuffer(read_whole(f"{folder}/{name}.bin"), f"<u{shard.width}")
                first, count = shard.lookup(shard.keys, shard.is_null)
                nth = np.arange(shard.n_docs) - first
                if ((nth < 0) | (nth >= count)).any():
                    raise ValueError(f"{name}: a key does not lead to its documents")
                at = shard.offsets[first + nth].astype(np.int64)
                n = shard.offsets[first + nth + 1].astype(np.int64) - at
                crc = [zlib.crc32(payload[a : a + m].astype("<u4").tobytes()) for a, m in zip(at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, mask=shard.is_null), pa.array(base + at), pa.array(n), pa.array(crc, pa.int64()), pa.array([name] * shard.n_docs), pa.array(at)], schema=_READ)

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(parts, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard_name string, shard_offset long")


class OpenShard:
    """An index file that is read in place: the head, and of a key its bucket's displacement, its slot and two offsets."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.file = store.open_input_file(path)
        magic, self.width, self.buckets, self.n_keys, self.n_docs, _ = _HEAD.unpack(self._at(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token index")
        self.slots = _HEAD.size + 4 * self.buckets
        self.offsets = self.slots + 12 * self.n_keys

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def _number(self, kind: str, place: int, nth: int) -> int:
        kind = np.dtype(kind)
        return int(np.frombuffer(self._at(place + nth * kind.itemsize, kind.itemsize), kind)[0])

    def documents(self, key: int | None) -> list[tuple[int, int]]:
        """(place, length) in tokens of the key's documents; none if it was not stored."""
        if not self.n_keys:
            return []
        h = Shard.hashed(np.array([key or 0], np.int64), np.array([key is None]))
        bucket = int((_mix(h, 0) % np.uint64(self.buckets))[0])
        shift = self._number("<i4", _HEAD.size, bucket)
        slot = -shift - 1 if shift < 0 else int((_mix(h, np.array([shift], np.uint64)) % np.uint64(self.n_keys))[0])
        prints, first, count = (self._number("<u4", self.slots + 4 * self.n_keys * k, slot) for k in range(3))
        if prints != int((_mix(h, 7) >> np.uint64(32))[0]):
            return []
        ends = np.frombuffer(self._at(self.offsets + 8 * first, 8 * (count + 1)), "<u8").astype(np.int64)
        return list(zip(ends[:-1].tolist(), np.diff(ends).tolist()))


def find(manifest: DataFrame, folder: str, key: int | None) -> Iterator[np.ndarray]:
    """The ids of each document of a key, in the order of the corpus, the end id last; a null key is a key.

    The manifest's ranges lead to the shard, its index to the place in its payload: one index is opened and one slot
    read, and as much payload as the documents have. A key that was not stored opens one index at most.
    """
    here = F.col("nulls") if key is None else F.lit(key).between(F.col("low"), F.col("high"))
    for r in manifest.where(here).orderBy("partition", "shard").select("name").toLocalIterator():  # more than one shard only for a key that fills them
        shard = OpenShard(f"{folder}/{r.name}.idx")
        found = shard.documents(key)
        if not found:
            continue
        store, path = filesystem(f"{folder}/{r.name}.bin")
        with store.open_input_file(path) as payload:
            for at, n in found:
                payload.seek(at * shard.width)
                yield np.frombuffer(payload.read(n * shard.width), f"<u{shard.width}")


def token_index(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write, index and read back every document of docs.

    Null or empty text: the end id alone. Null keys: stored first, under a key of their own. Repeated keys: side by
    side, by a hash of their texts and then by text; in each shard that has some, one slot leads to all of them. Very
    long texts: whole; a shard takes one in full and is closed after it. Empty table: no shard, no rows. Columns other
    than the id and the text are not read.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or new_folder(spark, "token-shards")
    manifest = write_shards(docs, folder, vocabulary_path or vocabulary("byte_bpe_50k.json"), end_id, id_col, text_col)
    return read_shards(manifest, folder)
