"""Near-duplicate groups of SimHash fingerprints by anchor-point covering.

A fingerprint has two halves of 32 bits; two fingerprints at most three bits apart are at most one bit apart in one
of them. Each half is covered by the Hamming code of length 31: every word lies within one bit (the covering radius)
of exactly one codeword, its home anchor. A fingerprint is replicated to every anchor within two bits, the radius
plus the half's threshold of one: its home and, unless it is a codeword, fifteen others. So of two linked
fingerprints, one is found at the other's home anchor. Fingerprints that meet at an anchor are compared, and each
anchor returns a spanning forest of the links it found, never the pairs. The forests' union is contracted to
components by alternating star steps.

Equal fingerprints are one point, so copies cost nothing. An anchor's points are compared by a search that drops
what it has reached, so points that link cost little however many they are; a crowd of points that do not link is cut
first by the bytes of its other half, of which two linked fingerprints share at least one. Points with very many edges,
and fingerprints with very many rows, are joined apart from the rest, by a broadcast whose rows are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, prepare, remove, unused

BITS = 3
SHINGLE = 3
SEED = 42
#: Points of an anchor that are compared at once; more are cut by bytes of the other half.
CROWD = 2_000
#: Keys that may be joined by a broadcast because they have very many rows.
HOT_KEYS = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; a bit is set if it is in over half of the hashes."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hash_, seed = xxhash.xxh64_intdigest, SEED
    if len(w) <= shingle:
        return hash_(b" ".join(w), seed)
    parts = zip(*[w[i:] for i in range(shingle)])
    h = np.fromiter([hash_(b" ".join(p), seed) for p in parts], np.uint64, len(w) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def _covering() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of the Hamming code of length 31, the error patterns of weight at most two that have it.

    Position i (1 to 31) has syndrome i. Returns patterns[32, 16] and how many of each row count.
    """
    patterns, n = np.zeros((32, 16), np.uint32), np.zeros(32, np.int64)
    for s in range(32):
        found = [0] if s == 0 else [1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s and i != s]
        patterns[s, : len(found)] = found
        n[s] = len(found)
    return patterns, n


def _syndrome(word: np.ndarray) -> np.ndarray:
    out = np.zeros(len(word), np.uint32)
    for i in range(1, 32):
        out ^= ((word >> np.uint32(i - 1)) & np.uint32(1)) * np.uint32(i)
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, whether it is the home) of every replica; an anchor's low bit tells the half."""
    patterns, n = _covering()
    index, anchor, home = [], [], []
    for half in (0, 1):
        word = (fp >> np.uint64(32 * half)).astype(np.uint32) & np.uint32(0x7FFFFFFF)
        s = _syndrome(word)
        for j in range(16):
            has = np.flatnonzero(n[s] > j)
            index.append(has)
            anchor.append((word[has] ^ patterns[s[has], j]).astype(np.int64) << 1 | half)
            home.append(np.full(len(has), j == 0))
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _forest(points: np.ndarray, bits: int) -> list[tuple[int, int]]:
    left, out = np.sort(points), []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        k = 0
        while k < len(reached) and len(left):
            near = np.bitwise_count(left ^ reached[k]) <= bits
            if near.any():
                reached.extend(left[near])
                left = left[~near]
            k += 1
        root = min(reached)
        out += [(int(p), int(root)) for p in reached if p != root]
    return out


def link(points: np.ndarray, half: int = 0, bits: int = BITS, crowd: int = CROWD) -> list[tuple[int, int]]:
    """Edges (point, smaller point) that connect distinct points as links of at most `bits` differing bits do.

    Points of an anchor of `half`. A crowd is compared by the bytes of its other half: of two points at most three bits
    apart, one of the four bytes is equal.
    """
    if len(points) <= crowd:
        return _forest(points, bits)
    out: set[tuple[int, int]] = set()
    other = points >> np.uint64(32 * (1 - half))
    for byte in range(4):
        key = (other >> np.uint64(8 * byte)) & np.uint64(255)
        order = np.argsort(key, kind="stable")
        for part in np.split(points[order], np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                out.update(_forest(part, bits))
    return sorted(out)


def links(points: DataFrame, bits: int = BITS) -> DataFrame:
    """points: distinct fp. Edges (u, v), v < u as unsigned, that connect exactly the linked groups."""
    if bits > 3:
        raise ValueError("the covering finds links of at most three bits")
    replica = pa.schema([("anchor", pa.int64()), ("home", pa.bool_()), ("fp", pa.int64())])
    edge = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            i, a, h = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(h), pa.array(fp[i].view(np.int64))], schema=replica)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a group may go on in the next batch."""
        rest: list[tuple[np.ndarray, ...]] = []

        def groups(a: np.ndarray, h: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            sizes = np.diff(np.r_[starts, len(a)])
            homes = np.add.reduceat(h.astype(np.int64), starts)
            out = []
            for s, n in zip(starts[(sizes > 1) & (homes > 0)].tolist(), sizes[(sizes > 1) & (homes > 0)].tolist()):
                if n == 2:
                    x, y = int(f[s]), int(f[s + 1])
                    if (x ^ y).bit_count() <= bits:
                        out.append((max(x, y), min(x, y)))
                else:
                    out += link(f[s : s + n], int(a[s]) & 1, bits)
            uv = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(uv[:, 0].copy()), pa.array(uv[:, 1].copy())], schema=edge)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            rest.append((new[0], new[1], new[2].view(np.uint64)))
            if new[0][0] == new[0][-1] == rest[0][0][0]:  # still one anchor
                continue
            a, h, f = (np.concatenate(x) for x in zip(*rest))
            cut = int(np.searchsorted(a, a[-1]))
            if cut:
                yield groups(a[:cut], h[:cut], f[:cut])
            rest = [(a[cut:], h[cut:], f[cut:])]
        if rest:
            yield groups(*(np.concatenate(x) for x in zip(*rest)))

    parts = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = points.select("fp").mapInArrow(spread, "anchor long, home boolean, fp long").repartition(parts, "anchor").sortWithinPartitions("anchor")
    return at.mapInArrow(meet, "u long, v long").distinct()


def join_hot(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with table, which has each key once with the number of its rows in the column size; total: all rows.

    Keys with more than a HOT_KEYS-th of twice all rows, so fewer than HOT_KEYS of them, are broadcast; the rest are
    shuffled by key, and none of them is large.
    """
    most = max(64, 2 * total // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(size) > most).drop(size))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(F.col(size) <= most).drop(size), key))


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for each point that has an edge: root is one point of its component, the same for all of it.

    Alternating large-star and small-star steps until nothing changes; each round's edges and each step's smallest
    neighbours are written to the shared folder.
    """
    edges = keep(edges.select(F.col("u").alias("a"), F.col("v").alias("b")), "edges")
    state, count = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = join_hot(both, first, "a", "n", 2 * count).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = keep(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "down")
        least = keep(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = join_hot(down, least, "a", "n", count).select("b", "m").where("b <> m").unionByName(least.select(F.col("a").alias("b"), "m"))
        used = [edges, first, down, least]
        edges = keep(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        remove(edges.sparkSession, *used)
        count, digest = now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    Fingerprints at most `bits` bits apart link; component_id is the smallest id reachable. Null, empty and wordless
    texts have fingerprint zero and link like any other. Null ids: a row each, with the component's smallest id that is
    not null (null if there is none). Repeated rows share their fingerprint. Very long texts: whole. Empty table: no
    rows. Columns other than the id and the text are not read.
    """
    prepare(docs.sparkSession)
    fps = keep(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "points")
    roots = components(links(points, bits))
    rooted = keep(points.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    least = keep(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("points")), "least-ids")
    of = keep(join_hot(rooted.drop("least"), least, "root", "points", points.count()).select("fp", "n", "component_id"), "of")
    return join_hot(fps, of, "fp", "n", fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs with one row of each near-duplicate group, the one with the smallest doc_id; all columns.

    Rows are told apart by a row number, under a name that docs lacks, so ids may be null or repeated: the first by
    (doc_id, null last, row) stays. Null, empty and wordless texts are near-duplicates of each other. Empty table: no
    rows.
    """
    prepare(docs.sparkSession)
    row = unused("row_number", docs)
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col(row).alias("z"))
    ids = numbered.select(F.col(row).alias("r"), rank.alias("rank"))
    groups = near_duplicates(numbered, id_col=row, bits=bits, shingle=shingle)
    first = groups.join(ids, groups["doc_id"] == ids["r"]).groupBy("component_id").agg(F.min("rank").alias("r")).select(F.col("r.z").alias(row))
    return numbered.join(first, row, "left_semi").select(docs.columns)
