"""Language-model scoring with a log-frequency Bloom filter of word n-grams.

The model predicts a word, or a text's end, from the two words before it. All n-grams of orders one to three of the
training texts are counted; a count is quantised to a level, one more than its logarithm to the base 1.5 rounded down,
and an n-gram of level q is stored as q entries of a Bloom filter. A count is read by probing entry after entry until
one is missing. Probabilities are discounted and interpolated, order by order:
  p_k = max(count(n-gram) - D_k, 0) / count(context) + D_k * t_k(q) * p_(k-1),
where D_k = n_1 / (n_1 + 2 n_2) from the numbers of n-grams that occur once and twice, and t_k(q) is the number of
different n-grams for each training token over all contexts of level q, so that freed mass needs no further counts in
the filter. p_0 is uniform over the training vocabulary and one unknown word.

How it runs. A task turns its texts into blocks: numbers of words in a list of the block's distinct words, so words are
hashed once a block and no later pass touches a string. Blocks send their sorted, distinct n-gram keys with counts to
the shards that the keys' leading bits name; a shard adds up, and writes its piece of the filter and its words' exact
counts. Pieces are gathered into parts of bounded size. While parts are few, each is given to the workers whole: they
read it from the shared folder and probe it for their blocks' n-grams, then the next part. Where they are many, blocks
send their distinct keys to the parts that hold them, which are read once and send the levels back. Both ways give the
same levels. Nothing passes through the driver but a row for each shard. Levels of the n-grams at hand are kept for each block, so that the discounts, which depend on all
training tokens, are known before probabilities are formed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, keep, new_folder, prepare, read_whole, remove, write_whole

ORDER = 3
#: Words in a block; a text is never divided, so the last one of a block may go beyond.
BLOCK_WORDS = 2_000_000
#: N-grams that are dealt to a shard or so, each counted once for each block that has it.
SHARD_GRAMS = 2_000_000
#: Bytes that a worker holds of the filter, or of the words' counts, at a time.
PART_BYTES = 128 << 20
#: Parts up to which every worker reads all of them; beyond, n-grams go to the parts. Costs differ, levels do not.
WHOLE_PARTS = 8
#: Bits of the filter for each entry, and bits that an entry sets, all in one 64-bit word of the filter.
ENTRY_BITS, PROBES = 12, 4
#: Counts are stored as level 1 + floor(log(count) / log(LOG_BASE)); LEVELS covers counts up to 10^12.
LOG_BASE, LEVELS = 1.5, 70
#: An n-gram's key has so many bits more than the number of n-grams: two share a key once in 2^SPARE_BITS.
SPARE_BITS = 12
#: Blocks that a task holds while it reads part after part.
HELD_BLOCKS = 4
_PROBED = 1 << 18
_BEGIN, _END = xxhash.xxh3_64_intdigest(b""), xxhash.xxh3_64_intdigest(b" ")  # no word has these bytes


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, a new array."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def level(count: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(LOG_BASE) + 1e-9)).astype(np.uint8)


def level_values() -> np.ndarray:
    """The count that each level stands for: the middle of the whole numbers that have it; 0 for level 0."""
    edge = np.ceil(LOG_BASE ** np.arange(LEVELS + 1) - 1e-6)
    return np.r_[0.0, (edge[:-1] + edge[1:] - 1) / 2]


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers of one width, byte by byte: the high bytes of small numbers cost nothing."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


# --- blocks of word numbers

_BLOCKS = pa.schema([("block", pa.string()), ("ids", pa.binary()), ("lengths", pa.binary()), ("numbers", pa.binary()), ("words", pa.binary()), ("tokens", pa.int64()), ("texts", pa.int64())])
_BLOCK_SQL = "block string, ids binary, lengths binary, numbers binary, words binary, tokens long, texts long"


def blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs: doc_id, held_out, text. A row for each block.

    ids holds (is null, id, held out) of each text, numbers its words' places in words, words the hashes of distinct
    words; tokens and texts count what is learnt from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[tuple] = []
        lengths: list[int] = []
        numbers: list[np.ndarray] = []
        place: dict[bytes, int] = {}
        size = tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal size, tokens
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, len(place))
            at = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
            texts = sum(not h for _, _, h in ids)
            row = [uuid.uuid4().hex, np.array(ids, np.int64).tobytes(), np.array(lengths, np.int64).tobytes(), _packed(at), hashes.tobytes(), tokens + texts, texts]
            for x in (ids, lengths, numbers, place):
                x.clear()
            size = tokens = 0
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            for k, h, t in zip(*(c.to_pylist() for c in batch.columns)):
                w = (t or "").encode().lower().split()
                ids.append((k is None, k or 0, h))
                lengths.append(len(w))
                numbers.append(np.fromiter((place.setdefault(x, len(place)) for x in w), np.uint32, len(w)))
                size += len(w) + 1
                tokens += 0 if h else len(w)
                if size >= block_words:
                    yield close()
        if ids:
            yield close()

    return keep(docs.mapInArrow(run, _BLOCK_SQL), "blocks")


class Block:
    """A block's texts as word numbers, and the n-grams that end at each token. A text of n words has n + 1 tokens."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64).reshape(-1, 3)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.numbers = _unpacked(row["numbers"], np.uint32)
        tokens = self.lengths + 1
        self.ends = np.cumsum(tokens) - 1  # the place of each text's end among the block's tokens
        self.starts = self.ends - self.lengths
        self.learn = np.repeat(self.ids[:, 2] == 0, tokens)

    def by_token(self, each: np.ndarray, end) -> np.ndarray:
        """A word's value at each of its tokens, and the end's value at texts' ends."""
        out = np.empty(len(self.learn), each.dtype)
        inside = np.ones(len(out), bool)
        inside[self.ends] = False
        out[inside], out[self.ends] = each[self.numbers], end
        return out

    def before(self, each: np.ndarray, first) -> np.ndarray:
        """The value at the token before each token, and first at the start of each text."""
        out = np.empty_like(each)
        out[1:] = each[:-1]
        out[self.starts] = first
        return out

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pair and of the triple of words that end at each token; two begins stand before each text."""
        with np.errstate(over="ignore"):
            one = self.by_token(self.words, np.uint64(_END))
            two = _mix(self.before(one, np.uint64(_BEGIN)) * np.uint64(0x9E3779B97F4A7C15) + one)
            first = _mix(np.array([_BEGIN], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_BEGIN))[0]
            return two, _mix(self.before(two, first) * np.uint64(0xD6E8FEB86659FD93) + one)


# --- the filter


class Layout:
    """How keys of `bits` bits are dealt to shards, in order."""

    def __init__(self, tokens: int, shard_grams: int = SHARD_GRAMS):
        self.bits = min(60, max(32, (ORDER * tokens).bit_length() + SPARE_BITS))
        self.shards = max(1, -(-ORDER * tokens // shard_grams))

    def keys(self, hashes: np.ndarray, order: int) -> np.ndarray:
        """Keys of n-grams of one order, 64 bits; the leading `bits` of them are what the filter knows."""
        with np.errstate(over="ignore"):
            return _mix(hashes + np.uint64(order) * np.uint64(0xA24BAED4963EE407))

    def short(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.bits)

    def shard(self, short: np.ndarray) -> np.ndarray:
        return (((short >> np.uint64(self.bits - 32)) * np.uint64(self.shards)) >> np.uint64(32)).astype(np.int64)


def _entry(short: np.ndarray, q: int) -> np.ndarray:
    """The bits of entry (key, level q) within its word of the filter."""
    with np.errstate(over="ignore"):
        h = _mix(short * np.uint64(0x9FB21C651E98DF25) + np.uint64(q) * np.uint64(0xC2B2AE3D27D4EB4F))
    mask = np.zeros(len(h), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return mask


def _place(short: np.ndarray, q: int, words: np.ndarray) -> np.ndarray:
    """The word of entry (key, level q): levels of a key lie side by side."""
    with np.errstate(over="ignore"):
        first = ((_mix(short + np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(32)) * words) >> np.uint64(32)
    return ((first + np.uint64(q - 1)) % words).astype(np.int64)


def filter_words(short: np.ndarray, levels: np.ndarray, entry_bits: int = ENTRY_BITS) -> np.ndarray:
    """The filter of distinct keys with their levels: 64-bit words."""
    words = np.zeros(max(1, -(-int(levels.sum(dtype=np.int64)) * entry_bits // 64)), np.uint64)
    size = np.uint64(len(words))
    for q in range(1, int(levels.max(initial=0)) + 1):
        own = short[levels >= q]
        np.bitwise_or.at(words, _place(own, q, size), _entry(own, q))
    return words


class Part:
    """Some shards' pieces of the filter, to be probed."""

    def __init__(self, layout: Layout, pieces: Iterable[tuple[int, np.ndarray]], total: int):
        """pieces: (shard, words), copied as they come, total words in all."""
        self.layout, self.words = layout, np.empty(total, np.uint64)
        self.size, self.offset = np.zeros(layout.shards, np.uint64), np.zeros(layout.shards, np.int64)
        at = 0
        for shard, words in pieces:
            self.size[shard], self.offset[shard] = len(words), at
            self.words[at : at + len(words)] = words
            at += len(words)

    def fill(self, hashes: np.ndarray, order: int, out: np.ndarray) -> None:
        """Write the levels of those n-grams that this part has room for into out: by repeated probes, 0 if the first misses.

        A piece at a time, so that what probing needs stays small beside the filter.
        """
        for i in range(0, len(hashes), _PROBED):
            self._fill(self.layout.short(self.layout.keys(hashes[i : i + _PROBED], order)), out[i : i + _PROBED])

    def levels(self, short: np.ndarray) -> np.ndarray:
        """The levels of n-grams by their keys' leading bits."""
        out = np.zeros(len(short), np.uint8)
        for i in range(0, len(short), _PROBED):
            self._fill(short[i : i + _PROBED], out[i : i + _PROBED])
        return out

    def _fill(self, short: np.ndarray, out: np.ndarray) -> None:
        shard = self.layout.shard(short)
        alive = np.flatnonzero(self.size[shard] > 0)
        if not len(alive):
            return
        key, size, offset = short[alive], self.size[shard[alive]], self.offset[shard[alive]]
        for q in range(1, LEVELS + 1):
            mask = _entry(key, q)
            there = (self.words[offset + _place(key, q, size)] & mask) == mask
            alive, key, size, offset = alive[there], key[there], size[there], offset[there]
            if not len(alive):
                break
            out[alive] = q


_DEALT = pa.schema([("shard", pa.int64()), ("ord", pa.int8()), ("keys", pa.binary()), ("counts", pa.binary())])


def dealt(table: DataFrame, layout: Layout) -> DataFrame:
    """(shard, ord, keys, counts) of the training texts' n-grams: for each block its sorted distinct keys, and how often each occurs there.

    The pair of begins before each training text counts too: it is a context.
    """
    step = 64 - layout.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                grams = [b.by_token(b.words, np.uint64(_END)), *b.grams()]
                for order in range(1, ORDER + 1):
                    keys = layout.keys(grams.pop(0)[b.learn], order)
                    if order > 1:
                        keys >>= np.uint64(step)
                    keys.sort()
                    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
                    counts = np.diff(np.r_[first, len(keys)]).astype(np.uint32)
                    keys = keys[first]
                    shard = layout.shard(layout.short(keys) if order == 1 else keys)
                    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
                    rows = []
                    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                        part = keys[a:z]
                        rows.append((int(shard[a]), order, _packed(np.r_[part[:1], part[1:] - part[:-1]]), _packed(counts[a:z])))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DEALT)], schema=_DEALT)

    return table.mapInArrow(run, "shard long, ord byte, keys binary, counts binary")


_PIECES_SQL = "shard long, filter string, filter_bytes long, vocabulary string, kinds long, entries long"


def pieces(rows: DataFrame, layout: Layout, folder: str, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """A row for each shard that has n-grams: the files of its piece of the filter and of its words' exact counts."""
    step = 64 - layout.bits

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shorts, levels, known, entries = [], [], None, 0
        for order in range(1, ORDER + 1):
            own = pdf[pdf["ord"] == order]
            if not len(own):
                continue
            keys = np.concatenate([np.cumsum(_unpacked(k, np.uint64), dtype=np.uint64) for k in own["keys"]])
            counts = np.concatenate([_unpacked(c, np.uint32) for c in own["counts"]]).astype(np.int64)
            at = np.argsort(keys, kind="stable")
            keys, counts = keys[at], counts[at]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, counts = keys[first], np.add.reduceat(counts, first)
            if order == 1:
                known = (keys, counts)
                keys, counts = keys >> np.uint64(step), counts
            shorts.append(keys)
            levels.append(level(counts))
        short, q = np.concatenate(shorts), np.concatenate(levels)
        words = filter_words(short, q, entry_bits)
        entries = int(q.sum(dtype=np.int64))
        name, vocabulary, kinds = f"{folder}/{uuid.uuid4().hex}", "", 0
        write_whole(f"{name}.filter", words.tobytes())
        if known is not None:
            vocabulary, kinds = f"{name}.words", len(known[0])
            write_whole(vocabulary, known[0].tobytes() + known[1].tobytes())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [f"{name}.filter"], "filter_bytes": [words.nbytes], "vocabulary": [vocabulary], "kinds": [kinds], "entries": [entries]})

    return keep(rows.repartition(layout.shards, "shard").groupBy("shard").applyInPandas(run, _PIECES_SQL), "lm-pieces")


class Model:
    """Where the filter's pieces and the words' counts are, in groups that a worker holds at a time."""

    def __init__(self, table: DataFrame, shard_grams: int = SHARD_GRAMS, part_bytes: int = PART_BYTES, entry_bits: int = ENTRY_BITS):
        tokens, texts = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
        self.tokens, self.texts = int(tokens), int(texts)
        self.layout = Layout(self.tokens, shard_grams)
        self.folder = new_folder(table.sparkSession, "lm-pieces")
        found = [r.asDict() for r in pieces(dealt(table, self.layout), self.layout, self.folder, entry_bits).toLocalIterator()]  # a row for each shard
        self.kinds = sum(r["kinds"] for r in found)
        self.entries, self.bytes = sum(r["entries"] for r in found), sum(r["filter_bytes"] for r in found)
        found.sort(key=lambda r: r["shard"])
        self.parts = _grouped([(r["shard"], r["filter"], r["filter_bytes"]) for r in found], part_bytes)
        self.vocabulary = _grouped([(r["shard"], r["vocabulary"], 16 * r["kinds"]) for r in found if r["kinds"]], part_bytes)

    def figures(self) -> Callable[..., tuple[bytes, ...]]:
        """A function that gives a row of levels() from a block's row, its words' exact counts and its n-grams' levels."""
        total, kinds, texts = self.tokens, self.kinds, self.texts

        def of(row: dict, known: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[bytes, ...]:
            b = Block(row)
            base = np.log10((np.append(known, texts) + 1) / (total + kinds + 1))
            seen = np.add.reduceat(b.by_token((known > 0).astype(np.int64), texts > 0), b.starts)
            sums = np.add.reduceat(b.by_token(base[:-1], base[-1]), b.starts)
            return row["ids"], row["lengths"], seen.tobytes(), sums.tobytes(), _packed(b.by_token(one[:-1], one[-1])), _packed(two), _packed(three)

        return of


_Files = tuple[tuple[int, str, int], ...]


def _grouped(files: list[tuple[int, str, int]], most: int) -> list[_Files]:
    """(shard, file, bytes) in groups of at most so many bytes, or of one file."""
    out: list[_Files] = []
    room = 0
    for f in files:
        if f[2] > room or not out:
            out.append(())
            room = most
        out[-1] += (f,)
        room -= f[2]
    return out


#: What this worker has read last: one group of files at a time.
_READ: dict[_Files, object] = {}


def _part(layout: Layout, files: _Files) -> Part:
    if files not in _READ:
        _READ.clear()
        _READ[files] = Part(layout, ((s, np.frombuffer(read_whole(p), np.uint64)) for s, p, _ in files), sum(n for _, _, n in files) // 8)
    return _READ[files]


def _words(files: _Files) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of some shards' words: shards come in the order of their keys, so all are sorted."""
    if files not in _READ:
        _READ.clear()
        total = sum(n for _, _, n in files) // 16
        keys, counts, at = np.empty(total, np.uint64), np.empty(total, np.int64), 0
        for _, path, n in files:
            both = np.frombuffer(read_whole(path), np.uint64)
            keys[at : at + n // 16], counts[at : at + n // 16] = both[: n // 16], both[n // 16 :]
            at += n // 16
        _READ[files] = keys, counts
    return _READ[files]


# --- levels, discounts and scores

_LEVELS = pa.schema([("ids", pa.binary()), ("lengths", pa.binary()), ("known", pa.binary()), ("base", pa.binary()), ("one", pa.binary()), ("two", pa.binary()), ("three", pa.binary())])
_LEVELS_SQL = "ids binary, lengths binary, known binary, base binary, one binary, two binary, three binary"


def levels(table: DataFrame, model: Model) -> DataFrame:
    """For each block: each text's known tokens and base score, by exact counts, and the levels of each token's n-grams."""
    layout, parts, vocabulary, figures = model.layout, model.parts, model.vocabulary, model.figures()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(r["words"]) // 8, np.int64) for r in held]
            for files in vocabulary:
                keys, c = _words(files)
                for row, known in zip(held, counts):
                    own = layout.keys(np.frombuffer(row["words"], np.uint64), 1)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    hit = keys[at] == own
                    known[hit] = c[at[hit]]
            found = [(np.zeros(len(r["words"]) // 8 + 1, np.uint8), *np.zeros((2, int(np.frombuffer(r["lengths"], np.int64).sum()) + len(r["lengths"]) // 8), np.uint8)) for r in held]
            for files in parts:
                part = _part(layout, files)
                for row, (one, two, three) in zip(held, found):
                    b = Block(row)
                    part.fill(np.append(b.words, np.uint64(_END)), 1, one)
                    for order, hashes, to in zip((2, 3), b.grams(), (two, three)):
                        part.fill(hashes, order, to)
            for row, known, (one, two, three) in zip(held, counts, found):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in figures(row, known, one, two, three)], schema=_LEVELS)
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == HELD_BLOCKS:
                    yield from out()
        if held:
            yield from out()

    return keep(table.select("ids", "lengths", "numbers", "words").mapInArrow(run, _LEVELS_SQL), "lm-levels")


_COUNTS = 0  # what is asked for beside the levels of orders one to three: exact counts of words
_ASKED = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("block", pa.string()), ("keys", pa.binary())])
_FOUND = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("block", pa.string()), ("found", pa.binary())])


def _wanted(b: Block, layout: Layout, kind: int) -> np.ndarray:
    """The keys whose counts or levels a block needs: whole ones of its words, or leading bits of an order's n-grams."""
    if kind == _COUNTS:
        return layout.keys(b.words, 1)
    return layout.short(layout.keys(np.append(b.words, np.uint64(_END)) if kind == 1 else b.grams()[kind - 2], kind))


def levels_by_part(table: DataFrame, model: Model) -> DataFrame:
    """What levels() gives, by two shuffles: distinct keys of blocks go to the parts that hold them, levels come back.

    A part has a row for each block and order at most, and is read by one task, a row at a time; a frequent n-gram is
    asked for once by a block. Keys are hashes, so parts are asked for alike.
    """
    layout, parts, vocabulary, figures = model.layout, model.parts, model.vocabulary, model.figures()
    starts = {exact: np.array([files[0][0] for files in groups]) for exact, groups in ((True, vocabulary), (False, parts))}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                for kind in range(ORDER + 1):
                    keys = np.unique(_wanted(b, layout, kind))
                    if len(keys):
                        shard = layout.shard(layout.short(keys) if kind == _COUNTS else keys)
                        part = np.maximum(np.searchsorted(starts[kind == _COUNTS], shard, "right") - 1, 0)
                        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
                        rows = [(kind, int(part[a]), row["block"], _packed(np.r_[keys[a : a + 1], keys[a + 1 : z] - keys[a : z - 1]])) for a, z in zip(cuts, [*cuts[1:], len(keys)])]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.cumsum(_unpacked(row["keys"], np.uint64), dtype=np.uint64)
                if row["kind"] == _COUNTS:
                    have, counts = _words(vocabulary[row["part"]])
                    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                    found = np.where(have[at] == keys, counts[at], 0)
                else:
                    found = _part(layout, parts[row["part"]]).levels(keys)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row["kind"], row["part"], row["block"], _packed(found)), _FOUND)], schema=_FOUND)

    def back(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0].to_dict()
        b, out = Block(row), []
        for kind in range(ORDER + 1):
            keys = _wanted(b, layout, kind)
            own, width = right[right["kind"] == kind].sort_values("part"), np.int64 if kind == _COUNTS else np.uint8
            found = np.concatenate([_unpacked(x, width) for x in own["found"]]) if len(own) else np.zeros(0, width)
            out.append(found[np.unique(keys, return_inverse=True)[1]])
        return pd.DataFrame([figures(row, *out)], columns=_LEVELS.names)

    rows = table.select("block", "ids", "lengths", "numbers", "words")
    exact = F.col("kind") == _COUNTS  # a task holds words' counts or a part of the filter, one at a time
    asks = rows.mapInArrow(ask, "kind byte, part int, block string, keys binary").repartition(len(parts) + len(vocabulary), exact, "part").sortWithinPartitions(exact, "part")
    found = asks.mapInArrow(look, "kind byte, part int, block string, found binary")
    return keep(rows.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(back, _LEVELS_SQL), "lm-levels")


def _contexts(b: Block, one: np.ndarray, two: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the contexts of each token's pair and triple; texts begin with contexts that all texts share."""
    begin = level(np.array([texts]))[0] if texts else np.uint8(0)
    return b.before(one, begin), b.before(two, begin)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, Block, np.ndarray, np.ndarray, np.ndarray]]:
    for row in batch.to_pylist():
        yield row, Block(row | {"words": b"", "numbers": _packed(np.zeros(0, np.uint32))}), *(_unpacked(row[c], np.uint8) for c in ("one", "two", "three"))


_SEEN = pa.schema([("ord", pa.int8()), ("ctx", pa.int32()), ("lvl", pa.int32()), ("n", pa.int64())])


def discounts(table: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(D of each order, t of each order and context level). Order 1 has one context, of level 0.

    Both come from the numbers of training tokens by order, context level and level: an n-gram of count c has c of them.
    """
    texts = model.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((ORDER + 1, (LEVELS + 1) ** 2), np.int64)
        for batch in batches:
            for _, b, one, two, three in _rows(batch):
                after, beyond = _contexts(b, one, two, texts)
                for order, own, context in ((1, one, np.zeros_like(one)), (2, two, after), (3, three, beyond)):
                    n[order] += np.bincount(context[b.learn].astype(np.int64) * (LEVELS + 1) + own[b.learn], minlength=n.shape[1])
        order, both = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int8()), pa.array(both // (LEVELS + 1), pa.int32()), pa.array(both % (LEVELS + 1), pa.int32()), pa.array(n[order, both])], schema=_SEEN)

    seen = table.mapInArrow(run, "ord byte, ctx int, lvl int, n long").groupBy("ord", "ctx", "lvl").agg(F.sum("n").alias("n"))
    n = np.zeros((ORDER + 1, LEVELS + 1, LEVELS + 1))
    for order, ctx, lvl, k in seen.toLocalIterator():  # at most a row for each order, level and level
        n[order, ctx, lvl] = k
    return _estimates(n)


def _estimates(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    once, twice = n[:, :, 1].sum(1), n[:, :, 2].sum(1) / 2
    d = np.where((once > 0) & (twice > 0), once / np.maximum(once + 2 * twice, 1), 0.5)
    kinds = (n[:, :, 1:] / level_values()[1:]).sum(2)
    return d, np.where(n.sum(2) > 0, kinds / np.maximum(n.sum(2), 1), 1.0)


class Scorer:
    """log10 probability of tokens from the levels of their n-grams and contexts."""

    def __init__(self, tokens: int, kinds: int, d: np.ndarray, t: np.ndarray):
        value, p0 = level_values(), 1.0 / (kinds + 1)
        self.one = np.maximum(value - d[1], 0) / max(tokens, 1) + d[1] * kinds / max(tokens, 1) * p0 if tokens else np.ones(LEVELS + 1)
        self.free = d[:, None] * t
        with np.errstate(divide="ignore", invalid="ignore"):
            self.kept = [np.nan_to_num(np.maximum(np.minimum(value[:, None], value[None, :]) - x, 0) / value[None, :]) for x in d]

    def log10(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, after: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        p = self.one[one]
        for k, own, context in ((2, two, after), (3, three, beyond)):
            p = np.where(context > 0, self.kept[k][own, context] + self.free[k, context] * p, p)
        return np.log10(np.minimum(p, 1.0))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_OUT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, folds: int = 7, held: int = 2, block_words: int = BLOCK_WORDS, shard_grams: int = SHARD_GRAMS, part_bytes: int = PART_BYTES, entry_bits: int = ENTRY_BITS, whole_parts: int = WHOLE_PARTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Held out: rows whose crc32 of the id's decimal text leaves `held` modulo `folds`; null ids are not. Null or empty
    text: the end alone. Repeated rows teach and are scored again. No training text: N = V = 0, each token's base and
    score are log10(1) = 0. Very long texts: whole; a block takes one in full and is closed after it. Words are told
    apart by 64-bit hashes. Empty table: no rows. Columns other than doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    held_out = F.coalesce(F.pmod(crc32_text(F.col("doc_id")), F.lit(folds)) == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    table = blocks(rows, block_words)
    model = Model(table, shard_grams, part_bytes, entry_bits)
    found = (levels if len(model.parts) <= whole_parts else levels_by_part)(table, model)
    remove(docs.sparkSession, table, model.folder)  # all that is still to run reads levels alone
    scorer, tokens, texts = Scorer(model.tokens, model.kinds, *discounts(found, model)), model.tokens, model.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, b, one, two, three in _rows(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.ids[:, 1], mask=b.ids[:, 0].astype(bool)),
                        pa.array(b.ids[:, 2].astype(bool)),
                        pa.array(b.lengths + 1),
                        pa.array(np.frombuffer(row["known"], np.int64)),
                        pa.array(np.full(len(b.ids), tokens)),
                        pa.array(np.frombuffer(row["base"], np.float64)),
                        pa.array(np.add.reduceat(scorer.log10(one, two, three, *_contexts(b, one, two, texts)), b.starts)),
                    ],
                    schema=_OUT,
                )

    return found.mapInArrow(run, _OUT_SQL)
