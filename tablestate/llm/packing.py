"""Best-fit packing of tokenised documents into sequences of fixed length, improved by exchanges between bins.

Pieces are dealt at random to groups of bounded size. Within a group, they are laid into bins as they come; then a
local search takes the emptiest bin and gives its pieces away: it moves a piece, exchanges one for one or two for one
with a fuller bin, always so that tokens flow to the fuller bin and the sum of squared fills rises. An index by length
and room finds the partner. Where no exchange helps any more, sideways exchanges with full bins, which leave the sum as
it is, change long pieces of underfull bins for shorter ones, and the search goes on until the lower bound is met or
eight rounds of them empty no bin. If it ends above the bound, it searches once more from best fit by decreasing
length, and the packing with fewer bins stays. Bins that stay underfull in their group meet those of other groups in
the next round, in fewer groups, until one group holds all that are left.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, prepare
from .tokens import encoder, vocabulary

SEQUENCE = 2048
#: Pieces in a group: what one task packs at a time.
GROUP = 16_384
#: Of each group's bins, the fullest are closed while their free room stays below this share of one sequence.
CLOSE = 1 / 64
#: Rounds of sideways exchanges that may empty no bin before the search ends.
PATIENCE = 8
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(docs: DataFrame, vocabulary_path: str, end_id: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece: the document's ids with the end id, cut every size ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary_path), end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(t or "") + end
                for p, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((k, p, p * size, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)] if out else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, _PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, into the fullest bin that still has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        room -= n
        by_room[room].append(b)
        rooms |= 1 << room
    return bins


def next_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: each item, as they come, into the last bin or else a new one."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = size
        bins[-1].append(i)
        room -= n
    return bins


class _Rooms:
    """Open bins by room: for each length (0: any bin) the bin with most room that holds an item of that length."""

    def __init__(self, size: int):
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
        self.reach = np.full(size, -1)  # the largest sum that an item of this length can be given up for
        self.age: dict[int, int] = {}
        self.upto: np.ndarray | None = None

    def put(self, k: int, held: set[int], room: int) -> None:
        for y in held:
            heapq.heappush(self.heaps[y], (-room, k, self.age.setdefault(k, 0)))
            self._top(y)

    def take(self, k: int, held: set[int]) -> None:
        self.age[k] = self.age.get(k, 0) + 1
        for y in held:
            self._top(y)

    def _top(self, y: int) -> None:
        heap = self.heaps[y]
        while heap and self.age[heap[0][1]] != heap[0][2]:
            heapq.heappop(heap)
        self.reach[y] = y - heap[0][0] if heap else -1
        self.upto = None

    def best(self, sums: np.ndarray) -> tuple[int, int, int] | None:
        """(place in sums, length that comes back, bin) of the exchange with the largest gain."""
        if self.upto is None:
            self.upto = np.maximum.accumulate(self.reach)
        back = np.searchsorted(self.upto, sums)  # the least length that can be given up for each sum
        gain = np.where(back < len(self.upto), sums - back, 0)
        i = int(gain.argmax())
        return (i, int(back[i]), self.heaps[back[i]][0][1]) if gain[i] > 0 else None


def _offers(items: list[int], lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(sum, items) of each item and pair of items, one for each choice of lengths."""
    of: dict[int, list[int]] = {}
    for i in items:
        of.setdefault(lengths[i], []).append(i)
    kinds = list(of)
    out: list[tuple[int, tuple[int, ...]]] = [(x, (of[x][0],)) for x in kinds]
    for at, x in enumerate(kinds):
        if len(of[x]) > 1:
            out.append((2 * x, (of[x][0], of[x][1])))
        out += [(x + z, (of[x][0], of[z][0])) for z in kinds[at + 1 :]]
    return out


def climb(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Empty bins by exchanges, emptiest first, until the lower bound is met or no exchange helps.

    A donor takes the exchange that fills another bin most: an item or two of its own for one item or none. Tokens
    move to a bin at least as full, so the sum of squared fills rises at each and the search ends by itself.
    """
    bins = [list(b) for b in bins]
    least = -(-sum(lengths) // size)
    fill = [sum(lengths[i] for i in b) for b in bins]
    count = len(bins)
    live, moved = [k for k in range(count) if fill[k] < size], True
    held = lambda k: {0, *(lengths[i] for i in bins[k])}
    while moved and count > least:
        moved, rooms = False, _Rooms(size)
        for k in live:
            rooms.put(k, held(k), size - fill[k])
        queue = [(fill[k], k) for k in live]
        heapq.heapify(queue)
        done, rest = set(), []
        while queue and count > least:
            f, donor = heapq.heappop(queue)
            if donor in done or f != fill[donor]:
                continue
            done.add(donor)
            rooms.take(donor, held(donor))
            while bins[donor]:
                offers = _offers(bins[donor], lengths)
                found = rooms.best(np.array([x for x, _ in offers]))
                if not found:
                    break
                i, back, k = found
                given, before = offers[i], held(k)
                out = [next(i for i in bins[k] if lengths[i] == back)] if back else []
                rooms.take(k, before)
                bins[k] = [i for i in bins[k] if i not in out] + list(given[1])
                bins[donor] = [i for i in bins[donor] if i not in given[1]] + out
                fill[k] += given[0] - back
                fill[donor] -= given[0] - back
                moved = True
                if fill[k] < size:
                    rooms.put(k, held(k), size - fill[k])
                    heapq.heappush(queue, (fill[k], k))
            if bins[donor]:
                rest.append(donor)
            else:
                count -= 1
        live = rest
    return [b for b in bins if b]


def loosen(bins: list[list[int]], lengths: list[int], size: int) -> int:
    """Change long pieces of underfull bins for shorter ones, in place; the number of exchanges. A bin takes part in one.

    An underfull bin gives a piece for two that are as long together, of a full bin, or a little shorter, of a bin at
    least as full that has room for the difference. Or it takes a piece or two that fill it from a full bin, which then
    stands in its place, if what stays there is shorter pieces by the sum of their squares.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    squares = [sum(lengths[i] ** 2 for i in b) for b in bins]
    givers: dict[int, list[int]] = {}
    for k, b in enumerate(bins):
        if fill[k] < size:
            for x in {lengths[i] for i in b}:
                givers.setdefault(x, []).append(k)
    rooms = {size - f for f in fill if f < size}
    known, pairs, fits = sorted(givers), {}, {}
    for k, b in enumerate(bins):
        for s, given in _offers(b, lengths):
            if len(given) == 2:
                at = bisect.bisect_right(known, s + size - fill[k]) - 1
                if at >= 0 and (known[at] > s or known[at] == s and fill[k] == size):
                    pairs.setdefault(known[at], []).append((known[at] - s, abs(lengths[given[0]] - lengths[given[1]]), k, given))
            if fill[k] == size and s in rooms and len(b) > len(given):
                fits.setdefault(s, []).append((squares[k] - sum(lengths[i] ** 2 for i in given), k, given))
    used: set[int] = set()
    for x in sorted(pairs, reverse=True):
        offers = sorted(pairs[x], reverse=True)  # the last: nothing lost, and the most even pair
        for k in givers[x]:
            while offers and offers[-1][2] in used:
                offers.pop()
            at = next((at for at in range(len(offers) - 1, -1, -1) if offers[at][2] not in used and offers[at][2] != k and fill[offers[at][2]] >= fill[k]), -1)
            if k in used or at < 0:
                continue
            *_, other, given = offers.pop(at)
            piece = next(i for i in bins[k] if lengths[i] == x)
            bins[k] = [i for i in bins[k] if i != piece] + list(given)
            bins[other] = [i for i in bins[other] if i not in given] + [piece]
            used |= {k, other}
    for room in sorted(fits, reverse=True):
        offers = sorted(fits[room], reverse=True)
        takers = [k for k in range(len(bins)) if size - fill[k] == room and k not in used]
        for k in sorted(takers, key=lambda k: -squares[k]):
            while offers and offers[-1][1] in used:
                offers.pop()
            if not offers or offers[-1][0] >= squares[k]:
                break
            _, other, given = offers.pop()
            bins[k] = bins[k] + list(given)
            bins[other] = [i for i in bins[other] if i not in given]
            used |= {k, other}
    return len(used) // 2


def improve(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Climb, loosen where that stalls, and climb again, until the lower bound is met or PATIENCE rounds empty no bin.

    The sum of squared fills never falls.
    """
    least, idle = -(-sum(lengths) // size), 0
    bins = climb(bins, lengths, size)
    while len(bins) > least and idle < PATIENCE and loosen(bins, lengths, size):
        before, bins = len(bins), climb(bins, lengths, size)
        idle = 0 if len(bins) < before else idle + 1
    return bins


def pack_group(lengths: list[int], size: int) -> list[list[int]]:
    """Bins by the local search from next fit, or from best fit where that comes to fewer; equal numbers: from next fit."""
    found = improve(next_fit(lengths, size), lengths, size)
    if len(found) > -(-sum(lengths) // size):
        other = improve(best_fit(lengths, size), lengths, size)
        found = other if len(other) < len(found) else found
    return found


def _round(pieces: DataFrame, groups: int, size: int, last: bool, slow: bool) -> DataFrame:
    """Pack (rid, length) in groups: rid, length, sequence_id, offset, open. slow: the fullest half closes at least."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", kind="stable")
        rid, n = pdf["rid"].to_numpy(), pdf["length"].tolist()
        bins = sorted(pack_group(n, size), key=lambda b: -sum(n[i] for i in b))
        out, free = [], 0
        for k, b in enumerate(bins):
            room = size - sum(n[i] for i in b)
            free += room
            still_open = not last and free > CLOSE * size and not (slow and 2 * k < len(bins))
            at, name = 0, int(rid[b].min())
            for i in b:
                out.append((rid[i], n[i], name, at, still_open))
                at += n[i]
        return pd.DataFrame(out, columns=["rid", "length", "sequence_id", "offset", "open"])

    dealt = pieces.select("rid", "length", F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("g"))
    return dealt.repartition(groups, "g").groupBy("g").applyInPandas(run, "rid long, length long, sequence_id long, offset long, open boolean")


def pack(pieces: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """pieces: any columns, with a unique long rid and a length of 1 to size. Adds sequence_id and offset.

    A sequence is named by the smallest rid in it. Pieces of the full size are sequences of their own.
    """
    left = pieces.where(F.col("length") < size).select("rid", "length")
    n, placed, slow = left.count(), [], False
    while n:
        groups = -(-n // group)
        done = keep(_round(left, groups, size, groups == 1, slow), "packing-round")
        placed.append(done.where(~F.col("open")).select("rid", "sequence_id", "offset"))
        if groups == 1:
            break
        left = done.where("open").select("rid", "length")
        before, n = n, left.count()
        slow = n > 0.9 * before  # few bins closed: the next round halves those left, so that one group comes to hold them
    whole = pieces.where(F.col("length") == size).withColumns({"sequence_id": F.col("rid"), "offset": F.lit(0).cast("long")})
    if not placed:
        return whole
    at = placed[0]
    for x in placed[1:]:
        at = at.unionByName(x)
    return whole.unionByName(pieces.where(F.col("length") < size).join(at, "rid"))


def packed_documents(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 0, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null or empty text: the end id alone, a piece of length 1. Null or repeated ids: packed like any other row, since
    pieces are told apart by a row number of their own; equal lengths are taken in the order of that number. Very long texts: cut into whole sequences and a rest. Empty
    table: no rows. Columns other than the id and the text are not read.
    """
    prepare(docs.sparkSession)
    pieces = cut(docs, vocabulary_path or vocabulary("word_bpe_49k.json"), end_id, size, id_col, text_col)
    pieces = keep(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
