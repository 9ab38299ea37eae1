"""Fill-in-the-middle by a piece table.

A text is an immutable buffer of UTF-8 bytes, the sentinels are another, and a document is a list of descriptors
(buffer, start, length). Cutting splits a descriptor, an arrangement permutes the pieces and puts sentinels before
them, the inverse permutation restores the text, and a hash reads the descriptors' bytes one after another; nothing is
copied before a text is asked for. Cuts fall between tokens `[A-Za-z]+|[^A-Za-z]`.

Everything about a document follows from its text, its id and the seed, so any task may be run again anywhere.

Defined results: a null text is an empty one, and an empty text is plain. A null id hashes as no digits. Repeated rows
give repeated rows. A text that holds a sentinel is plain, so what is arranged can always be taken apart. Long texts
are looked through in blocks. Further columns go through, names that clash included: new columns of the same name
take their place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The pieces' places in a form's output: pieces are prefix, middle, suffix.
FORMS = {"plain": (0,), "psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Documents in a hundred that are rearranged, and of those that begin with the suffix.
RATE, SPM_RATE = 90, 20
#: Bytes of a text that are looked at together.
BLOCK = 1 << 20

_SENTINELS = (PREFIX.encode(), MIDDLE.encode(), SUFFIX.encode())
_TEXT, _SENTINEL = 0, 1
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_POINT = (np.arange(256) & 0xC0) != 0x80  # a byte that begins a code point


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    length: int


class PieceTable:
    """A document over its text's buffer. Descriptors never change the buffers."""

    def __init__(self, text, pieces: list[Piece] | None = None):
        self.text = memoryview(text)
        self.sentinels = memoryview(b"".join(_SENTINELS))
        self.pieces = [Piece(_TEXT, 0, len(self.text))] if pieces is None else pieces

    def bytes_of(self, piece: Piece) -> memoryview:
        return (self.text, self.sentinels)[piece.buffer][piece.start : piece.start + piece.length]

    def cut(self, *places: int) -> PieceTable:
        """Split descriptors at ascending offsets of the document; a cut at an end leaves an empty piece."""
        out, rest, at = [], list(self.pieces), 0
        for place in places:
            while place > at + rest[0].length:
                at += rest[0].length
                out.append(rest.pop(0))
            p, left = rest[0], place - at
            out.append(Piece(p.buffer, p.start, left))
            rest[0] = Piece(p.buffer, p.start + left, p.length - left)
            at = place
        return PieceTable(self.text, out + rest)

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix in a form's order, each after its sentinel."""
        if form == "plain":
            return self
        out = []
        for i in FORMS[form]:
            start = sum(map(len, _SENTINELS[:i]))
            out += [Piece(_SENTINEL, start, len(_SENTINELS[i])), self.pieces[i]]
        return PieceTable(self.text, out)

    def restored(self, form: str) -> PieceTable:
        """The document whose arrangement this is, from the bytes of an output: sentinels cut away, order inverted."""
        if form == "plain":
            return self
        data, places, at = bytes(self.text), [], 0
        for i in FORMS[form]:
            at = data.index(_SENTINELS[i], at)
            places.append((at, at + len(_SENTINELS[i])))
            at += len(_SENTINELS[i])
        ends = [p[0] for p in places[1:]] + [len(data)]
        pieces = [Piece(_TEXT, begin, end - begin) for (_, begin), end in zip(places, ends, strict=True)]
        return PieceTable(self.text, [pieces[i] for i in np.argsort(FORMS[form])])

    def sha256(self) -> str:
        h = hashlib.sha256()
        for piece in self.pieces:
            h.update(self.bytes_of(piece))
        return h.hexdigest()

    def render(self) -> bytes:
        return b"".join(map(self.bytes_of, self.pieces))


def _token_starts(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, whether a token begins at each byte) of blocks of a text's UTF-8 bytes."""
    before = False
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        letter = _LETTER[block]
        follows = np.empty_like(letter)
        follows[0], follows[1:] = before, letter[:-1]
        yield at, _POINT[block] & ~(letter & follows)
        before = bool(letter[-1])


def count_tokens(data: np.ndarray) -> tuple[int, list[int]]:
    """Tokens of a text, in all and in each block."""
    counts = [int(np.count_nonzero(starts)) for _, starts in _token_starts(data)]
    return sum(counts), counts


def token_places(data: np.ndarray, counts: list[int], *numbers: int) -> list[int]:
    """Offsets at which so many tokens have ended."""
    out = dict.fromkeys(numbers, len(data))
    before = 0
    for (at, starts), n in zip(_token_starts(data), counts, strict=True):
        for k in [k for k in out if before <= k < before + n]:
            out[k] = at + int(np.flatnonzero(starts)[k - before])
        before += n
    return [out[k] for k in numbers]


def _points(view: memoryview) -> int:
    data = np.frombuffer(view, np.uint8)
    return sum(int(np.count_nonzero(_POINT[data[at : at + BLOCK]])) for at in range(0, len(data), BLOCK))


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearrange(text: bytes, doc_id: int | None, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, PieceTable, int | None, int | None]:
    """(tokens, form, the document rearranged, code points of the prefix, of the middle) of one text."""
    data = np.frombuffer(text, np.uint8)
    n, counts = count_tokens(data)
    h1, h2, h3, h4 = _draws(doc_id, seed)
    document = PieceTable(text)
    if not text or h3 % 100 >= rate or any(s in text for s in _SENTINELS):
        return n, "plain", document, None, None
    form = "spm" if h4 % 100 < spm_rate else "psm"
    document = document.cut(*token_places(data, counts, *sorted((h1 % (n + 1), h2 % (n + 1)))))
    prefix, middle, _ = map(document.bytes_of, document.pieces)
    return n, form, document.arranged(form), _points(prefix), _points(middle)


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    lower = {c.lower() for c in columns}
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in lower]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), [n for n, _ in kept] + list(columns))


def _schema(df: DataFrame, columns: str) -> T.StructType:
    new = T.StructType.fromDDL(columns)
    lower = {f.name.lower() for f in new}
    return T.StructType([f for f in df.schema if f.name.lower() not in lower] + list(new))


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def fill_middle(docs: DataFrame, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars, output (the text to train on) and output_sha256."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, doc_id in zip(_texts(batch.column(text_col)), batch.column(id_col).to_pylist(), strict=True):
                n, form, document, prefix, middle = rearrange(text, doc_id, seed, rate, spm_rate)
                rows.append((n, form, prefix, middle, document.render().decode(), document.sha256()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string(), "output_sha256": pa.string()}
            yield _with(batch, {k: pa.array(c, t) for (k, t), c in zip(types.items(), columns, strict=True)})

    return docs.mapInArrow(run, _schema(docs, "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"))


def restore(arranged: DataFrame, with_text: bool = True, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The texts again, from outputs and forms alone: restored (unless with_text is false) and restored_sha256."""
    prepare(arranged.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = (PieceTable(t).restored(f) for t, f in zip(_texts(batch.column(output_col)), batch.column(form_col).to_pylist(), strict=True))
            rows = [(d.sha256(), d.render().decode() if with_text else None) for d in documents]
            new = {"restored_sha256": pa.array([r[0] for r in rows], pa.string())}
            yield _with(batch, new | ({"restored": pa.array([r[1] for r in rows], pa.string())} if with_text else {}))

    return arranged.mapInArrow(run, _schema(arranged, "restored_sha256 string" + (", restored string" if with_text else "")))
