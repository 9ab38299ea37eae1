"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. A letter trigram abc is bound as
rotate²(A) * rotate(B) * C, and a text's vector is the sum (bundle) of its trigrams' vectors. A language's prototype
bundles the trigrams of all training texts of that language; since bundling is a sum, it needs the language's trigram
counts alone. Prototypes are centred on their mean, so that what all languages share does not count, and a text goes
to the prototype of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text, prepare

DIMENSIONS = 1024
UNKNOWN = "und"
_SPACE = 32
#: Texts are joined up to this many characters at a time.
_CHUNK = 2_000_000
#: Trigrams that are bound at a time: their vectors take dimensions bytes each.
_TOGETHER = 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def _codes(texts: list[str]) -> np.ndarray:
    """Lower-case letters, with one space for each run of anything else and at both ends of a text; 0 between texts."""
    c = np.frombuffer("\0".join(f" {t.lower().replace(chr(0), ' ')} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter, between = _letters()[np.minimum(c, 0xFFFF)], c == 0
    high = np.flatnonzero(c > 0xFFFF)
    if len(high):
        letter[high] = [chr(x).isalpha() for x in c[high].tolist()]
    whole = letter | between
    return np.where(whole, c, _SPACE)[whole | np.r_[True, whole[:-1]]]


def trigrams(*texts: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three code points, 21 bits each) of the texts and their counts; none goes beyond a text."""
    c = _codes(list(texts)) if texts else np.zeros(0, np.int64)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (c[:-2] > 0) & (c[1:-1] > 0) & (c[2:] > 0)
    return np.unique((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inside], return_counts=True)


@lru_cache(maxsize=20_000)
def _vector(code: int, dimensions: int) -> np.ndarray:
    return (np.random.Generator(np.random.Philox(key=code)).integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)


def bind(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row for each trigram: rotate²(A) * rotate(B) * C."""
    parts = [grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]
    codes, at = np.unique(np.concatenate(parts), return_inverse=True)
    table = np.stack([_vector(int(c), dimensions) for c in codes])
    a, b, c = at.reshape(3, -1)
    out = np.roll(table, 2, 1)[a]
    out *= np.roll(table, 1, 1)[b]
    out *= table[c]
    return out


class Prototypes:
    def __init__(self, bundles: dict[str, np.ndarray], dimensions: int = DIMENSIONS):
        """bundles: language to the sum of its trigrams' vectors."""
        self.names, self.dimensions = sorted(bundles), dimensions
        rows = np.array([bundles[k] / (np.linalg.norm(bundles[k]) or 1) for k in self.names]).reshape(-1, dimensions)
        self.mean = rows.mean(0) if len(rows) > 1 else np.zeros(dimensions)
        centred = rows - self.mean
        self.unit = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, cosine from 0 to 1) of each text."""
        grams = [trigrams(t or "") for t in texts]
        every = np.unique(np.concatenate([g for g, _ in grams])) if texts else np.zeros(0, np.int64)
        if not len(every) or not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        vectors = np.zeros((len(texts), self.dimensions), np.float32)
        for at in range(0, len(every), _TOGETHER):
            some = every[at : at + _TOGETHER]
            table = bind(some, self.dimensions)
            for i, (g, n) in enumerate(grams):
                a, b = np.searchsorted(g, some[0]), np.searchsorted(g, some[-1], "right")
                if a < b:
                    vectors[i] += n[a:b].astype(np.float32) @ table[np.searchsorted(some, g[a:b])].astype(np.float32)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        vectors -= self.mean.astype(np.float32)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        cosine = vectors @ self.unit.T
        best = cosine.argmax(1)
        return [(self.names[b], float(min(1.0, max(0.0, cosine[i, b])))) if len(grams[i][0]) else (UNKNOWN, 0.0) for i, b in enumerate(best.tolist())]


def fit(training: DataFrame, dimensions: int = DIMENSIONS) -> Prototypes:
    """Prototypes from (lang, text) rows without nulls. Tasks count; only (lang, trigram, count) rows are shuffled.

    Counts are bundled where they were gathered: each task binds its share of the (lang, trigram) rows and returns one
    vector for each language, so the driver receives vectors and no counts.
    """
    counted = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    bundled = pa.schema([("lang", pa.string()), ("bundle", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                part: list[str] = []
                size = 0
                for i, t in enumerate(texts):
                    part.append(t)
                    size += len(t)
                    if size >= _CHUNK or i == len(texts) - 1:
                        grams, n = trigrams(*part)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], schema=counted)
                        part, size = [], 0

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, gram, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for name in set(lang.tolist()):
                own = np.flatnonzero(lang == name)
                total = sums.setdefault(name, np.zeros(dimensions))
                for i in range(0, len(own), 4096):
                    rows = own[i : i + 4096]
                    total += n[rows].astype(float) @ bind(gram[rows], dimensions).astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], schema=bundled)

    grams = training.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total: dict[str, np.ndarray] = {}
    for name, v in grams.mapInArrow(bundle, "lang string, bundle binary").toLocalIterator():
        total[name] = total.get(name, 0) + np.frombuffer(v)
    return Prototypes(total, dimensions)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identified(docs: DataFrame, folds: int = 3, held: int = 1, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    Held out: rows whose crc32 of the id's decimal text leaves `held` modulo `folds`; they teach nothing. Null id: not
    held out. Null lang teaches nothing and is predicted like any other; null, empty or letterless text: und, score 0.
    Ties: of equal cosines, the first language in alphabetic order. Repeated rows teach again. Without training rows all is und. Very long texts: whole. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    held_out = F.coalesce(F.pmod(crc32_text(F.col("doc_id")), F.lit(folds)) == held, F.lit(False))
    learned = fit(docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()), dimensions)
    shared = spark.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = shared.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
