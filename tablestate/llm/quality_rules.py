"""Quality rules: base counts of each text, and a hashed n-gram likelihood ratio between trusted and raw text.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are counted: one
from trusted documents, one from all documents. A document's score is the mean, over its n-grams, of the log ratio of
the two bucket probabilities: near zero for text like the trusted part, negative for text that the raw corpus has and
the trusted part lacks. A document stays when its score reaches a threshold that depends on nothing but the two
multinomials and the parameters, so the same document gets the same verdict on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, marked, prepare

#: Buckets: the multinomials have this many entries however large the corpus is (bounds what is broadcast).
BUCKETS = 1 << 14
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Lowest mean log ratio (nats an n-gram) of a document that stays.
THRESHOLD = -0.08
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
_BREAKS = " \t\n\x0b\x0c\r"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of consecutive words that occur twice or more in the text."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for i in range(window):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice))
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BREAKS)]
    return len(lines) - len(set(lines))


def buckets_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each word, then of each pair of neighbours. buckets: a power of two."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    with np.errstate(over="ignore"):
        one = h * np.uint64(0xD6E8FEB86659FD93)
        two = (h[:-1] * np.uint64(0xBF58476D1CE4E5B9) + h[1:]) * np.uint64(0x94D049BB133111EB) if len(h) > 1 else h[:0]
    return np.concatenate([one >> shift, two >> shift]).astype(np.int64)


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of each bucket, from all documents and from those whose id is in trusted.

    Tasks count in arrays of fixed size; one row for each bucket and task is shuffled, one for each bucket collected.
    """
    prepare(docs.sparkSession)
    rows = marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), trusted, "id", "good").select("text", "good")
    schema = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                if words:
                    counts = np.bincount(buckets_of(word_hashes(words), buckets), minlength=buckets)
                    raw += counts
                    if good:
                        target += counts
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(target[some]), pa.array(raw[some])], schema=schema)

    counted = rows.mapInArrow(run, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for b, t, r in counted.toLocalIterator():  # at most `buckets` rows
        target[b], raw[b] = t, r
    return np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets))


def measure(text: str, ratio: np.ndarray) -> tuple[int, int, int, int, int, bool, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score of one text."""
    words = text.encode().split()
    n = len(words)
    h = word_hashes(words)
    repeats = repeated_words(h)
    score = float(ratio[buckets_of(h, len(ratio))].mean()) if n else 0.0
    return (
        n,
        len(text) - sum(map(text.count, _BREAKS)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text),
        repeats,
        n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n,
        score,
    )


_OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())]
)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, score and verdict for each row of docs.

    labels: doc_id, quality, toxic; trusted are ids with quality 1 and not toxic. Null or empty text: all counts 0,
    base_failed. Null ids: scored, never trusted. Repeated rows: each counts and is scored. Without trusted or any
    documents all ratios are equal and every score is 0 or so. Very long texts: whole. Other columns are not read.
    """
    from .common import trusted_ids

    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fit(docs, keep(trusted_ids(labels), "trusted"), id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            found = [measure(t or "", ratio) for t in batch.column(1).to_pylist()]
            cols = list(zip(*found)) if found else [[]] * 7
            kept = [not failed and score >= threshold for failed, score in zip(cols[5], cols[6])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.bool_()), pa.array(kept, pa.bool_()), pa.array(cols[6], pa.float64())], schema=_OUT)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; decided row by row, so ids need not be unique."""
    from .common import trusted_ids

    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fit(docs, keep(trusted_ids(labels), "trusted")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            verdicts = [not m[5] and m[6] >= threshold for m in (measure(t or "", ratio) for t in batch.column(at).to_pylist())]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
