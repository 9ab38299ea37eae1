"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in shards. A shard lays its documents' words on one line of positions, with gaps between
documents that no window can cross, and stores for each term its sorted positions (postings). The test items' windows
are then looked up in every shard: the postings of a window's rarest term in the shard give candidate starts, which
are intersected, rarest first, with the other terms' postings moved back by their offsets. What remains are exact
phrase matches; with a slack, each term may be that many words off its place after one start (proximity matches). Only postings of
terms that occur in some item are read back, and a shard is searched by one task, so no group grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, marked, prepare, unused

WINDOW = 10
#: A shard is closed when it holds this many words (bounds its memory and positions).
SHARD_WORDS = 4_000_000
#: Test items are searched in blocks of this many windows at most (bounds what is broadcast).
BLOCK_WINDOWS = 500_000

#: A-Z to a-z, digits, a-z and all bytes of non-ASCII characters to themselves, the rest to spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def _windows(items: list[tuple[str | None, str]], window: int) -> dict[tuple[bytes, ...], list[str]]:
    """Each distinct window and the items that have it."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[i : i + window]), set()).update([item] if item is not None else [])
    return {k: sorted(v) for k, v in out.items()}


_POSTINGS = pa.schema([("shard", pa.string()), ("term", pa.binary()), ("positions", pa.binary())])


def build_index(docs: DataFrame, gap: int, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored index: (shard, term, positions), positions as delta-coded unsigned 32-bit integers.

    The row without a term holds the shard's documents: ids, whether null, start and number of words of each.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        ids, starts, counts, terms, at = [], [], [], [], 0
        number: dict[bytes, int] = {}

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal at
            name = uuid.uuid4().hex
            head = np.array([[k is None, k or 0] for k in ids], np.int64).reshape(-1, 2)
            head = np.column_stack([head, np.array(starts, np.int64), np.array(counts, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None], pa.binary()), pa.array([head.tobytes()], pa.binary())], schema=_POSTINGS)
            if number:
                term = np.concatenate(terms)
                n = np.array(counts, np.int64)
                place = np.arange(len(term)) + np.repeat(np.array(starts) - np.r_[0, np.cumsum(n)[:-1]], n)
                order = np.argsort(term, kind="stable")
                place = place[order]
                edges = np.r_[0, np.cumsum(np.bincount(term, minlength=len(number)))]
                delta = np.diff(place, prepend=0)
                delta[edges[:-1]] = place[edges[:-1]]
                data = delta.astype("<u4").tobytes()
                cut = (edges * 4).tolist()
                words = list(number)
                for i in range(0, len(words), 20_000):
                    part = words[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part, pa.binary()), pa.array([data[cut[j] : cut[j + 1]] for j in range(i, i + len(part))], pa.binary())], schema=_POSTINGS)
            for x in (ids, starts, counts, terms, number):
                x.clear()
            at = 0

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                ids.append(k)
                starts.append(at)
                counts.append(len(w))
                terms.append(np.array([number.setdefault(x, len(number)) for x in w], np.int64))
                at += len(w) + gap
                if at >= shard_words:
                    yield from close()
        if ids:
            yield from close()

    return keep(rows.mapInArrow(run, "shard string, term binary, positions binary"), "positional-index")


def find(postings: list[np.ndarray], slack: int = 0) -> tuple[np.ndarray, int]:
    """(positions of the rarest term, its offset) such that term j of the lists occurs at j words after some start, give or take slack.

    The start is the same for all terms and itself within slack of what the rarest term's position gives, so that the
    answer does not depend on which term is rarest.
    """
    order = sorted(range(len(postings)), key=lambda j: len(postings[j]))
    rarest = order[0]
    at = np.repeat(postings[rarest], 2 * slack + 1)
    start = at - rarest + np.tile(np.arange(-slack, slack + 1), len(postings[rarest]))
    for j in order[1:]:
        if not len(at):
            break
        p, low = postings[j], start + (j - slack)
        i = np.minimum(np.searchsorted(p, low), len(p) - 1)
        good = (p[i] >= low) & (p[i] <= low + 2 * slack)
        at, start = at[good], start[good]
    return (np.unique(at) if slack else at), rarest


def search_shard(head: np.ndarray, postings: dict[bytes, np.ndarray], windows: dict[tuple[bytes, ...], list[str]], slack: int) -> pd.DataFrame:
    """For each document of the shard with a match: its row, numbers of the words hit, items and near items."""
    begins = head[:, 2]
    edge = np.zeros(int(begins[-1] + head[-1, 3]) + 1 if len(head) else 1, np.int32)
    items: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}
    for window, of in windows.items():
        lists = [postings.get(t) for t in window]
        if any(p is None for p in lists):
            continue
        at, rarest = find(lists)
        if len(at):
            edge[at - rarest] += 1  # a window's starts differ, so plain indexing counts each
            edge[at - rarest + len(window)] -= 1
            for row in np.unique(np.searchsorted(begins, at, "right") - 1).tolist():
                items.setdefault(row, set()).update(of)
        if slack:
            for row in np.unique(np.searchsorted(begins, find(lists, slack)[0], "right") - 1).tolist():
                near.setdefault(row, set()).update(of)
    hit = np.flatnonzero(np.cumsum(edge) > 0)
    out = []
    for r in sorted({*items, *near}):
        low, high = np.searchsorted(hit, [begins[r], begins[r] + head[r, 3]])
        out.append((r, (hit[low:high] - begins[r]).tolist(), sorted(items.get(r, ())), sorted(near.get(r, ()))))
    return pd.DataFrame(out, columns=["row", "hits", "items", "near_items"])


def _item_blocks(benchmark: DataFrame, window: int, block: int) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """The items' windows in blocks of bounded size; items come to the driver one at a time."""
    items, n = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        items.append((item, text))
        n += max(1, len(text) // 4)
        if n >= block:
            yield _windows(items, window)
            items, n = [], 0
    if items:
        yield _windows(items, window)


def _undelta(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4").astype(np.int64))


def _searcher(shared, slack: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(pdf["term"], pdf["positions"]))
        head = np.frombuffer(of.pop(None), np.int64).reshape(-1, 4)
        out = search_shard(head, {bytes(t): _undelta(p) for t, p in of.items()}, shared.value, slack)
        out.insert(0, "shard", pdf["shard"].iloc[0])
        return out

    return run


_MATCH = "shard string, row long, hits array<int>, items array<string>, near_items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, block: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (array of item ids), near_items for each row of docs.

    A window: `window` consecutive words of an item, or all of a shorter one. near_items: items with a window whose
    words all occur within slack words of their places after one start, so up to 2 * slack words may stand between them
    (empty when slack is 0). Null or empty texts have no words;
    null ids and repeated rows are kept as they are; an item without words has no window; equal items match alike and
    each is listed; an item_id that occurs twice is listed once; an item without an id hits and is not listed. Very long
    texts: a shard takes one whole and is closed after it. Empty benchmark: no hits. Empty docs: no rows. Other columns
    are not read.
    """
    spark = prepare(docs.sparkSession)
    index = build_index(docs, window + 2 * slack + 2, id_col, text_col, shard_words)
    heads = index.where("term is null").select("shard", "positions")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = None
    for windows in _item_blocks(benchmark, window, block):
        shared = spark.sparkContext.broadcast(windows)
        terms = spark.createDataFrame(sorted({(t,) for w in windows for t in w}) or [(b"",)], "term binary")
        wanted = index.join(F.broadcast(terms), "term", "left_semi") if windows else index.where("false")
        both = heads.withColumn("term", F.lit(None).cast("binary")).unionByName(wanted).repartition(parts, "shard")
        part = keep(both.groupBy("shard").applyInPandas(_searcher(shared, slack), _MATCH), "matches")
        found = part if found is None else found.unionByName(part)
    return _documents(spark, heads, found)


def _documents(spark: SparkSession, heads: DataFrame, found: DataFrame | None) -> DataFrame:
    schema = pa.schema([("shard", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.frombuffer(head, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(h), pa.string()), pa.array(np.arange(len(h))), pa.array(h[:, 1], mask=h[:, 0].astype(bool)), pa.array(h[:, 3])], schema=schema)

    docs = heads.mapInArrow(rows, "shard string, row long, doc_id long, n_words long")
    if found is None:
        none = F.array().cast("array<string>")
        return docs.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), none.alias("near_items"))
    merged = found.groupBy("shard", "row").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    none = F.array().cast("array<string>")
    return docs.join(merged, ["shard", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with all their columns.

    Rows are told apart by a row number given before the index is built, so ids may be null or repeated; its name and
    the mark's are ones that docs lacks. Null and empty texts stay. Empty tables: no rows, or docs as it is.
    """
    prepare(docs.sparkSession)
    row, bad = unused("row_number", docs), unused("is_bad", docs)
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = keep(contamination(numbered, benchmark, window, id_col=row).where("n_hit > 0").select("doc_id"), "contaminated")
    return marked(numbered, found, row, bad).where(~F.col(bad)).drop(row, bad)
