"""Which filters of a chain do the work, and which only look as if they did: contingency tensors and their contractions.

Every document fails or passes each of k filters, so a part's documents fall into 2^k cells. The cells' counts (all
documents, good ones, toxic ones) are reshaped to a 2 x 2 x ... x 2 tensor, an axis for each filter, and every figure
of every order of the filters is a contraction of it: along each axis a step selects pass, fail or all.

Spark makes the cells: one pass over the texts, then counts that are combined before each shuffle. A part's cells are
at most 2^k rows whatever the part holds, so a third of all documents in one part, or with one text, is no burden.

Defined results: a null text is an empty one; a null part is the empty string, and one part with it. A row without an
id is a copy of nothing and makes nothing a copy; rows that repeat an id and a text are not copies of each other, and
both count. A document is good (or toxic) if any of its label rows says so; null labels say nothing. Columns other
than those used are not looked at. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import permutations
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, small

#: Parts whose tensors are contracted together.
PARTS = 32
#: Bytes of an id and two flags in a broadcast hash relation.
FLAG_BYTES = 72
#: Null ids, which match no label, are dealt over so many join keys.
SALTS = 4096

_WORDS = r"[^\x20\x09-\x0D]+"
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3) -> list[Column]:
    """Failure conditions A to D of a non-null text: few words, repeated words, capitals, signs (both shares in per cent)."""
    words = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        n < least_words,
        100 * F.size(F.array_distinct(words)) < least_distinct * n,
        100 * capitals.cast("long") > most_capitals * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (with a column id) and whether some label row of the id says good, and toxic."""
    said = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(flag) for c, flag in (("quality", "good"), ("toxic", "toxic"))]
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(*said).where("good OR toxic").withColumn("label_salt", F.lit(0))
    near = small(flags, FLAG_BYTES)
    salted = docs.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS)).cast("int")).otherwise(0))
    out = salted.join(F.broadcast(flags) if near else flags, F.expr("id = label_id AND salt = label_salt"), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).drop("label_id", "label_salt", "salt")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): bit i of mask is set where documents fail filter i; the last filter is for copies.

    Rows of one text are counted before they meet, so a text of a third of all rows is a row for each task, part and
    label. What is left of a text, at most four rows a part, looks up the text's smallest id.
    """
    text = F.coalesce("text", F.lit(""))
    fails = text_failures(text)
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    marked = docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    same = ["digest", "part", "mask", "good", "toxic"]
    rows = with_labels(marked, labels).groupBy("id", *same).agg(F.count(F.lit(1)).alias("n"))
    of_text = rows.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    first = F.min("first.id").over(Window.partitionBy("digest"))
    kept_of_first = F.when(F.col("first.id") == first, F.col("first.n")).otherwise(0)
    copies = of_text.withColumn("copies", F.col("with_id") - F.coalesce(kept_of_first, F.lit(0)))
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << len(fails))).alias("mask"), F.col("copies").alias("n")))
    cell = copies.select("part", "good", "toxic", F.explode(both).alias("cell")).where("cell.n > 0")
    counts = [F.sum("cell.n").alias("n"), *[F.sum(F.when(F.col(c), F.col("cell.n")).otherwise(0)).alias(c) for c in ("good", "toxic")]]
    return cell.groupBy("part", F.col("cell.mask").alias("mask")).agg(*counts)


@lru_cache(maxsize=4)
def _steps(k: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(orders, filter of each step, selections for kept, for removed, and for failing a filter alone).

    A selection is (step, axis, 2); steps of all orders one after another.
    """
    orders = list(permutations(range(k)))
    filters, kept, removed = [], [], []
    for order in orders:
        for at, f in enumerate(order):
            axes = [_ALL] * k
            for g in order[:at]:
                axes[g] = _PASS
            kept.append([_PASS if i == f else a for i, a in enumerate(axes)])
            removed.append([_FAIL if i == f else a for i, a in enumerate(axes)])
            filters.append(f)
    alone = [[_FAIL if i == f else _PASS for i in range(k)] for f in range(k)]
    return orders, np.array(filters), *(np.array(s, np.int64) for s in (kept, removed, alone))


def contract(tensor: np.ndarray, selection: np.ndarray) -> np.ndarray:
    """Sums of the cells that each selection takes: tensor (..., 2, 2, ...) by (steps, axes, 2) to (..., steps)."""
    k = selection.shape[1]
    axes = ascii_lowercase[:k]
    terms = ",".join(f"z{a}" for a in axes)
    return np.einsum(f"...{axes},{terms}->...z", tensor, *(selection[:, i] for i in range(k)), optimize="greedy")


def figures(counts: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Figures of every step of every order from counts (3, parts, 2^k) of all, good and toxic documents.

    Each is (parts, steps); bit i of a cell's number is filter i.
    """
    _, filters, kept, removed, alone = _steps(k)
    tensor = counts.reshape(*counts.shape[:2], *[2] * k).transpose(0, 1, *range(k + 1, 1, -1))  # the first axis is the lowest bit
    gone = contract(tensor, removed)
    failing = np.stack([contract(tensor[0], np.array([[_FAIL if i == f else _ALL for i in range(k)]], np.int64))[..., 0] for f in range(k)], -1)
    by_filter = np.stack([gone[0][:, filters == f].sum(-1) for f in range(k)], -1)
    return {
        "kept": contract(tensor[0], kept),
        "removed": gone[0],
        "redundant": failing[:, filters] - gone[0],
        "unique_fails": contract(tensor[0], alone)[:, filters],
        "good_lost": gone[1],
        "toxic_lost": gone[2],
        "shapley": by_filter[:, filters],
    }


def interactions(cells: DataFrame, names: Sequence[str] = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters and step, zeros included, from (part, mask, n, good, toxic)."""
    names, k = tuple(names), len(names)
    prepare(cells.sparkSession)

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, *_ = _steps(k)
        words = pa.array(["".join(names[f] for f in order) for order in orders for _ in order])
        steps = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                counts = np.zeros((3, some.num_rows, 1 << k), np.int64)
                for i, cells_of_part in enumerate(some.column("cells").to_pylist()):
                    for c in cells_of_part:
                        counts[:, i, c["mask"]] += c["n"], c["good"], c["toxic"]
                found = figures(counts, k)
                for i, part in enumerate(some.column("part")):
                    columns = [pa.repeat(part, len(steps)), words, pa.array(steps), *[pa.array(v[i]) for v in found.values()]]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *found])

    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^k of them
    return by_part.mapInArrow(of_parts, _SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents, audited by language: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(cells(docs, labels))
