"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, per-document perplexity, thresholds by language.

The model predicts characters from the three before them. Tasks count n-grams and shuffle only their counts; counts,
continuation counts and context totals are tables keyed by packed n-gram, and the probability of every n-gram that
occurs in the corpus comes from joins of these tables, sharded by key. The scored n-grams stay in the shared folder as
shards of bounded size; a task reads one shard at a time and adds each text's share of the sum, so a worker holds one
shard and the driver none. A document's score is its mean negative log probability by character (the log of its
perplexity). A language's threshold is a quantile of the scores of its trusted documents, found exactly from a
histogram and, in small languages, raised towards that of all; documents above it go.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, marked, new_folder, prepare, read_whole, remove, trusted_ids, write_whole

ORDER = 4
#: Symbols: 12 bits. 0 bounds a text; code points up to 3070 have their own; the rest share 1024 classes.
BITS, OWN = 12, 3071
MASK = (1 << BITS) - 1
#: A language's threshold: this quantile of its trusted documents' scores, plus a margin in nats a character.
QUANTILE, MARGIN = 0.999, 0.02
#: Width of the histogram's bins, and the trusted documents at which a language's own quantile has half the say.
BIN, SHRINK = 0.001, 100
#: Characters whose mean is mixed into a short text's mean, at the trusted mean, so that few characters decide little.
PRIOR = 200.0
#: Characters that are turned into n-grams at a time, and that a task holds while it reads shard after shard.
PIECE, HELD = 250_000, 16_000_000
#: Scored n-grams that a worker holds at a time, at about 28 bytes each.
SHARD_GRAMS = 2_000_000
_MERGE = 1_000_000


def pieces(texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) that cover all texts in order, each list of at most PIECE characters or so."""
    out, size = [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            upto = min(len(t), at + PIECE)
            out.append((i, at, upto))
            size += upto - at + ORDER
            if size >= PIECE:
                yield out
                out, size = [], 0
            at = upto
            if at == len(t):
                break
    if out:
        yield out


def grams_of(texts: list[str], spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams of the spans one after another, how many each has): one for each character and one for a text's end."""
    ahead = ORDER - 1
    parts, lead, last = [], [], []
    for i, a, b in spans:
        t = texts[i]
        lead.append(a == 0)
        last.append(b == len(t))
        parts.append(("\0" * ahead if a == 0 else t[a - ahead : a]) + t[a:b] + ("\0" if last[-1] else ""))
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    line = np.where(code < OWN, code + 1, OWN + 1 + (code & 1023)).astype(np.int64)
    width = np.fromiter(map(len, parts), np.int64, len(parts))
    n = width - ahead
    starts = np.cumsum(width) - width
    begins, ends = starts[np.array(lead, bool)], (starts + width - 1)[np.array(last, bool)]
    for j in range(ahead):
        line[begins + j] = 0
    line[ends] = 0
    packed = line[: len(line) - ahead].copy()
    for j in range(1, ORDER):
        packed <<= BITS
        packed |= line[j : len(line) - ahead + j]
    good = np.ones(len(packed), bool)
    for j in range(ahead):  # windows that end in the next span
        good[starts[1:] - ahead + j] = False
    return packed[good], n


_COUNTED = pa.schema([("gram", pa.int64()), ("n", pa.int64())])


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n) over all rows of (text, good): n counts trusted rows alone and may be 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(g, kind="stable")
            g, n = g[order], n[order]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
            return g[first], np.add.reduceat(n, first) if len(g) else n

        for batch in batches:
            text, good = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for flag in (True, False):
                part = [t for t, g in zip(text, good) if g == flag]
                for spans in pieces(part):
                    g, n = np.unique(grams_of(part, spans)[0], return_counts=True)
                    held.append((g, n if flag else np.zeros_like(n)))
                    if sum(len(x) for x, _ in held[1:]) > _MERGE:
                        held = [merged()]
        if held:
            g, n = merged()
            for i in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(g[i : i + 100_000]), pa.array(n[i : i + 100_000])], schema=_COUNTED)

    return docs.select("text", "good").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    n = counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()
    if not n[0] or not n[1]:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (1, 2, 3)))


def probabilities(grams: DataFrame) -> DataFrame:
    """(gram, nll) for each gram of (gram, n), from the model of those with n > 0."""
    table = keep(grams.where("n > 0").select("gram", F.col("n").alias("c")), "kn-counts")
    tables = [table]
    out = grams.select("gram", F.col("gram").alias("g4"))
    orders = []
    for k in range(ORDER, 0, -1):
        one, two, more = _discounts(table)
        c = F.col("c")
        less = F.when(c == 1, one).when(c == 2, two).otherwise(more)
        context = table.groupBy(F.shiftright("gram", BITS).alias("ctx")).agg(F.sum("c").alias("total"), F.sum(less).alias("freed"))
        orders.append((k, table.select("gram", (c - less).alias("rest")), context))
        if k > 1:
            table = keep(table.groupBy(F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1).alias("gram")).agg(F.count("*").alias("c")), "kn-counts")
            tables.append(table)
    p = F.lit(1.0 / (1 << BITS))
    for k, rest, context in reversed(orders):
        own = F.col("g4").bitwiseAND((1 << BITS * k) - 1)
        out = out.withColumn("k", own).join(rest.select(F.col("gram").alias("k"), "rest"), "k", "left").drop("k")
        out = out.withColumn("k", F.shiftright(own, BITS)).join(context.withColumnRenamed("ctx", "k"), "k", "left").drop("k")
        p = F.when(F.col("total").isNull(), p).otherwise(F.greatest(F.coalesce("rest", F.lit(0.0)), F.lit(0.0)) / F.col("total") + F.col("freed") / F.col("total") * p)
        out = out.withColumn(f"p{k}", p).drop("rest", "total", "freed")
        p = F.col(f"p{k}")
    scores = keep(out.select("gram", (-F.log(f"p{ORDER}")).alias("nll")), "kn-scores")
    remove(grams.sparkSession, *tables)
    return scores


class GramTable:
    """Gram to score: sorted grams, and two tables of places so that nearly every gram is found in one or two steps."""

    def __init__(self, grams: np.ndarray, nll: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.nll = grams[order], nll[order].astype(np.float32)
        self.places, rest = [], np.arange(len(grams))
        for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            bits = max(4, int(2 * len(rest)).bit_length())
            shift, at = np.uint64(64 - bits), np.zeros(1 << bits, np.int32)
            slots = self._slots(self.grams[rest], np.uint64(salt), shift)
            at[slots] = rest
            rest = rest[at[slots] != rest]
            self.places.append((np.uint64(salt), shift, at))
        self.rest = rest

    @staticmethod
    def _slots(g: np.ndarray, salt: np.uint64, shift: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((g.view(np.uint64) * salt) >> shift).astype(np.int64)

    def lookup(self, g: np.ndarray) -> np.ndarray:
        """Scores; 0 for grams that the table lacks."""
        out = np.zeros(len(g), np.float32)
        if not len(self.grams):
            return out
        miss = np.arange(len(g))
        for salt, shift, at in self.places:
            i = at[self._slots(g[miss], salt, shift)]
            hit = self.grams[i] == g[miss]
            out[miss[hit]] = self.nll[i[hit]]
            miss = miss[~hit]
        if len(miss) and len(self.rest):
            i = self.rest[np.minimum(np.searchsorted(self.grams[self.rest], g[miss]), len(self.rest) - 1)]
            out[miss] = np.where(self.grams[i] == g[miss], self.nll[i], 0)
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of scores, number of grams) of each text."""
        texts = [t or "" for t in texts]
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for spans in pieces(texts):
            g, k = grams_of(texts, spans)
            each = np.fromiter((i for i, _, _ in spans), np.int64, len(spans))
            some = k > 0
            np.add.at(total, each[some], np.add.reduceat(self.lookup(g).astype(np.float64), (np.cumsum(k) - k)[some]) if some.any() else 0.0)
            np.add.at(n, each, k)
        return total, n


#: The shards that this worker has read last, by their files.
_LOADED: dict[tuple[str, ...], GramTable] = {}


def _loaded(paths: tuple[str, ...]) -> GramTable:
    if paths not in _LOADED:
        _LOADED.clear()
        parts = [np.load(io.BytesIO(read_whole(p))) for p in paths]
        _LOADED[paths] = GramTable(np.concatenate([np.zeros(0, np.int64), *(p["grams"] for p in parts)]), np.concatenate([np.zeros(0, np.float32), *(p["nll"] for p in parts)]))
    return _LOADED[paths]


def shards(scores: DataFrame, shard_grams: int = SHARD_GRAMS) -> list[tuple[str, ...]]:
    """Write (gram, nll) to files of at most shard_grams or so; the files, in groups that a worker holds at a time."""
    n, folder = scores.count(), new_folder(scores.sparkSession, "kn-shards")
    schema = pa.schema([("path", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.float32)) for b in batches if b.num_rows]
        if held:
            out, path = io.BytesIO(), f"{folder}/{uuid.uuid4().hex}"
            np.savez(out, grams=np.concatenate([g for g, _ in held]), nll=np.concatenate([s for _, s in held]))
            write_whole(path, out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sum(len(g) for g, _ in held)])], schema=schema)

    files = keep(scores.select("gram", "nll").repartition(max(1, -(-n // shard_grams)), "gram").mapInArrow(run, "path string, n long"), "kn-files")
    groups: list[tuple[str, ...]] = []
    room = 0
    for path, k in files.toLocalIterator():  # a row for each shard
        if k > room or not groups:
            groups.append(())
            room = shard_grams
        groups[-1] += (path,)
        room -= k
    return groups or [()]


def raised(own: float, n: int, pooled: float) -> float:
    """A language's own quantile, raised towards that of all languages the more, the fewer its n trusted documents are.

    The model has learnt from the documents whose scores give the quantile, and the fewer they are the better it knows
    them, so a small language's own quantile is too low for other clean documents. One rule at every size: the gap to
    the pooled quantile counts by SHRINK / (n + SHRINK); a quantile above the pooled one is left as it is, since other
    languages say nothing against it.
    """
    return own + max(0.0, pooled - own) * SHRINK / (n + SHRINK)


class Model:
    """The scored n-grams' shards, and thresholds."""

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, shard_grams: int = SHARD_GRAMS):
        prepare(docs.sparkSession)
        flagged = marked(docs.select("doc_id", "lang", "text"), keep(trusted_ids(labels), "trusted"), "doc_id", "good").select("lang", "text", "good")
        grams = keep(count_grams(flagged), "grams")
        scores = probabilities(grams)
        self.shards = shards(scores, shard_grams)
        remove(docs.sparkSession, grams, scores)
        self._thresholds(flagged.where("good"), quantile, margin)

    def _thresholds(self, trusted: DataFrame, quantile: float, margin: float) -> None:
        scored = keep(self.summed(trusted.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")), "trusted-scores")
        mean = scored.agg(F.sum("total") / F.sum("n")).first()[0]
        self.mean = float(mean) if mean is not None else 0.0
        nll = (F.col("total") + PRIOR * self.mean) / (F.col("n") + PRIOR)
        bins = scored.select("lang", F.floor(nll / BIN).alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n"))
        both = keep(bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))), "bins")
        w = Window.partitionBy("lang")
        ranked = both.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
        found = ranked.where(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy("lang").agg(F.min("bin").alias("bin"), F.max("all").alias("all"))
        rows = list(found.toLocalIterator())  # a row for each language
        pooled = next((b for lang, b, _ in rows if lang is None), 0)
        self.limits = {lang: (raised(b, n, pooled) + 1) * BIN + margin for lang, b, n in rows if lang is not None}
        self.every = float("inf")  # a language without trusted text is not judged by others

    def with_sums(self, text: int):
        """A function over batches: (batch, sum of the scores of each text, number of grams) for each batch, in order."""
        groups = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            held: list[pa.RecordBatch] = []

            def out() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
                sums = [(np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)) for b in held]
                for paths in groups:
                    table = _loaded(paths)
                    sums = [(total + one, n) for (total, _), (one, n) in zip(sums, (table.sums(b.column(text).to_pylist()) for b in held))]
                for b, (total, n) in zip(held, sums):
                    yield b, total, n
                held.clear()

            for batch in batches:
                held.append(batch)
                if len(groups) == 1 or sum(b.column(text).nbytes for b in held) > HELD:
                    yield from out()
            yield from out()

        return run

    def summed(self, rows: DataFrame) -> DataFrame:
        """rows (with text) with total and n, the sum of their scores and the number of grams, in place of text."""
        names, walk = [c for c in rows.columns if c != "text"], self.with_sums(rows.columns.index("text"))
        at = [rows.columns.index(c) for c in names]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, total, n in walk(batches):
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in at], pa.array(total), pa.array(n)], names=[*names, "total", "n"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "total double", "n long"]))


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """doc_id, lang, n_chars, perplexity (by character), threshold (of it), kept for each row of docs.

    labels: doc_id, quality, toxic; trusted are ids with quality 1 and not toxic. Null or empty text: the end alone is
    scored. Null lang: as the empty string, one language. Null ids: scored, never trusted. Repeated rows: each counts and is
    scored. A language without trusted rows is kept whole. Very long texts: whole, in pieces of bounded size. Empty
    table: no rows. Other columns are not read, so they may have any name.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    model = Model(docs, labels, quantile, margin, shard_grams)
    scored = model.summed(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_chars", pa.int64()), ("perplexity", pa.float64()), ("threshold", pa.float64()), ("kept", pa.bool_())])
    limits, every, mean = model.limits, model.every, model.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(3).to_numpy()
            score = (b.column(2).to_numpy() + PRIOR * mean) / (n + PRIOR)
            limit = np.array([limits.get(x or "", every) for x in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n - 1), pa.array(np.exp(score)), pa.array(np.exp(limit)), pa.array(score <= limit)], schema=schema)

    return scored.select("doc_id", "lang", "total", "n").mapInArrow(run, "doc_id long, lang string, n_chars long, perplexity double, threshold double, kept boolean")


def keep_fluent(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns.

    Decided row by row, as classified() does, so nulls, empty and long texts and repeated rows fare as there, ids need
    not be unique and no column is added on the way. Empty table: no rows.
    """
    model = Model(docs, labels, quantile, margin, shard_grams)
    limits, every, mean = model.limits, model.every, model.mean
    lang, walk = docs.columns.index("lang"), model.with_sums(docs.columns.index("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, total, n in walk(batches):
            limit = np.array([limits.get(x or "", every) for x in b.column(lang).to_pylist()], float)
            yield b.filter(pa.array((total + PRIOR * mean) / (n + PRIOR) <= limit))

    return docs.mapInArrow(run, docs.schema)
