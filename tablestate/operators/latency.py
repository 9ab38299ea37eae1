"""E. Latency and wait analysis before and during a change, against a budget."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: The class that is slow on purpose: an instrument, left out of the overall figures.
INSTRUMENT = "slow_read"
#: Budget terms in the order in which they are reported.
TERMS = ("p50", "p99", "p999", "max_block")
#: Microseconds of the units of a duration.
UNITS = {"ns": 0.001, "us": 1.0, "\u00b5s": 1.0, "\u03bcs": 1.0, "ms": 1e3, "s": 1e6, "m": 6e7, "h": 3.6e9}
_UNIT = "|".join(UNITS)


def tag_phase(samples: DataFrame, runs: DataFrame, at: str = "at_ts") -> DataFrame:
    """samples with phase: baseline if they finished before the run's change began, else during."""
    start = runs.select("run_id", "change_start")
    return samples.join(start, "run_id").withColumn("phase", F.when(F.col(at) < F.col("change_start"), "baseline").otherwise("during")).drop("change_start")


#: Ranges of time in which windows are filed: of about this many samples, and so many at most.
RANGE_ROWS, RANGES = 32768, 1024


def _bounds(samples: DataFrame, at: str) -> list[int]:
    """Values of at that cut the samples into ranges of about one size."""
    shares = [i / RANGES for i in range(1, RANGES)]
    r = samples.agg(F.count(at).alias("n"), F.percentile_approx(at, shares, 10000).alias("p")).first()
    n = min(RANGES, -(-r.n // RANGE_ROWS))
    return sorted({r.p[RANGES * i // n - 1] for i in range(1, n)})


def _range_of(x: Column, bounds: list[int]) -> Column:
    """How many bounds are not above x: first among each so-manieth, then among those that follow."""
    if not bounds:
        return F.when(x.isNotNull(), 0)
    step = math.isqrt(len(bounds)) + 1
    literal = lambda values: F.array(*[F.lit(b).cast("long") for b in values])
    upto = lambda values: F.size(F.filter(values, lambda b: b <= x))
    coarse = upto(literal(bounds[::step]))
    fine = (coarse - 1) * step + upto(F.slice(literal(bounds), (coarse - 1) * step + 1, F.lit(step)))
    return F.when(x.isNotNull(), F.when(coarse == 0, 0).otherwise(fine))


#: Samples and windows in a block of pairs, and in a tile of it, whose pairs come out together.
BLOCK_ROWS, TILE_ROWS, TILE_WINDOWS = 4096, 32, 128


def _by_ranges(samples: DataFrame, changes: DataFrame, at: str, by: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """samples with range_; windows that may begin or end among the samples of a range (by_, filed_); the change_no of
    windows that hold the whole range (by_, filed_); how many ranges there are.

    The second has a row with whole_ for each range that the third has. A sample without a time is in a range of its own
    kind, below 0.
    """
    bounds = _bounds(samples, at)
    rows = samples.withColumn("range_", F.coalesce(_range_of(F.col(at), bounds), -1 - F.pmod(F.hash(*samples.columns), F.lit(RANGES))))
    lasting, numbered = F.col("ended_us").isNull(), F.col("change_no").isNotNull()
    windows = changes.where(F.col(by).isNotNull() & F.col("started_us").isNotNull() & (lasting | (F.col("ended_us") > F.col("started_us"))))
    last = F.when(lasting, len(bounds)).otherwise(_range_of(F.col("ended_us") - 1, bounds))
    windows = windows.select(F.col(by).alias("by_"), "change_no", "started_us", "ended_us", _range_of(F.col("started_us"), bounds).alias("first_"), last.alias("last_"))
    ends = F.when(~numbered, F.sequence("first_", "last_")).when(lasting, F.array("first_")).otherwise(F.array_distinct(F.array("first_", "last_")))
    edges = windows.select("by_", F.explode(ends).alias("filed_"), "change_no", "started_us", "ended_us", F.lit(False).alias("whole_"))
    between = windows.where(numbered).select("by_", "change_no", (F.col("first_") + 1).alias("first_"), F.when(lasting, F.col("last_")).otherwise(F.col("last_") - 1).alias("last_")).where("first_ <= last_")
    ranges = F.explode(F.sequence("first_", "last_")).alias("filed_")
    one = lambda df, *keys: df.withColumn("no_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).where("no_ = 1")
    held = one(one(between, "by_", "first_", "last_").select("by_", ranges), "by_", "filed_")
    none = [F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in ("change_no", "started_us", "ended_us")]
    near = edges.unionByName(held.select("by_", "filed_", *none, F.lit(True).alias("whole_")))
    return rows, near, between.select("by_", ranges, "change_no"), len(bounds) + 1


def _beside_changes(rows: DataFrame, near: DataFrame, at: str, by: str, how: str) -> DataFrame:
    """rows joined with the windows of their range that hold them, as change_no, started_us and ended_us, and with the row that stands for windows that hold the whole range."""
    inside = (F.col("started_us") <= F.col(at)) & (F.col("ended_us").isNull() | (F.col(at) < F.col("ended_us")))
    return rows.join(near, (F.col(by) == F.col("by_")) & (F.col("range_") == F.col("filed_")) & (F.col("whole_") | inside), how)


def _slices(array: str, size: int) -> Column:
    """A list, not empty, in pieces of at most size."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(array) / size).cast("int") - 1), lambda i: F.slice(array, i * size + 1, F.lit(size)))


def _listed(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows that follow each other with the same keys, as lists rows_ of at most size."""
    columns = [c for c in rows.columns if c not in keys]
    item = StructType([rows.schema[c] for c in columns])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = np.ones(n, bool)
            first[1:] = np.any([pc.not_equal(batch[k].slice(1), batch[k].slice(0, n - 1)).fill_null(True).to_numpy(zero_copy_only=False) for k in keys], axis=0)
            starts = np.flatnonzero(first)
            place = np.arange(n) - np.repeat(starts, np.diff(starts, append=n))
            starts = np.flatnonzero(place % size == 0)
            items = pa.StructArray.from_arrays([batch[c] for c in columns], fields=[batch.schema.field(c) for c in columns])
            held = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([*[batch[k].take(pa.array(starts)) for k in keys], held], names=[*keys, "rows_"])

    return rows.mapInArrow(lists, StructType([*[rows.schema[k] for k in keys], StructField("rows_", ArrayType(item))]))


def _held_wholly(rows: DataFrame, held: DataFrame, at: str, by: str, columns: list[str], tasks: int) -> DataFrame:
    """columns of rows and change_no for each window that holds the row's whole range.

    The samples of a run and range are cut into blocks, each meets lists of the windows, and pairs come out tile by tile:
    for a few windows, each of a few samples with all of these. So values that follow each other repeat at short distance,
    and a row takes as little in a file however many windows there are.
    """
    group = Window.partitionBy(by, "range_")
    place = F.row_number().over(group.orderBy(at, *[c for c in columns if c != at])) - 1
    placed = rows.select(*columns, F.col(by).alias("of_"), "range_", F.floor(place / BLOCK_ROWS).cast("int").alias("block_"))
    blocks = _listed(placed, ["of_", "range_", "block_"], BLOCK_ROWS)
    lists = _listed(held.repartition("by_", "filed_").sortWithinPartitions("by_", "filed_"), ["by_", "filed_"], BLOCK_ROWS).select("by_", "filed_", F.col("rows_.change_no").alias("nos_"))
    nth = rows.select(by, "range_", (F.row_number().over(group.orderBy(F.lit(0))) - 1).alias("nth_")).where(F.col("nth_") % BLOCK_ROWS == 0)
    known = nth.select(F.col(by).alias("with_"), F.col("range_").alias("in_"), F.floor(F.col("nth_") / BLOCK_ROWS).cast("int").alias("part_"))
    lists = lists.join(known, (F.col("by_") == F.col("with_")) & (F.col("filed_") == F.col("in_"))).select("by_", "filed_", "part_", "nos_")
    same = (F.col("by_") == F.col("of_")) & (F.col("filed_") == F.col("range_")) & (F.col("part_") == F.col("block_"))
    both = lists.repartition(tasks, "by_", "filed_", "part_").join(blocks.repartition(tasks, "of_", "range_", "block_"), same)
    tiles = both.select("rows_", F.explode(_slices("nos_", TILE_WINDOWS)).alias("nos_")).select(F.explode(_slices("rows_", TILE_ROWS)).alias("rows_"), "nos_")
    return tiles.select(F.inline("rows_"), "nos_").select(*columns, F.explode("nos_").alias("change_no"))


def tag_changes(samples: DataFrame, changes: DataFrame, at: str = "at_us", by: str = "run_id") -> DataFrame:
    """samples with change_no and phase: a row for each of the run's change windows that holds the sample (during), or one row of baseline.

    changes: by, change_no, started_us, ended_us (exclusive; null: still open). Windows may be many, overlap and have any
    length. A range join by equality: time is cut into ranges of about RANGE_ROWS samples. A window is compared with the
    samples of the ranges in which it begins and ends; with those of the ranges between it is paired without a look. Pairs
    go nowhere else: what is shuffled is the samples, and a window's number for each range that it holds. A task holds a
    block of samples and a list of windows at a time, or the windows that begin or end in one run and range. Windows
    without length hold nothing. Samples without a time or a run are baseline; rows that repeat a sample are rows of
    their own.
    """
    columns = samples.columns
    rows, near, held, ranges = _by_ranges(samples, changes, at, by)
    joined = _beside_changes(rows, near, at, by, "left").where("whole_ IS NULL OR NOT whole_")
    edges = joined.select(*columns, "change_no", F.when(F.col("started_us").isNull(), "baseline").otherwise("during").alias("phase"))
    tasks = max(ranges, samples.sparkSession.sparkContext.defaultParallelism)
    return edges.unionByName(_held_wholly(rows, held, at, by, columns, tasks).withColumn("phase", F.lit("during")))


QUANTILES = {"p50": 0.5, "p99": 0.99, "p999": 0.999}


def quantiles(samples: DataFrame, by: list[str]) -> DataFrame:
    """Exact quantiles by group, with percentile_disc: the value of rank ceil(q n); 0 where nothing was measured.

    A group's distinct values are one buffer: for groups of bounded variety. quantiles_ranked has no such bound.
    """
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY took_us)")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return samples.groupBy(*by).agg(F.count("took_us").alias("n"), *[zero(rank(q)).alias(name) for name, q in QUANTILES.items()], zero(F.max("took_us")).alias("max"))


def quantiles_ranked(samples: DataFrame, by: list[str], width: int = 1024) -> DataFrame:
    """The same by counting: values are counted, counts are summed in ranges of width values, and running counts over the
    ranges tell which few ranges hold a rank; only these are looked into value by value.

    A group's rows are pre-aggregated by value, its values are dealt by range, and what is ordered in one task is its
    ranges, or the values of one range.
    """
    return quantiles_of_counts(samples.groupBy(*by, "took_us").agg(F.count("took_us").alias("c")), by, width)


def quantiles_of_counts(counts: DataFrame, by: list[str], width: int = 1024) -> DataFrame:
    """quantiles_ranked from counts c of values took_us by group; counts of parts may be added up before."""
    counts = counts.withColumn("__b", F.floor(F.col("took_us") / width))
    whole = Window.partitionBy(*by)
    ranges = counts.groupBy(*by, "__b").agg(F.sum("c").alias("s"), F.max("took_us").alias("m"))
    before = F.coalesce(F.sum("s").over(whole.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumns({"__before": before, "n": F.sum("s").over(whole)})
    rank = {name: F.ceil(F.lit(q) * F.col("n")) for name, q in QUANTILES.items()}
    holds = [(r > F.col("__before")) & (r <= F.col("__before") + F.col("s")) for r in rank.values()]
    asked = ranges.where(holds[0] | holds[1] | holds[2]).drop("s", "m")
    upto = F.sum("c").over(Window.partitionBy(*by, "__b").orderBy("took_us").rowsBetween(Window.unboundedPreceding, 0))
    keys = [*by, "__b"]
    other = asked.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "n", "__before")
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
    inside = counts.join(other, same).drop(*[f"__k{i}" for i in range(len(keys))])
    inside = inside.withColumn("__upto", upto + F.col("__before"))
    found = {name: F.when((F.col("__upto") >= r) & (r > F.col("__before")), F.col("took_us")) for name, r in rank.items()}
    least = inside.groupBy(*by, "__b").agg(*[F.min(c).alias(name) for name, c in found.items()])
    none = {name: F.lit(None).cast("long").alias(name) for name in QUANTILES}
    both = ranges.select(*by, "n", *none.values(), F.col("m").cast("long").alias("max")).unionByName(least.select(*by, F.lit(None).cast("long").alias("n"), *[F.col(c).cast("long").alias(c) for c in QUANTILES], F.lit(None).cast("long").alias("max")))
    return both.groupBy(*by).agg(F.max("n").alias("n"), *[F.coalesce(F.min(c), F.lit(0)).alias(c) for c in QUANTILES], F.coalesce(F.max("max"), F.lit(0)).alias("max"))


#: Samples of one class that a task of quantiles_by_change holds, and changes that go together.
PART_ROWS, BATCH = 65536, 4096


def _kth(values: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 1) of values at places low to high, for many queries at once; a query has sizes spans.

    Bit by bit from the top over the values' ranks: the values with a 0 go before those with a 1, in their order, and a
    query follows the side that holds its k-th.
    """
    known, a = np.unique(values, return_inverse=True)
    first, found = np.cumsum(sizes) - sizes, np.zeros(len(k), np.int64)
    for b in reversed(range(int(len(known) - 1).bit_length())):
        one = (a >> b) & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~one)))
        zl, zh = zeros[low], zeros[high]
        n = np.add.reduceat(zh - zl, first)
        up = k > n
        k, found = k - np.where(up, n, 0), found | (up.astype(np.int64) << b)
        each = np.repeat(up, sizes)
        low, high = np.where(each, zeros[-1] + low - zl, zl), np.where(each, zeros[-1] + high - zh, zh)
        a = np.concatenate((a[~one], a[one]))
    return known[found]


def quantiles_by_change(samples: DataFrame, changes: DataFrame, classes: list[str], at: str = "at_us", by: str = "run_id") -> DataFrame:
    """quantiles of tag_changes by (by, change_no, *classes), without the pairs, which may be the square of the samples.

    The samples of a run and class are cut by value into parts of bounded size. Each part counts for every change of
    its run how many samples lie in its windows, by places in the order of time; the counts of all parts tell which part
    holds a rank, and that part finds the value. What is shuffled is the samples, each change once for each part of its
    run, with its counts, and a row for each figure. Samples that no change holds have change_no null.
    """
    key = F.to_json(F.struct(by, *classes)).alias("key_")
    fractions = [i / RANGES for i in range(1, RANGES)]
    known = samples.where(F.col(by).isNotNull()).groupBy(by, *classes).agg(F.count("took_us").alias("n_"), F.count("*").alias("all_"), F.percentile_approx("took_us", fractions, 10000).alias("p_"))
    parts = F.least(F.lit(RANGES), F.greatest(F.lit(1), F.ceil(F.col("n_") / PART_ROWS))).cast("int")
    cut = lambda j: F.get("p_", F.floor(j * RANGES / parts).cast("int") - 1)
    known = known.withColumns({"parts_": parts, "nulls_": F.ceil((F.col("all_") - F.col("n_")) / PART_ROWS).cast("int")})
    known = known.withColumn("cuts_", F.when(F.col("parts_") > 1, F.transform(F.sequence(F.lit(1), F.col("parts_") - 1), cut)).otherwise(F.array().cast("array<bigint>"))).select(key, by, *classes, "parts_", "nulls_", "cuts_")

    # A value that is a cut more than once is dealt over the parts that it fills.
    below, upto = (F.size(F.filter("cuts_", f)) for f in (lambda c: c < F.col("took_us"), lambda c: c <= F.col("took_us")))
    deal = lambda n: F.pmod("deal_", F.greatest(n, F.lit(1)))
    part = F.when(F.col("took_us").isNull(), -1 - deal(F.col("nulls_"))).otherwise(below + deal(upto - below))
    dealt = samples.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(key, at, "took_us", F.hash(*samples.columns).alias("deal_")).join(known.select("key_", "nulls_", "cuts_"), "key_").select("key_", part.alias("part_"), F.col(at).alias("at_"), "took_us")

    span = F.struct(F.col("started_us").alias("s"), F.coalesce("ended_us", F.lit((1 << 63) - 1)).alias("e"))
    windows = changes.where(F.col(by).isNotNull() & F.col("started_us").isNotNull() & (F.col("ended_us").isNull() | (F.col("ended_us") > F.col("started_us")))).groupBy(by, "change_no").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    batches = F.ceil(F.count("*") / BATCH).alias("batches_")
    batched = windows.join(windows.groupBy(by).agg(batches), by).groupBy(by, F.pmod(F.hash("change_no"), F.col("batches_").cast("int")).alias("batch_")).agg(F.array_sort(F.collect_list(F.struct("change_no", "spans"))).alias("w_"))
    flat = lambda f: F.flatten(F.transform("w_", lambda w: F.transform(w["spans"], lambda x: x[f])))
    batched = batched.select(by, "batch_", F.transform("w_", lambda w: w["change_no"]).alias("nos"), F.transform("w_", lambda w: F.size(w["spans"])).alias("sizes"), flat("s").alias("starts"), flat("e").alias("ends"))
    of_key = known.select("key_", by, "parts_", "nulls_").join(batched, by).drop(by)
    asked = of_key.select("key_", "batch_", "sizes", "starts", "ends", F.explode(F.sequence(-F.col("nulls_"), F.col("parts_") - 1)).alias("part_"))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame()
        times, out = np.sort(left["at_"].to_numpy()), []
        for sizes, starts, ends in zip(right["sizes"], right["starts"], right["ends"]):
            n = np.searchsorted(times, ends) - np.searchsorted(times, starts)
            out.append(np.add.reduceat(n, np.cumsum(sizes) - sizes))
        return right[["key_", "part_", "batch_"]].assign(counts=pd.Series(out, index=right.index, dtype=object))

    both = ["key_", "part_"]
    counted = dealt.groupBy(*both).cogroup(asked.groupBy(*both)).applyInPandas(count, "key_ string, part_ int, batch_ int, counts array<long>")
    gathered = counted.groupBy("key_", "batch_").agg(F.array_sort(F.collect_list(F.struct("part_", "counts"))).alias("c_")).join(of_key, ["key_", "batch_"])
    gathered = gathered.select("key_", "nos", "sizes", "starts", "ends", F.col("c_.part_").alias("parts"), F.flatten("c_.counts").alias("counts"))
    shares = [*QUANTILES.values(), 1.0]

    def ranks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key_, nos, sizes, starts, ends, parts, counts in frame.itertuples(index=False):
                counts = np.reshape(counts, (len(parts), -1))
                value = parts >= 0
                upto = np.cumsum(np.where(value[:, None], counts, 0), axis=0)
                n, first = upto[-1], np.cumsum(sizes) - sizes
                place = np.full((len(shares), len(nos)), -1)
                k = np.stack([np.ceil(q * n).astype(np.int64) for q in shares])
                for q in range(len(shares)):
                    place[q] = np.where(n > 0, np.argmax(upto >= k[q], axis=0), -1)
                place[-1, (n == 0) & (counts.sum(axis=0) > 0)] = 0  # nothing but nulls: a row without values
                for at_part in np.unique(place[place >= 0]):
                    q, i = np.nonzero(place == at_part)
                    before = upto[at_part] - np.where(value[at_part], counts[at_part], 0)
                    own = np.concatenate([np.arange(first[x], first[x] + sizes[x]) for x in i]) if sizes.max() > 1 else i
                    yield pd.DataFrame({"key_": [key_], "part_": [parts[at_part]], "nos": [nos[i]], "q": [q], "k": [k[q, i] - before[i]], "n": [n[i]], "sizes": [sizes[i]], "starts": [starts[own]], "ends": [ends[own]]})

    no = changes.schema["change_no"].dataType.simpleString()
    wanted = gathered.mapInPandas(ranks, f"key_ string, part_ int, nos array<{no}>, q array<int>, k array<long>, n array<long>, sizes array<int>, starts array<long>, ends array<long>")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame()
        nos, q, k, n, sizes, starts, ends = (np.concatenate(right[c].to_list()) for c in ("nos", "q", "k", "n", "sizes", "starts", "ends"))
        took = np.zeros(len(nos), np.int64)
        some = n > 0
        if some.any():
            left = left.sort_values("at_", kind="stable")
            times = left["at_"].to_numpy()
            took = _kth(left["took_us"].to_numpy().astype(np.int64), np.searchsorted(times, starts), np.searchsorted(times, ends), sizes, k)
        return pd.DataFrame({"key_": right["key_"].iloc[0], "change_no": nos, "q": q, "n": n, "took_us": took})

    found = dealt.groupBy(*both).cogroup(wanted.groupBy(*both)).applyInPandas(find, f"key_ string, change_no {no}, q int, n long, took_us long")
    names = [*QUANTILES, "max"]
    figures = [F.coalesce(F.max(F.when(F.col("q") == i, F.col("took_us"))), F.lit(0)).alias(name) for i, name in enumerate(names)]
    held = found.groupBy("key_", "change_no").agg(F.max("n").alias("n"), *figures).join(known.select("key_", by, *classes), "key_").select(by, "change_no", *classes, "n", *names)
    rows, near, *_ = _by_ranges(samples, changes, at, by)
    free = quantiles_ranked(_beside_changes(rows, near, at, by, "left_anti").drop("range_"), [by, *classes])
    return held.unionByName(free.withColumn("change_no", F.lit(None).cast(no)))


def value_counts(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by, took_us, c): how often each value occurs; counts of parts, hours or shards add up to those of the whole."""
    return samples.groupBy(*by, "took_us").agg(F.count("took_us").alias("c"))


def overall(samples: DataFrame, instrument: str = INSTRUMENT) -> DataFrame:
    """Figures by (run, phase) without the instrument, class '', and by (run, phase, class) with it.

    Samples are read once, into counts of values by class; the counts then stand for their class and, but for the
    instrument's, for the whole.
    """
    return overall_of_counts(value_counts(samples, ["run_id", "phase", "class"]), instrument)


def overall_of_counts(counts: DataFrame, instrument: str = INSTRUMENT) -> DataFrame:
    """overall from value counts by (run, phase, class)."""
    each, whole = F.struct(F.col("class").alias("class"), F.lit(False).alias("__whole")), F.struct(F.lit("").alias("class"), F.lit(True).alias("__whole"))
    both = counts.select("run_id", "phase", "took_us", "c", F.explode(F.when(F.col("class") != instrument, F.array(each, whole)).otherwise(F.array(each))).alias("g"))
    by = ["run_id", "phase", "class", "__whole"]
    summed = both.select("run_id", "phase", "g.*", "took_us", "c").groupBy(*by, "took_us").agg(F.sum("c").alias("c"))
    return quantiles_of_counts(summed, by).drop("__whole")


def before_after(figures: DataFrame) -> DataFrame:
    """The two phases of each run side by side, with the during/baseline ratio of each quantile (null for a baseline of 0)."""
    aggs = [F.coalesce(F.max(F.when(F.col("phase") == p, F.col(c))), F.lit(0)).alias(f"{p}_{c}") for p in ("baseline", "during") for c in ("n", "p50", "p99", "p999", "max")]
    side = figures.groupBy("run_id").agg(*aggs)
    return side.withColumns({f"ratio_{c}": F.when(F.col(f"baseline_{c}") > 0, F.col(f"during_{c}") / F.col(f"baseline_{c}")) for c in ("p50", "p99", "p999", "max")})


def active_readings(activity: DataFrame, locks: DataFrame) -> DataFrame:
    """Active sessions with the event they wait for and the relation whose lock they wait for; '' for none."""
    waits = locks.where("not granted and locktype = 'relation'").select("sample_at", "pid", "relation").distinct()
    event = F.when(F.col("wait_event").isNull(), "").otherwise(F.concat_ws(":", "wait_type", "wait_event"))
    joined = activity.where("state = 'active'").join(waits, ["sample_at", "pid"], "left")
    return joined.select("reading_no", "run_id", event.alias("event"), F.coalesce("relation", F.lit("")).alias("relation"), "waiting_us")


def wait_attribution(readings: DataFrame, top: int = 4) -> DataFrame:
    """(run_id, rank, event, samples, share) of the events most waited for; the share is of all active readings.

    Totals come from the event counts, which are short, not from the readings.
    """
    counts = readings.groupBy("run_id", "event").agg(F.count("*").alias("samples"))
    total = F.sum("samples").over(Window.partitionBy("run_id"))
    shared = counts.withColumn("share", F.col("samples") / total).where("event <> ''")
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("samples"), "event"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= top)


def blocked_readings(readings: DataFrame) -> DataFrame:
    """(run_id, blocked, longest_us, longest_relation): readings that wait for a relation, and the longest wait; ties keep the first."""
    blocked = (F.col("event") != "") & (F.col("relation") != "")
    wait = blocked & (F.col("waiting_us") > 0)
    return readings.groupBy("run_id").agg(
        F.count_if(blocked).alias("blocked"),
        F.coalesce(F.max(F.when(wait, F.col("waiting_us"))), F.lit(0)).alias("longest_us"),
        F.coalesce(F.max_by(F.when(wait, F.col("relation")), F.when(wait, F.struct(F.col("waiting_us"), -F.col("reading_no")))), F.lit("")).alias("longest_relation"),
    )


def blocked_share(readings: DataFrame) -> DataFrame:
    """(run_id, blocked, other_waits, share): blocked readings of all that wait for something."""
    blocked = F.count_if((F.col("event") != "") & (F.col("relation") != ""))
    waits = F.count_if(F.col("event") != "")
    counted = readings.groupBy("run_id").agg(blocked.alias("blocked"), waits.alias("__waits"))
    other = F.greatest(F.col("__waits") - F.col("blocked"), F.lit(0))
    return counted.select("run_id", "blocked", other.alias("other_waits"), F.when(F.col("__waits") > 0, F.col("blocked") / (F.col("blocked") + other)).otherwise(0.0).alias("share"))


def _term_us(term: Column) -> Column:
    """Microseconds of one number with its unit."""
    scale = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.regexp_extract(term, f"^([0-9.]+)({_UNIT})$", 1).cast("double") * scale[F.regexp_extract(term, f"^([0-9.]+)({_UNIT})$", 2)]


def budget_terms(runs: DataFrame) -> DataFrame:
    """(run_id, term, limit_us, problem) of each run's budget text, `p99=50ms,max_block=1m30s`; empty text has no term.

    A duration is a sign, if any, and one or more decimal numbers, each with a unit; or 0. Limits are whole microseconds.
    """
    term = F.trim(F.col("part"))
    parts = runs.where(F.trim("budget") != "").select("run_id", F.explode(F.split("budget", ",")).alias("part")).withColumn("part", term)
    name, value = F.trim(F.split_part("part", F.lit("="), F.lit(1))), F.trim(F.expr("substr(part, instr(part, '=') + 1)"))
    size = F.aggregate(F.regexp_extract_all(value, F.lit(f"([0-9.]+(?:{_UNIT}))"), F.lit(1)), F.lit(0.0), lambda total, t: total + _term_us(t))
    whole = value.rlike(rf"^[-+]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:{_UNIT}))+$")
    exact = F.when(whole, F.when(value.startswith("-"), -size).otherwise(size)).when(value.rlike("^[-+]?0$"), 0.0)
    limit = F.floor(exact).cast("long")
    bad = (
        F.when(F.instr("part", "=") == 0, "not name=duration")
        .when(exact.isNull(), "not a duration")
        .when(exact <= 0, "a limit must be positive")
        .when(~name.isin(*TERMS), "unknown term")
        .otherwise("")
    )
    return parts.select("run_id", F.when(F.instr("part", "=") == 0, F.col("part")).otherwise(name).alias("term"), F.when(bad == "", limit).alias("limit_us"), bad.alias("problem"))


def violations(figures: DataFrame, blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """(run_id, term, allowed_us, reached_us) of limits exceeded in the during phase."""
    during = figures.where("phase = 'during' and class = ''").join(blocks.select("run_id", F.col("longest_us").alias("max_block")), "run_id", "full_outer")
    reached = during.select("run_id", *[F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t) for t in TERMS]).unpivot("run_id", list(TERMS), "term", "reached_us")
    return terms.where("problem = ''").join(reached, ["run_id", "term"]).where("reached_us > limit_us").select("run_id", "term", F.col("limit_us").alias("allowed_us"), "reached_us")


def verdict(runs: DataFrame, exceeded: DataFrame) -> DataFrame:
    """(run_id, n_violations, failed): a run fails by any violation, or when its change could not be applied."""
    n = exceeded.groupBy("run_id").agg(F.count("*").alias("n"))
    return runs.join(n, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n_violations"), ((F.coalesce("n", F.lit(0)) > 0) | ~F.col("applied")).alias("failed"))


def coverage_check(runs: DataFrame, samples: DataFrame, instrument: str = INSTRUMENT) -> DataFrame:
    """(run_id, problem) of runs that must not be judged: without the instrument, or without samples in a phase."""
    seen = samples.groupBy("run_id").agg(F.count_if(F.col("class") == instrument).alias("i"), F.count_if(F.col("phase") == "baseline").alias("b"), F.count_if(F.col("phase") == "during").alias("d"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    found = F.array_compact(F.array(F.when(none("i"), "no slow reader"), F.when(none("b"), "nothing measured in baseline"), F.when(none("d"), "nothing measured in during")))
    return runs.join(seen, "run_id", "left").select("run_id", F.explode(found).alias("problem"))
