"""A. Resumable keyed backfill: rewrite the rows of a huge table in key slices that can be stopped and resumed."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the pacing rule: batch sizes, target time, growth.
MIN_BATCH, MAX_BATCH, FIRST_BATCH, TARGET_MS = 100, 50_000, 1000, 500


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    """(low, high); both null if there is no key. Null keys are never covered."""
    return df.agg(F.min(key).alias("low"), F.max(key).alias("high"))


def footer_bounds(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(low, high) of a stored column from the footers of its Parquet files: no row is read.

    The aggregate is pushed into the reader, in a session of its own whose settings allow that. key is a column of
    the files, not an expression, of a type that footers keep bounds of (numbers, dates; not texts). Fails when run if
    a file with rows has no bounds, as one whose keys are all null: stored_bounds then reads the column.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return key_bounds(own.read.parquet(path), key)


def stored_bounds(spark: SparkSession, path: str, key: str) -> tuple:
    """(low, high) from the footers, or from the column itself where a footer has no bounds."""
    try:
        return tuple(footer_bounds(spark, path, key).first())
    except Exception as e:  # the reader's own error class is not public: it is known by what it says
        if "No min/max found" not in str(e):
            raise
        return tuple(key_bounds(spark.read.parquet(path), key).first())


def slice_no(key: str, start: Column, batch: int) -> Column:
    return F.floor((F.col(key) - start - 1) / F.lit(batch)).cast("long")


def slice_plan(df: DataFrame, key: str, batch: int, start: int | None = None) -> DataFrame:
    """df with slice_no and the half-open range (lo, hi] of each row's slice; start is one below the lowest key unless given.

    A first run's start is an aggregate joined to every row (one row, broadcast): no collect.
    """
    if start is None:
        low = df.agg((F.min(key) - 1).alias("__start"))
        df = df.join(F.broadcast(low))
    else:
        df = df.withColumn("__start", F.lit(start).cast("long"))
    no = slice_no(key, F.col("__start"), batch)
    lo = F.col("__start") + no * batch
    return df.withColumns({"slice_no": no, "lo": lo, "hi": lo + batch}).drop("__start")


def apply_slices(df: DataFrame, key: str, needs_work: Column, changes: dict[str, Column], lo: int, hi: int) -> DataFrame:
    """Rows in (lo, hi] that need work, rewritten; all others as they are. Applying it again changes nothing."""
    here = (F.col(key) > lo) & (F.col(key) <= hi) & needs_work
    return df.withColumns({c: F.when(here, new).otherwise(F.col(c)) for c, new in changes.items()})


def slice_counts(df: DataFrame, key: str, needs_work: Column, batch: int, start: int | None = None) -> DataFrame:
    """(slice_no, hi, rows_in_range, rows_touched) for each slice that has rows."""
    planned = slice_plan(df.withColumn("__work", needs_work).where(F.col(key).isNotNull()), key, batch, start)
    return planned.groupBy("slice_no", "hi").agg(F.count("*").alias("rows_in_range"), F.count_if("__work").alias("rows_touched"))


def progress(counts: DataFrame, job: list[str], wave: int = 1024) -> DataFrame:
    """counts with position and rows, the cumulative rows touched of the job.

    Sums run within waves of consecutive slices, then over the short table of waves, so that one giant job is no
    single task.
    """
    w = F.floor(F.col("slice_no") / wave)
    counts = counts.withColumn("__wave", w)
    inside = Window.partitionBy(*job, "__wave").orderBy("slice_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*job).orderBy("__wave").rowsBetween(Window.unboundedPreceding, -1)
    waves = counts.groupBy(*job, "__wave").agg(F.sum("rows_touched").alias("__sum"))
    waves = waves.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    own = counts.withColumn("__rows", F.sum("rows_touched").over(inside))
    return own.join(waves, [*job, "__wave"]).select(*job, "slice_no", F.col("hi").alias("position"), (F.col("__rows") + F.col("__before")).alias("rows"))


def resume_point(jobs: DataFrame, manifest: DataFrame, job: str) -> DataFrame:
    """(job, position, rows, resumed): the last committed position, else the job's start. jobs: job, start.

    Whether a checkpoint is there decides, not its value.
    """
    last = manifest.groupBy(job).agg(F.max("position").alias("p"), F.sum("n_rows").alias("r"), F.count("*").alias("n"))
    there = F.coalesce("n", F.lit(0)) > 0
    return jobs.join(last, job, "left").select(job, F.when(there, F.col("p")).otherwise(F.col("start")).alias("position"), F.coalesce("r", F.lit(0)).alias("rows"), there.alias("resumed"))


def remaining(df: DataFrame, needs_work: Column) -> DataFrame:
    """(remaining, done) over the whole table."""
    n = F.count_if(needs_work)
    return df.agg(n.alias("remaining"), (n == 0).alias("done"))


def cursor_audit(df: DataFrame, key: str, needs_work: Column, position: int) -> DataFrame:
    """(filled_above, unfilled_at_or_below): both are 0 if rows and cursor were committed together."""
    above = F.col(key) > position
    return df.agg(F.count_if(above & ~needs_work).alias("filled_above"), F.count_if(~above & needs_work).alias("unfilled_at_or_below"))


def next_size(size: Column, took_ms: Column, lag: Column, max_lag: Column) -> Column:
    """Batch size after a batch: halved when it was slow or the replicas are behind, else a quarter more; clamped."""
    hard = ((max_lag > 0) & (lag > max_lag)) | (took_ms > TARGET_MS)
    new = F.when(hard, F.floor(size / 2)).otherwise(F.floor(size * 5 / 4))
    return F.greatest(F.lit(MIN_BATCH), F.least(F.lit(MAX_BATCH), new)).cast("long")


def pacing_audit(log: DataFrame, first: int = FIRST_BATCH) -> DataFrame:
    """(job, batch_no, size, expected_size, pause_ms, ok): was each batch as large as the one before it implies."""
    w = Window.partitionBy("job").orderBy("batch_no")
    prior = {c: F.lag(c).over(w) for c in ("size", "took_ms", "lag_bytes", "max_lag_bytes")}
    log = log.withColumns({f"__{c}": v for c, v in prior.items()})
    start = max(MIN_BATCH, min(MAX_BATCH, first))
    expected = F.when(F.col("__size").isNull(), F.lit(start)).otherwise(next_size(*[F.col(f"__{c}") for c in ("size", "took_ms", "lag_bytes", "max_lag_bytes")]))
    behind = (F.col("max_lag_bytes") > 0) & (F.col("lag_bytes") > F.col("max_lag_bytes"))
    return log.select("job", "batch_no", "size", expected.cast("long").alias("expected_size"), F.when(behind, F.col("took_ms")).otherwise(0).cast("long").alias("pause_ms"), (F.col("size") == expected).alias("ok"))


def lag_by_source(replicas: DataFrame, by: list[str]) -> DataFrame:
    """Bytes that the furthest replica is behind; 0 where none reports."""
    return replicas.groupBy(*by).agg(F.coalesce(F.max(F.col("sent") - F.col("replay")), F.lit(0)).alias("lag_bytes"))


_MANIFEST = "wave long, position long, n_rows long, took_ms long"


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{out}/manifest/*")
    except AnalysisException:  # nothing is committed yet
        return spark.createDataFrame([], _MANIFEST)


def committed(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows of the waves that the manifest names; a wave directory without its row does not count."""
    waves = [f"{out}/wave={r.wave}" for r in _manifest(spark, out).select("wave").toLocalIterator()]
    return spark.read.schema(schema).parquet(*waves) if waves else spark.createDataFrame([], schema)


def run_backfill(
    spark: SparkSession, src: DataFrame, key: str, changes: dict[str, Column], needs_work: Column, batch: int, out: str, wave_slices: int = 1000, crash: Callable[[str, int], None] | None = None, bounds: tuple[int, int] | None = None
) -> DataFrame:
    """Rewrite src into out, wave by wave of consecutive slices, and return the rows that are committed.

    A wave is one job that writes wave=<n>/ by overwrite and counts on the way what it rewrites and what would still
    need work; then a manifest row, written whole, commits it. A run that
    was stopped begins after the last committed wave. Slices are independent, so those of a wave run in parallel; a
    range predicate on the key prunes row groups. The next wave's slices follow the pacing rule. Null keys are written
    with the last wave, unchanged. crash, for tests, is called before the data and before the manifest row of a wave.
    bounds: the lowest and highest key, where the caller knows them, as from stored_bounds.
    """
    low, high = bounds or key_bounds(src, key).first()
    done = _manifest(spark, out).agg(F.count("*"), F.max("position"), F.max("wave")).first()
    if low is None:
        return src.limit(0) if not done[0] else committed(spark, out, src.schema)
    position, wave = (done[1], done[2] + 1) if done[0] else (low - 1, 0)
    slices = wave_slices
    while position < high:
        hi = position + batch * slices
        last = hi >= high
        part = src.where((F.col(key) > position) & (F.col(key) <= hi) | (F.col(key).isNull() if last else F.lit(False)))
        if crash:
            crash("data", wave)
        began = time.time()
        before, after = Observation(), Observation()
        seen = part.observe(before, F.count_if(needs_work).alias("n"))
        rewritten = apply_slices(seen, key, needs_work, changes, position, hi).observe(after, F.count_if(needs_work & F.col(key).isNotNull()).alias("n"))
        rewritten.write.mode("overwrite").parquet(f"{out}/wave={wave}")
        took, touched = int(1000 * (time.time() - began)), before.get["n"]
        if after.get["n"]:
            raise RuntimeError("rows still need work after their slice was rewritten")
        if crash:
            crash("manifest", wave)
        spark.createDataFrame([(wave, hi, touched, took)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/{wave}")
        per_slice = took / slices
        slices = max(1, slices // 2) if per_slice > TARGET_MS else slices * 5 // 4
        position, wave = hi, wave + 1
    return committed(spark, out, src.schema)
