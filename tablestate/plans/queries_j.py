"""Queries of family J: the views written out as small files in time order, then read as streams until they are used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.tables import shared_folder
from ..streaming import streams
from .queries_af import _FOLD, _MICROS_SQL, change, micros, work
from .registry import Views, query

#: Steps in which an input arrives; each is one write by many tasks, of a file each: so many tasks at least and at most, of about so many rows.
_STEPS, _TASKS, _MOST, _ROWS = 6, 4, 128, 250_000
#: Where every row of a trigger is kept as state: so many rows of the larger input a trigger, from so few triggers up to so many.
_KEPT, _FEWEST, _FINEST = 2_000_000, 3, 600
#: State partitions of what keeps open windows and rows only: as many as cores, so many at least.
_PARTS = 8


def _folder(v: Views, name: str) -> str:
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def _steps(df: DataFrame, order: str, kept: bool = False) -> tuple[list, int]:
    """Values of a column that cut its rows into parts of about one size, and the files of a part. Parts: _STEPS, or if rows are kept as many as have _KEPT rows each."""
    fine, accuracy = (_FINEST, 20 * _FINEST) if kept else (_STEPS, 1000)
    shares = ", ".join(str(i / fine) for i in range(1, fine))
    r = df.select(F.expr(f"percentile_approx({order}, array({shares}), {accuracy})").alias("p"), F.count(order).alias("n")).first()
    parts = min(_FINEST, max(_FEWEST, -(-r.n // _KEPT))) if kept else _STEPS
    cuts = {r.p[round(i * fine / parts) - 1] for i in range(1, parts)} if r.p else set()
    return sorted(cuts), min(_MOST, max(_TASKS, -(-r.n // (parts * _ROWS))))


def _live(v: Views, df: DataFrame, order: str, name: str, per_trigger: int = 2, marker: dict | None = None, time: str | None = None, cuts: tuple[list, int] | None = None) -> DataFrame:
    """df as a stream of files in the order of a column, the files of some steps a trigger.

    A file source takes files by their time of change, so steps are written one after another, and a trigger takes the
    files of whole steps, however their tasks came to an end. The view is worked out once, into a folder for each step,
    from which the steps are written. marker: values of a last row, by its time (usually the order) a day after all others,
    that lets the watermark pass them; its other columns are null. cuts: of _steps, if they are not df's own.
    """
    time = time or order
    path, staged = _folder(v, name), _folder(v, f"{name}-steps")
    steps, tasks = cuts or _steps(df, order)
    step = F.lit(0)
    for low in steps:
        step = step + F.coalesce((F.col(order) >= F.lit(low)).cast("int"), F.lit(0))
    df.withColumn("step_", step).write.partitionBy("step_").parquet(staged)
    arrived = v.spark.read.schema(StructType([*df.schema.fields, StructField("step_", IntegerType())])).parquet(staged)
    there = sorted(r.step_ for r in arrived.select("step_").distinct().collect())
    for part in [v.spark.read.schema(df.schema).parquet(f"{staged}/step_={i}") for i in there] or [arrived.drop("step_")]:
        part.repartition(tasks).sortWithinPartitions(order).write.mode("append").parquet(path)  # dealt in turn, so that every task has a file
    if marker is not None:
        after = arrived.agg((F.max(time) + F.expr("INTERVAL 1 DAY")).alias(time))
        last = after.select(*[F.col(time) if f.name == time else F.lit(marker.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
        last.coalesce(1).write.mode("append").parquet(path)
    return v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger * tasks).parquet(path)


def _done(v: Views, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream writes. In append mode state is what is still open, whatever has come before: its stores, each committed in each trigger, do not follow the session's shuffle partitions."""
    key = "spark.sql.shuffle.partitions"
    before = v.spark.conf.get(key)
    if mode == "append":
        v.spark.conf.set(key, min(int(before), max(_PARTS, v.spark.sparkContext.defaultParallelism)))
    try:
        return streams.run_once(stream, _folder(v, "out"), _folder(v, "state"), mode)
    finally:
        v.spark.conf.set(key, before)


_TICK = "CAST(floor({} / 60000000) AS BIGINT)"
_LATENCY = f"""SELECT {_TICK.format(_MICROS_SQL.format('at_ts'))} AS minute, run_id, class, count(*) AS n, CAST(quantile_disc(took_us, 0.5) AS BIGINT) AS p50,
       CAST(quantile_disc(took_us, 0.99) AS BIGINT) AS p99, CAST(max(took_us) AS BIGINT) AS max FROM v_latencies GROUP BY ALL"""
#: A last row that comes out nowhere: its class and run are its own.
_LAST = {"run_id": -1, "class": "end", "took_us": 0}


def _minutes(v: Views) -> DataFrame:
    return _done(v, streams.stream_latency(_live(v, v.latencies, "at_ts", "latencies", marker=_LAST))).where("run_id <> -1")


@query(_LATENCY)
def j1_stream_latency(v: Views) -> DataFrame:
    return _minutes(v).select(F.floor(micros("window.start") / 60_000_000).cast("long").alias("minute"), "run_id", "class", "n", "p50", "p99", "max")


#: Microseconds by term.
_LIMITS = {"p50": 20_000, "p99": 60_000, "max": 90_000}


_OVER = " UNION ALL ".join(f"SELECT minute, run_id, class, '{t}' AS term, CAST({u} AS BIGINT) AS allowed_us, {t} AS reached_us FROM l WHERE {t} > {u}" for t, u in _LIMITS.items())


@query(f", l AS ({_LATENCY}) SELECT * FROM ({_OVER}) b WHERE class <> 'slow_read'")
def j1_budget_breaches(v: Views) -> DataFrame:
    found = streams.budget_breaches(_minutes(v), _LIMITS)
    return found.select(F.floor(micros("window.start") / 60_000_000).cast("long").alias("minute"), "run_id", "class", "term", "allowed_us", "reached_us")


_WAITS = """SELECT a.reading_no, a.run_id, a.sample_at, a.waiting_us, CASE WHEN a.wait_event IS NULL THEN '' ELSE a.wait_type || ':' || a.wait_event END AS event, coalesce(l.relation, '') AS relation FROM v_activity a
  LEFT JOIN (SELECT sample_at, pid, relation FROM v_locks WHERE NOT granted AND locktype = 'relation') l ON l.sample_at = a.sample_at AND l.pid = a.pid WHERE a.state = 'active'"""


def _samples(v: Views) -> tuple[DataFrame, DataFrame]:
    """Readings and locks as they arrive together: a trigger takes the same time of both, so that the join keeps the rows of two triggers at most, and a last row on either side lets both watermarks pass."""
    cuts = _steps(v.activity, "sample_at", kept=True)
    activity = _live(v, v.activity, "sample_at", "activity", 1, {"state": "active", "reading_no": -1, "pid": -1, "run_id": -1}, cuts=cuts)
    locks = _live(v, v.locks, "sample_at", "locks", 1, {"granted": False, "locktype": "relation", "pid": -1}, cuts=cuts)
    return activity, locks


def _waits(v: Views, *columns: str) -> DataFrame:
    """Readings as stream_waits gives them, all of them; columns: those that are kept and written."""
    return _done(v, streams.stream_waits(*_samples(v)).select(*(columns or ["*"]))).where("reading_no <> -1")


@query(f"SELECT reading_no, run_id, event, relation FROM ({_WAITS}) w")
def j2_stream_waits(v: Views) -> DataFrame:
    return _waits(v, "reading_no", "run_id", "event", "relation")


@query(f""", r AS ({_WAITS}), s AS (SELECT r.*, {_MICROS_SQL.format('sample_at')} AS us FROM r)
SELECT CAST((floor(us / 10000000) - k) * 10000000 AS BIGINT) AS started_us, run_id, event, count(*) AS samples, CAST(coalesce(max(CASE WHEN event <> '' AND relation <> '' THEN waiting_us END), 0) AS BIGINT) AS longest_us
  FROM s, (SELECT unnest(range(6)) AS k) w GROUP BY ALL""")
def j2_wait_windows(v: Views) -> DataFrame:
    path = _folder(v, "readings")
    _waits(v).write.parquet(path)
    readings = v.spark.read.parquet(path)
    live = _live(v, readings, "sample_at", "waits", marker={"run_id": -1, "event": "", "relation": ""})
    out = _done(v, streams.wait_windows(live.withWatermark("sample_at", "30 seconds")))
    return out.where("run_id <> -1").select(micros("window.start").alias("started_us"), "run_id", "event", "samples", F.col("longest_us").cast("long").alias("longest_us"))


@query(f""", r AS ({_WAITS}), s AS (SELECT r.*, {_MICROS_SQL.format('sample_at')} AS us FROM r),
w AS (SELECT CAST((floor(us / 10000000) - k) * 10000000 AS BIGINT) AS started_us, run_id, event, count(*) AS samples, CAST(coalesce(max(CASE WHEN event <> '' AND relation <> '' THEN waiting_us END), 0) AS BIGINT) AS longest_us
  FROM s, (SELECT unnest(range(6)) AS k) w GROUP BY ALL)
SELECT started_us, run_id, event, samples, samples / sum(samples) OVER (PARTITION BY started_us, run_id) AS share, longest_us FROM w""")
def j2_wait_shares(v: Views) -> DataFrame:
    """Join, windows and shares as one query over live inputs, with one checkpoint."""
    out = _done(v, streams.wait_shares(*_samples(v))).where("run_id <> -1")
    return out.select(micros("window.start").alias("started_us"), "run_id", "event", "samples", "share", F.col("longest_us").cast("long").alias("longest_us"))


@query(f"SELECT migration_no, step_no, status, attempts, error, checkpoint FROM ({_FOLD}) f")
def j3_stream_ledger(v: Views) -> DataFrame:
    out = _done(v, streams.stream_ledger(_live(v, v.ledger_events, "at_ts", "events")), "update")
    key = ["migration_no", "step_no"]
    last = F.max_by(F.struct("status", "attempts", "error", "checkpoint"), "batch")
    return out.groupBy(*key).agg(last.alias("s")).select(*key, "s.*")


_TTL_US = 600_000_000


def _fences_sql(kind: str) -> str:
    """Outcomes by the order of seq: writes by fence, the first fitting release of an epoch, what expires between."""
    return f""", h AS (SELECT seq, resource, owner, epoch, {_MICROS_SQL.format('at_ts')} AS at_us, {kind} AS kind FROM v_heartbeats),
t AS (SELECT *, max(epoch) FILTER (kind = 'beat') OVER (PARTITION BY resource ORDER BY seq) AS top FROM h),
first AS (SELECT resource, epoch, arg_min(owner, seq) AS taker FROM h WHERE kind = 'beat' GROUP BY ALL),
held AS (SELECT t.*, t.epoch = top AND t.owner = f.taker AS holds FROM t LEFT JOIN first f ON f.resource = t.resource AND f.epoch = t.top),
fits AS (SELECT r.resource, r.epoch, min(r.seq) AS seq FROM held r WHERE r.kind = 'release' AND r.holds
   AND r.at_us <= (SELECT max(w.at_us) FROM held w WHERE w.resource = r.resource AND w.epoch = r.epoch AND w.kind = 'beat' AND w.holds AND w.seq < r.seq) + {_TTL_US} GROUP BY ALL),
said AS (SELECT h.resource, h.seq, h.owner, h.epoch, h.at_us, CASE WHEN h.kind = 'release' THEN CASE WHEN f.seq = h.seq THEN 'released' ELSE 'refused' END WHEN coalesce(h.holds, FALSE) AND coalesce(h.seq < f.seq, TRUE) THEN 'accepted' ELSE 'refused' END AS outcome
  FROM held h LEFT JOIN fits f ON f.resource = h.resource AND f.epoch = h.epoch)
SELECT * FROM said UNION ALL SELECT resource, -1, owner, epoch, at_us + {_TTL_US}, 'expired' FROM (
SELECT *, lead(at_us) OVER (PARTITION BY resource ORDER BY seq) AS nxt FROM said WHERE outcome <> 'refused') a WHERE outcome = 'accepted' AND coalesce(nxt > at_us + {_TTL_US}, TRUE)"""


def _fenced(v: Views, beats: DataFrame) -> DataFrame:
    before = v.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        live = _live(v, beats, "seq", "beats", per_trigger=1, marker={"resource": -1, "seq": -1, "owner": "", "epoch": 0, "kind": "beat"}, time="at_ts")
        out = _done(v, streams.stream_stale_writers(live, _TTL_US // 1000))
    finally:
        v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.where("resource <> -1").select("resource", "seq", "owner", "epoch", micros("timestamp_micros(at_us)").alias("at_us"), "outcome")


@query(_fences_sql("'beat'"))
def j4_stream_stale_writers(v: Views) -> DataFrame:
    return _fenced(v, v.heartbeats.drop("kind"))


@query(_fences_sql("kind"))
def j4_stream_releases(v: Views) -> DataFrame:
    return _fenced(v, v.heartbeats)


@query("SELECT id, legacy, coalesce(filled, legacy) AS filled FROM v_backfill")
def j5_stream_backfill(v: Views) -> DataFrame:
    src = v.backfill
    out = _folder(v, "stream-backfill")
    streams.stream_backfill(_live(v, src, "id", "rows"), "id", change(), work(), out, _folder(v, "state")).awaitTermination()
    done = [f"{out}/batch={r.batch}" for r in v.spark.read.schema("batch long").parquet(f"{out}/manifest/*").toLocalIterator()]
    return v.spark.read.schema(src.schema).parquet(*done)


@query(f"""SELECT resource, owner, epoch, min(us) AS started_us, max(us) + 600000000 AS ended_us, count(*) AS beats FROM (
SELECT *, sum(fresh) OVER (PARTITION BY resource, owner, epoch ORDER BY us, seq) AS island FROM (
SELECT *, CASE WHEN coalesce(us - lag(us) OVER (PARTITION BY resource, owner, epoch ORDER BY us, seq) >= 600000000, TRUE) THEN 1 ELSE 0 END AS fresh FROM (
SELECT seq, resource, owner, epoch, {_MICROS_SQL.format('at_ts')} AS us FROM v_heartbeats) h) a) b GROUP BY resource, owner, epoch, island""")
def j6_session_ownership(v: Views) -> DataFrame:
    out = _done(v, streams.session_ownership(_live(v, v.heartbeats, "at_ts", "beats", marker={"resource": -1, "owner": "", "epoch": 0}), "10 minutes"))
    return out.where("resource <> -1").select("resource", "owner", "epoch", micros("start").alias("started_us"), micros("end").alias("ended_us"), "beats")
