"""J. The same results on live inputs, as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from ..operators.backfill import apply_slices
from ..operators.latency import INSTRUMENT
from ..operators.ledger import ledger_fold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_latency(samples: DataFrame, late: str = "30 seconds", width: str = "1 minute") -> DataFrame:
    """Exact quantiles by window, run and class, emitted when the watermark passes a window. State: value counts of open windows."""
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY took_us)").cast("long")
    grouped = samples.withWatermark("at_ts", late).groupBy(F.window("at_ts", width), "run_id", "class")
    return grouped.agg(F.count("*").alias("n"), rank(0.5).alias("p50"), rank(0.99).alias("p99"), F.max("took_us").alias("max"))


def budget_breaches(windows: DataFrame, limits: dict[str, int], instrument: str = INSTRUMENT) -> DataFrame:
    """Windows of stream_latency over a limit (microseconds by term), one row for each term."""
    each = [F.when(F.col(t) > v, F.struct(F.lit(t).alias("term"), F.lit(v).cast("long").alias("allowed_us"), F.col(t).alias("reached_us"))) for t, v in limits.items()]
    return windows.where(F.col("class") != instrument).select("window", "run_id", "class", F.explode(F.array_compact(F.array(*each))).alias("b")).select("window", "run_id", "class", "b.*")


def stream_waits(activity: DataFrame, locks: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Active readings with the relation they wait for: a stream-stream left join on the sample, bounded by both watermarks."""
    event = F.when(F.col("wait_event").isNull(), "").otherwise(F.concat_ws(":", "wait_type", "wait_event"))
    a = activity.withWatermark("sample_at", late).where("state = 'active'").select("reading_no", "run_id", "sample_at", "pid", event.alias("event"), "waiting_us")
    k = locks.withWatermark("sample_at", late).where("not granted and locktype = 'relation'").select(F.col("sample_at").alias("__at"), F.col("pid").alias("__pid"), "relation")
    joined = a.join(k, (F.col("sample_at") == F.col("__at")) & (F.col("pid") == F.col("__pid")), "left")
    return joined.select("reading_no", "run_id", "sample_at", "event", F.coalesce("relation", F.lit("")).alias("relation"), "waiting_us")


def wait_windows(readings: DataFrame, width: str = "1 minute", step: str = "10 seconds") -> DataFrame:
    """Sliding windows of readings: samples of each event, all samples being the sum over events, and the longest block."""
    blocked = (F.col("event") != "") & (F.col("relation") != "")
    return readings.groupBy(F.window("sample_at", width, step), "run_id", "event").agg(F.count("*").alias("samples"), F.coalesce(F.max(F.when(blocked, F.col("waiting_us"))), F.lit(0)).alias("longest_us"))


def wait_shares(activity: DataFrame, locks: DataFrame, late: str = "30 seconds", width: str = "1 minute", step: str = "10 seconds") -> DataFrame:
    """(window, run_id, event, samples, share, longest_us) in one query: readings join locks, sliding windows count events, totals make shares.

    Three stateful operators in a chain, the watermark of the joined readings going through all of them: a window comes
    out when no reading of it can come any more, nor a lock for one. share is of all active readings of the window,
    those that wait for nothing (event '') among them. State: readings and locks of the lateness, counts of open windows
    by event, and for a window's totals one entry for each of its events.
    """
    counts = wait_windows(stream_waits(activity, locks, late), width, step)
    whole = counts.groupBy("window", "run_id").agg(F.sum("samples").alias("all"), F.collect_list(F.struct("event", "samples", "longest_us")).alias("each"))
    return whole.select("window", "run_id", "all", F.explode("each").alias("e")).select("window", "run_id", "e.event", "e.samples", (F.col("e.samples") / F.col("all")).alias("share"), "e.longest_us")


def stream_ledger(events: DataFrame) -> DataFrame:
    """Current row of each step, in update mode; events out of order lose by seq."""
    return ledger_fold(events)


def stream_stale_writers(writes: DataFrame, ttl_ms: int, late: str = "30 seconds") -> DataFrame:
    """Each write as accepted or refused when it arrives, each release as released or refused, and the end of ownership by timeout (outcome expired, seq -1).

    Needs the RocksDB state store. State by resource: highest epoch, its owner and expiry, with an event-time timer.
    writes: seq, resource, owner, epoch, at_ts and, if there are releases among them, kind. Columns: resource, seq,
    owner, epoch, at_us, outcome; at_us is the row's time, or for expired the last accepted write's plus the time to
    live. An ownership expires when no write of its own is accepted in that time, whether the next write or the
    watermark shows it. A release (kind 'release') by the holder, with its epoch and before it expires, ends the
    ownership and cancels its timer: no write of that epoch is accepted after it. Any other release is refused and
    changes nothing. Rows of one resource that come together are taken in the order of seq; a row later than `late`
    behind the newest is dropped and counted by Spark.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    ttl_us, columns = ttl_ms * 1000, ["resource", "seq", "owner", "epoch", "at_us", "outcome"]
    least = -(1 << 62)

    class Fence(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", "epoch long, owner string, last long, open boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            df = pd.concat(rows).sort_values("seq", kind="stable", ignore_index=True)
            epoch, owner, last, still = self.held.get() if self.held.exists() else (least, None, 0, False)
            write = df["kind"] != "release"
            # Runs of equal (highest epoch written so far) have one owner: the writer of the first row that has that epoch.
            top = df["epoch"].where(write, least).cummax().clip(lower=epoch)
            taker = df["owner"].where(top > top.shift(fill_value=epoch)).ffill()
            taker = taker.where(top > epoch, owner)
            holds = (df["epoch"] == top) & (df["owner"] == taker)
            us = df["us"]
            # A release ends its epoch: the first one in time after the epoch's last accepted write.
            seen = us.where(holds & write).groupby(top).cummax().groupby(top).ffill()
            carried = last if still else least
            seen = seen.where(top > epoch, seen.fillna(carried)).fillna(least)
            fits = holds & ~write & (us <= seen + ttl_us)
            ends = fits & (fits.groupby(top).cumsum() == 1)
            before = ends.groupby(top).cumsum() - ends
            ok = holds & write & (before == 0)
            outcome = pd.Series("refused", index=df.index).mask(ok, "accepted").mask(ends, "released")
            out = pd.DataFrame({"resource": key[0], "seq": df["seq"], "owner": df["owner"], "epoch": df["epoch"], "at_us": us, "outcome": outcome})
            mine = pd.DataFrame({"epoch": top, "owner": taker, "at_us": us, "free": ends})[ok | ends]
            if still:
                mine = pd.concat([pd.DataFrame({"epoch": [epoch], "owner": [owner], "at_us": [last], "free": [False]}), mine], ignore_index=True)
            mine["at_us"] = mine["at_us"].cummax()
            ended = mine[~mine["free"] & (mine["at_us"].shift(-1) > mine["at_us"] + ttl_us)]
            gone = pd.DataFrame({"resource": key[0], "seq": -1, "owner": ended["owner"], "epoch": ended["epoch"], "at_us": ended["at_us"] + ttl_us, "outcome": "expired"})
            if len(mine):
                last, still = int(mine["at_us"].iloc[-1]), not mine["free"].iloc[-1]
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if still:
                self.handle.registerTimer((last + ttl_us) // 1000 + 1)
            if len(df):
                epoch, owner = int(top.iloc[-1]), taker.iloc[-1]
                if ends[top == epoch].any():
                    owner = None  # an epoch that was released has no owner any more
            self.held.update((epoch, owner, last, bool(still)))
            yield pd.concat([out, gone])[columns].astype({"resource": "int64", "seq": "int64", "epoch": "int64", "at_us": "int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            epoch, owner, last, _ = self.held.get()
            self.held.update((epoch, owner, last, False))
            yield pd.DataFrame([(key[0], -1, owner, epoch, last + ttl_us, "expired")], columns=columns)

        def close(self) -> None:
            pass

    kind = F.coalesce(F.col("kind"), F.lit("beat")) if "kind" in writes.columns else F.lit("beat")
    keyed = writes.withColumns({"us": F.unix_micros(F.col("at_ts").cast("timestamp")), "kind": kind}).withWatermark("at_ts", late).groupBy("resource")
    return keyed.transformWithStateInPandas(Fence(), "resource long, seq long, owner string, epoch long, at_us long, outcome string", "Append", "EventTime")


def stream_backfill(rows: DataFrame, key: str, changes: dict[str, Column], needs_work: Column, out: str, checkpoint: str) -> StreamingQuery:
    """Newly arriving rows get the backfill's rewrite; a micro-batch's rows and then its manifest row are written by overwrite.

    A batch that is replayed writes the same files again, so each row counts once.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        fixed = apply_slices(df, key, needs_work, changes, -(1 << 63), (1 << 63) - 1)
        fixed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        n = df.sparkSession.createDataFrame([(batch_id,)], "batch long")
        n.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/{batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_ownership(beats: DataFrame, gap: str, late: str = "30 seconds") -> DataFrame:
    """Heartbeats to holding sessions of (resource, owner, epoch), closed by a gap."""
    s = F.session_window("at_ts", gap)
    return beats.withWatermark("at_ts", late).groupBy(s, "resource", "owner", "epoch").agg(F.count("*").alias("beats")).select("resource", "owner", "epoch", "session_window.start", "session_window.end", "beats")


class LateRows(RuntimeError):
    """Rows came later than the watermark forgives and were dropped."""


def rows_dropped(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators have dropped as late, as far as its progress reports go back."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append", allow_late: bool = False) -> DataFrame:
    """Run a streaming DataFrame over what is there now and return what it wrote.

    In update mode each micro-batch's rows are kept under its number, in a column batch. Raises LateRows if rows were
    dropped as late, unless that is allowed.
    """
    schema = StructType(df.schema.fields)
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", out)
    else:
        schema = schema.add("batch", IntegerType())
        writer = df.writeStream.foreachBatch(lambda part, n: part.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    query = writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = rows_dropped(query)
    if dropped and not allow_late:
        raise LateRows(f"{dropped} rows came later than the watermark forgives")
    return df.sparkSession.read.schema(schema).parquet(out)
