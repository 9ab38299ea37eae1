"""Streams whose files come in another order than their rows, and ownership decided over several micro-batches."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tablestate.plans import queries_j
from tablestate.plans.registry import Views
from tablestate.sources.tables import shared_folder
from tablestate.streaming import streams

BEGIN = dt.datetime(2024, 1, 1)


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def live(spark, schema, files):
    """A stream that takes one list of rows a trigger, in the order given."""
    path = folder(spark, "live")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, df, **more):
    return streams.run_once(df, folder(spark, "out"), folder(spark, "state"), **more)


SAMPLES = "at_ts timestamp, run_id int, class string, took_us long"


def test_files_out_of_order_are_reported(spark):
    files = [[(BEGIN + dt.timedelta(minutes=10 * i + j), 1, "r", 10 * i + j) for j in range(3)] for i in range(4)]
    in_order = run(spark, streams.stream_latency(live(spark, SAMPLES, files)))
    assert sum(r.n for r in in_order.collect()) == 10  # the last two minutes are still open
    with pytest.raises(streams.LateRows):
        run(spark, streams.stream_latency(live(spark, SAMPLES, files[::-1])))
    some = run(spark, streams.stream_latency(live(spark, SAMPLES, files[::-1])), allow_late=True)
    assert sum(r.n for r in some.collect()) < 10


def test_budget_breaches(spark):
    rows = [(BEGIN, 1, "r", 5), (BEGIN, 1, "r", 50), (BEGIN, 1, "slow_read", 999), (BEGIN + dt.timedelta(hours=1), 1, "r", 1)]
    out = streams.budget_breaches(run(spark, streams.stream_latency(live(spark, SAMPLES, [rows]))), {"p50": 4, "max": 50})
    assert [(r["class"], r.term, r.allowed_us, r.reached_us) for r in out.collect()] == [("r", "p50", 4, 5)]


def test_wait_windows_slide(spark):
    schema = "sample_at timestamp, run_id int, event string, relation string, waiting_us long"
    rows = [(BEGIN + dt.timedelta(seconds=65), 1, "Lock:relation", "t", 7), (BEGIN + dt.timedelta(seconds=70), 1, "Lock:relation", "", 9), (BEGIN + dt.timedelta(hours=1), 2, "", "", 0)]
    df = live(spark, schema, [rows]).withWatermark("sample_at", "30 seconds")
    out = {(r.window.start - BEGIN).seconds: (r.samples, r.longest_us) for r in run(spark, streams.wait_windows(df)).where("run_id = 1").collect()}
    assert out == {10: (1, 7), 20: (2, 7), 30: (2, 7), 40: (2, 7), 50: (2, 7), 60: (2, 7), 70: (1, 0)}


@pytest.mark.parametrize("cut", [100, 3, 1])
def test_ownership_over_batches(spark, cut):
    """The same verdicts and expiries however the writes are dealt to micro-batches."""
    schema = "seq long, resource long, owner string, epoch long, at_ts timestamp"
    beats = [(1, "a", 1, 0), (2, "b", 1, 1), (3, "a", 1, 2), (4, "b", 2, 3), (5, "a", 1, 4), (6, "b", 2, 30), (7, "c", 3, 31), (8, "b", 2, 32), (9, "c", 3, 33)]
    rows = [(s, 7, o, e, BEGIN + dt.timedelta(minutes=m)) for s, o, e, m in beats] + [(10, 8, "z", 1, BEGIN + dt.timedelta(days=1))]
    stream = live(spark, schema, [rows[i : i + cut] for i in range(0, len(rows), cut)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        out = run(spark, streams.stream_stale_writers(stream, 600_000)).where("resource = 7").withColumn("minute", ((F.col("at_us") - F.lit(1_704_067_200_000_000)) / 60_000_000).cast("int")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted((r.seq, r.outcome) for r in out if r.seq > 0) == [(1, "accepted"), (2, "refused"), (3, "accepted"), (4, "accepted"), (5, "refused"), (6, "accepted"), (7, "accepted"), (8, "refused"), (9, "accepted")]
    assert sorted((r.minute, r.owner, r.epoch) for r in out if r.outcome == "expired") == [(13, "b", 2), (43, "c", 3)]


def test_live_input_is_worked_out_once(spark):
    """A view is read for its cuts and once more for all steps; steps come in order, nulls first, nothing is lost."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    at = F.when(F.col("id") % 50 > 0, (F.col("id") * 37 % 600)).alias("at")
    df = spark.range(600).select("id", at).mapInPandas(count, "id long, at long")
    live = queries_j._live(Views(spark, ""), df, "at", "once")
    assert seen.value == 2 * 600
    got = sorted((r.batch, r["at"], r.id) for r in streams.run_once(live, folder(spark, "out"), folder(spark, "state"), "update").where("at is not null").collect())
    assert sorted(r[2] for r in got) == [i for i in range(600) if i % 50] and [r[1] for r in got] == sorted(r[1] for r in got)
    none = queries_j._live(Views(spark, ""), spark.range(0).select("id", F.col("id").alias("at")), "at", "none")
    assert streams.run_once(none, folder(spark, "out"), folder(spark, "state")).count() == 0


def test_joined_inputs_are_bounded_by_trigger(spark, monkeypatch):
    """Triggers follow the rows, both sides of a join take the same time, and all rows come out."""
    monkeypatch.setattr(queries_j, "_KEPT", 100)
    events = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    kinds = ["view", "error", "signup", "click", "error"]
    rows = [(i, BEGIN + dt.timedelta(seconds=(i * 37 % 1000) * 20), i % 9, kinds[i % 5], 1.0, "") for i in range(1000)]
    sf = folder(spark, "sf")
    spark.createDataFrame(rows, events).write.parquet(f"{sf}/events.parquet")
    taken, seen = [], streams.rows_dropped
    monkeypatch.setattr(streams, "rows_dropped", lambda q: taken.extend(([s.numInputRows for s in p.sources], p.stateOperators[0].numRowsTotal) for p in q.recentProgress) or seen(q))
    got = queries_j.j2_stream_waits(Views(spark, sf)).collect()
    assert sorted(r.reading_no for r in got) == [i for i in range(1000) if i % 50]
    assert sorted(r.reading_no for r in got if r.relation) == [i for i in range(1000) if i % 5 in (1, 4) and i % 50]
    full = [sides for sides, _ in taken if max(sides) > 1]
    assert len(full) == 10 and max(max(s) for s in full) <= 110 and max(min(s) for s in full) <= 70
    assert max(kept for _, kept in taken) <= 2 * 170


def test_stores_of_open_rows_do_not_follow_shuffle_partitions(spark):
    """Append mode has as many state partitions as cores, eight at least; update mode, whose state is of all keys, has the session's."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    parts, seen = [], streams.rows_dropped
    try:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(streams, "rows_dropped", lambda q: parts.append(max(op.numShufflePartitions for p in q.recentProgress for op in p.stateOperators)) or seen(q))
            for mode in ("append", "update"):
                stream = live(spark, SAMPLES, [[(BEGIN, 1, "r", 5)], [(BEGIN + dt.timedelta(hours=1), 1, "r", 1)]])
                out = queries_j._done(Views(spark, ""), streams.stream_latency(stream), mode)
                assert out.count() == (1 if mode == "append" else 2)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts == [8, 40]
