"""Ownership with releases, batch and stream, against a walk through the rows one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tablestate.operators import ledger
from tablestate.streaming import streams

BEATS = "seq long, resource long, owner string, epoch long, at_us long, kind string"
TTL = 100


def walked(rows):
    """(owner, epoch, started, ended, beats, how) of each resource's rows in order."""
    out = []
    for resource in {r[1] for r in rows}:
        held = None  # owner, epoch, started, last, beats

        def close(end, how):
            out.append((resource, held[0], held[1], held[2], end, held[4], how))

        for _, _, owner, epoch, at, kind in sorted((r for r in rows if r[1] == resource), key=lambda r: (r[4], r[0])):
            if held and at > held[3] + TTL:
                close(held[3] + TTL, "expired")
                held = None
            if kind == "release":
                if held and held[:2] == [owner, epoch]:
                    close(at, "released")
                    held = None
            elif held and held[:2] == [owner, epoch]:
                held[3:] = [at, held[4] + 1]
            else:
                if held:
                    close(at, "lost")
                held = [owner, epoch, at, at, 1]
        if held:
            close(held[3] + TTL, "expired")
    return sorted(out)


def drawn(seed, n=300):
    rng, at, rows = random.Random(seed), 0, []
    for seq in range(n):
        at += rng.choice([0, 1, 20, 60, 100, 101, 150])
        rows.append((seq, rng.choice([1, 1, 2]), rng.choice("ab"), rng.randrange(2), at, rng.choice(["beat", "beat", "release", None])))
    return [(*r[:5], r[5] or "beat") for r in rows]


@pytest.mark.parametrize("run_us", [50, 10**9])
def test_intervals_with_releases(spark, run_us):
    """Within runs and across them, many releases repeated, stale or late."""
    rows = drawn(run_us)
    got = ledger.ownership_intervals(spark.createDataFrame(rows, BEATS), TTL, run_us)
    want = walked(rows)
    assert sorted(map(tuple, got.select("resource", "owner", "epoch", "started", "ended", "beats", "how").collect())) == want
    assert {w[-1] for w in want} == {"lost", "expired", "released"}


def test_stale_releases(spark):
    rows = [
        (1, 1, "a", 1, 0, "beat"),
        (2, 1, "b", 1, 10, "release"),
        (3, 1, "a", 2, 11, "release"),
        (4, 1, "a", 1, 20, "beat"),
        (5, 1, "a", 1, 30, "release"),
        (6, 1, "a", 1, 31, "release"),
        (7, 1, "a", 1, 300, "release"),
        (8, 2, "a", 1, 5, "release"),
    ]
    events = spark.createDataFrame(rows, BEATS)
    assert {r.seq: r.accepted for r in ledger.releases(events, TTL).collect()} == {2: False, 3: False, 5: True, 6: False, 7: False, 8: False}
    (r,) = ledger.ownership_intervals(events, TTL).collect()
    assert (r.owner, r.started, r.ended, r.beats, r.how) == ("a", 0, 30, 2, "released")


def outcomes(rows):
    """Outcomes of a stream's rows in the order of seq, and what expires between; all resources have ended by the end."""
    out = []
    for resource in {r[1] for r in rows}:
        epoch, owner, last, still = -1, None, 0, False
        for seq, _, who, e, at, kind in sorted(r for r in rows if r[1] == resource):
            if kind == "release":
                ok = still and (who, e) == (owner, epoch) and at <= last + TTL
                out.append((resource, seq, "released" if ok else "refused"))
                if ok:
                    still, owner = False, None
                continue
            if e > epoch:
                ok, taken = True, who
            else:
                ok, taken = (e == epoch and who == owner), owner
            if ok and still and at > last + TTL:
                out.append((resource, -1, "expired"))
            if ok:
                epoch, owner, last, still = e, taken, max(last, at) if still else at, True
            out.append((resource, seq, "accepted" if ok else "refused"))
        if still:
            out.append((resource, -1, "expired"))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 3])
def test_releases_in_a_stream(spark, tmp_path, files):
    """The same outcomes however many triggers the rows come in; a release leaves no timer behind."""
    rng, rows, at, epoch = random.Random(files), [], 0, 0
    for seq in range(90):
        at += rng.choice([1, 30, 60])
        epoch += rng.random() < 0.2
        rows.append((seq, rng.choice([1, 2]), rng.choice("aab"), max(0, epoch - (rng.random() < 0.2)), at, rng.choice(["beat", "beat", "release"])))
    df = spark.createDataFrame(rows, BEATS).select("seq", "resource", "owner", "epoch", "kind", F.expr("timestamp_micros(at_us * 1000)").alias("at_ts"))
    path = str(tmp_path / "in")
    for i in range(files):
        df.where(F.expr(f"seq DIV {-(-90 // files)} = {i}")).coalesce(1).write.mode("append").parquet(path)
    last = df.agg(F.expr("max(at_ts) + INTERVAL 1 DAY").alias("at_ts")).selectExpr("-1L AS seq", "-1L AS resource", "'' AS owner", "0L AS epoch", "'beat' AS kind", "at_ts")
    last.coalesce(1).write.mode("append").parquet(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = streams.run_once(streams.stream_stale_writers(live, TTL), str(tmp_path / "out"), str(tmp_path / "state")).where("resource > 0").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = outcomes(rows)
    assert sorted((r.resource, r.seq, r.outcome) for r in out) == want
    assert {w[2] for w in want} == {"accepted", "refused", "released", "expired"}
