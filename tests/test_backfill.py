import random

import pytest
from pyspark.sql import functions as F

from tablestate.operators import backfill as bf
from tablestate.operators import state

SCHEMA = "id long, legacy string, email string"


def work():
    return F.col("email").isNull()


def change():
    return {"email": F.col("legacy")}


def users(spark, keys):
    return spark.createDataFrame([(k, f"user_{k}", None if (k or 0) % 4 else "done") for k in keys], SCHEMA)


def checksum(df):
    return tuple(state.table_checksum(df, ["id", "legacy", "email"]).first())


class Killed(Exception):
    pass


@pytest.mark.parametrize("seed", range(3))
def test_killed_runs_converge(spark, tmp_path, seed):
    """Killed between data and manifest, or before a wave, a run resumes and ends as one that was never killed."""
    rng = random.Random(seed)
    keys = sorted({rng.randint(-400, 2000) for _ in range(300)}) + [None]
    src = users(spark, keys)
    golden = src.withColumn("email", F.when(work() & F.col("id").isNotNull(), F.col("legacy")).otherwise(F.col("email")))
    stop = {("data" if rng.random() < 0.5 else "manifest", rng.randint(0, 3)), ("manifest", rng.randint(1, 5))}

    def crash(point, wave):
        if (point, wave) in stop:
            stop.discard((point, wave))
            raise Killed

    out = str(tmp_path / "out")
    run = lambda: bf.run_backfill(spark, src, "id", change(), work(), 100, out, wave_slices=3, crash=crash)
    for _ in range(4):
        try:
            rows = run()
            break
        except Killed:
            done = bf.committed(spark, out, src.schema)
            last = bf._manifest(spark, out).agg(F.max("position")).first()[0]
            assert done.where(F.col("id").isNotNull() & work()).count() == 0
            assert last is None or done.where(F.col("id") > last).count() == 0
    assert checksum(rows) == checksum(golden)
    assert state.row_diff(golden.where("id is not null"), rows.where("id is not null"), ["id"], ["legacy", "email"]).count() == 0
    before = bf._manifest(spark, out).count()
    assert checksum(run()) == checksum(golden) and bf._manifest(spark, out).count() == before


def test_bounds_and_slices(spark):
    empty = users(spark, [])
    assert tuple(bf.key_bounds(empty, "id").first()) == (None, None)
    assert bf.run_backfill(spark, empty, "id", change(), work(), 10, "/nowhere").count() == 0
    rows = {r.id: r for r in bf.slice_plan(users(spark, range(-5, 6)), "id", 4).collect()}
    assert (rows[-5].slice_no, rows[-5].lo, rows[-5].hi) == (0, -6, -2)
    assert (rows[-2].slice_no, rows[-1].slice_no, rows[5].slice_no) == (0, 1, 2)
    once = bf.apply_slices(users(spark, range(10)), "id", work(), change(), 2, 6)
    assert checksum(once) == checksum(bf.apply_slices(once, "id", work(), change(), 2, 6))
    assert {r.id for r in once.where("email like 'user%'").collect()} == {3, 5, 6}


@pytest.mark.parametrize("case,want", [((1000, 501, 0, 0), 500), ((1000, 500, 0, 0), 1250), ((1000, 1, 11, 10), 500), ((1000, 1, 10, 10), 1250), ((1000, 1, 99, 0), 1250), ((101, 900, 0, 0), 100), ((45_000, 1, 0, 0), 50_000), ((1001, 1, 0, 0), 1251)])
def test_next_size(spark, case, want):
    df = spark.createDataFrame([case], "s long, t long, l long, m long")
    assert df.select(bf.next_size(F.col("s"), F.col("t"), F.col("l"), F.col("m"))).first()[0] == want


def test_resume_by_presence(spark):
    jobs = spark.createDataFrame([("a", -6), ("b", -6)], "job string, start long")
    manifest = spark.createDataFrame([("a", 0, 3)], "job string, position long, n_rows long")
    got = {r.job: (r.position, r.resumed) for r in bf.resume_point(jobs, manifest, "job").collect()}
    assert got == {"a": (0, True), "b": (-6, False)}  # a checkpoint of 0 is a checkpoint
