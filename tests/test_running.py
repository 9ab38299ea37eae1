"""Running figures of one hot key, cut into ranges, against the plain window."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablestate.operators import ledger, state
from tablestate.operators.running import running


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_running_is_the_window(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, -3, 0, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, at int, v int")
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w)})
    got = running(df, ["k"], F.floor(F.col("at") / width), ["at"], s=("sum", F.col("v")), m=("max", F.col("v")))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_one_resource(spark):
    """Overlaps of one resource's intervals in many runs of time, against all pairs."""
    rng = random.Random(4)
    rows = [(1, rng.choice("abc"), s := rng.randrange(1000), s + rng.choice([1, 30, 400])) for _ in range(120)]
    df = spark.createDataFrame(rows, "resource int, owner string, started long, ended long")
    want = []
    for a in rows:
        n = sum(b[1] != a[1] and b[3] > a[2] and (b[2], b[3], b[1]) < (a[2], a[3], a[1]) for b in rows)
        want += [(*a, n)] * (n > 0)
    assert sorted(map(tuple, ledger.overlapping_owners(df, 50).collect())) == sorted(want)


def test_one_database(spark):
    steps = spark.createDataFrame([(1, m, s, "ddl_tx", not (m == 40 and s == 1)) for m in range(60) for s in range(3)], "db int, migration_no int, step_no int, step_kind string, satisfied boolean")
    done = {(r.migration_no, r.step_no): r.pending for r in state.pending_steps(steps, steps.limit(0).withColumn("status", F.lit("")), ["db", "migration_no", "step_no"], 16).collect()}
    assert done == {(m, s): (m, s) >= (40, 1) for m in range(60) for s in range(3)}
    placed = ledger.step_order_and_numbering(steps, 16)
    assert {(r.migration_no, r.step_no): (r.position, r.total) for r in placed.collect()} == {(m, s): (3 * m + s + 1, 180) for m in range(60) for s in range(3)}
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "range_" in plan


def test_one_catalog(spark):
    """One database with most lines, repeats among them, and one with none in some sections, against plain Python."""
    rng = random.Random(9)
    rows = [(7, no, state.SECTIONS[no], f"x{rng.randrange(150):03d}é") for no in (0, 1, 1, 3) for _ in range(200)]
    rows += [(8, 5, state.SECTIONS[5], "z"), (8, 5, state.SECTIONS[5], "z"), (9, 2, state.SECTIONS[2], None)]
    lines = spark.createDataFrame(rows, "db long, section_no int, section string, line string")
    want = {}
    for db in (7, 8, 9):
        mine = sorted((no, line or "") for d, no, _, line in rows if d == db)
        want[db] = mine
    got = state.schema_describe(lines).collect()
    assert sorted((r.db, r.position, r.section_no, r.line or "") for r in got) == sorted((db, i + 1, *x) for db, mine in want.items() for i, x in enumerate(mine))
    digests = {r.db: r.sha256 for r in state.schema_fingerprint(lines.repartition(3)).collect()}
    for db, mine in want.items():
        text = "".join(f"[{name}]\n" + "".join(f"{x}\n" for no, x in mine if no == k and x) for k, name in enumerate(state.SECTIONS))
        assert digests[db] == hashlib.sha256(text.encode()).hexdigest()
    assert state.schema_fingerprint(lines.limit(0)).count() == state.schema_describe(lines.limit(0)).count() == 0


def test_neighbours(spark):
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "c"), (4, "a"), (5, "a"), (5, " ")], "db long, line string")
    assert sorted(map(tuple, state.neighbour_diffs(lines).collect())) == [(1, "+", "c"), (1, "-", "b"), (1, "-", "b")]
