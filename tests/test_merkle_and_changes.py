"""Trees of digests and many changes a run, against brute force on small tables."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablestate.operators import latency, merkle, state

ROW = "k string, j int, a string, b double"


def rows_of(rng, n):
    return [(rng.choice([None, f"k{i}"]) if i % 7 == 0 else f"k{i}", i % 5, rng.choice([None, "", "x", "null"]), float(i)) for i in range(n)]


def saved(spark, tmp_path, name, rows, buckets, fan=4):
    path = str(tmp_path / name)
    merkle.save_digested(spark.createDataFrame(rows, ROW), path, ["k", "j"], ["a", "b"], buckets, fan)
    return path


def plain(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_diff_is_row_diff(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    want = [r for r in rows_of(rng, 120) if r[0]]
    got = [r[:2] + ("y", r[3]) if i % 11 == 0 else r for i, r in enumerate(want) if i % 13] + [("new", 1, None, None)]
    a, b = saved(spark, tmp_path, "a", want, buckets), saved(spark, tmp_path, "b", got, buckets)
    direct = state.row_diff(spark.createDataFrame(want, ROW), spark.createDataFrame(got, ROW), ["k", "j"], ["a", "b"])
    assert plain(merkle.merkle_diff(spark, a, b, ["k", "j"], ["a", "b"], buckets, 4)) == plain(direct) != []


def test_one_changed_row_reads_one_bucket(spark, tmp_path):
    """Folders of all other buckets are taken away, and equal tables need none at all."""
    rows = [r for r in rows_of(random.Random(1), 200) if r[0]]
    a, same = saved(spark, tmp_path, "a", rows, 32), saved(spark, tmp_path, "same", rows[::-1], 32)
    b = saved(spark, tmp_path, "b", [(*rows[5][:3], -1.0) if i == 5 else r for i, r in enumerate(rows)], 32)
    trees = [spark.read.parquet(f"{p}/tree") for p in (a, b)]
    (hit,) = [r.bucket for r in merkle.unequal_buckets(*trees, 32, 4).collect()]
    for path in (a, b):
        for folder in Path(path, "rows").glob("part=*"):
            if folder.name != f"part={hit}":
                shutil.rmtree(folder)
    (r,) = merkle.merkle_diff(spark, a, b, ["k", "j"], ["a", "b"], 32, 4).collect()
    assert (r.k, r.j, r.kind, r.changed) == (*rows[5][:2], "changed", "b")
    assert merkle.unequal_buckets(trees[0], spark.read.parquet(f"{same}/tree"), 32, 4).count() == 0
    for folder in Path(same, "rows").glob("part=*"):
        shutil.rmtree(folder)
    assert merkle.merkle_diff(spark, a, same, ["k", "j"], ["a", "b"], 32, 4).count() == 0


def test_roots(spark):
    """Order does not matter; a repeat, a null for an empty text and a value moved between columns do."""
    def root(rows):
        t = merkle.tree(merkle.leaves(spark.createDataFrame(rows, ROW), ["k", "j"], ["a", "b"], 9), 9, 3).collect()
        top = [r for r in t if r.level == max(x.level for x in t)]
        return (len(top), top[0].digest, top[0].n_rows)

    rows = [("a", 1, "x", 1.0), ("b", 2, None, 2.0), (None, None, "", None)]
    n, digest, total = root(rows)
    assert (n, total) == (1, 3) and root(rows[::-1])[1] == digest
    others = [rows + rows[:1], [*rows[:2], (None, None, None, None)], [("a", 1, "1", None), *rows[1:]], rows[:2], [*rows, (None, None, "", None), (None, None, "", None)]]
    assert len({digest, *(root(o)[1] for o in others)}) == 6


def test_copies_and_empty_tables(spark, tmp_path):
    many, none = [("hot", 1, "x", 1.0)] * 500 + [("cold", 2, "y", 2.0)], []
    a, b, c = (saved(spark, tmp_path, n, r, 8) for n, r in (("a", many), ("b", many[:-1]), ("c", none)))
    assert [r.kind for r in merkle.merkle_diff(spark, a, b, ["k", "j"], ["a", "b"], 8, 4).collect()] == ["missing"]
    gone = merkle.merkle_diff(spark, a, c, ["k", "j"], ["a", "b"], 8, 4)
    assert gone.count() == 501 and merkle.merkle_diff(spark, c, c, ["k", "j"], ["a", "b"], 8, 4).count() == 0


def test_beyond_the_named_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "NAMED", 2)
    rows = [r for r in rows_of(random.Random(3), 60) if r[0]]
    a, b = saved(spark, tmp_path, "a", rows, 16), saved(spark, tmp_path, "b", rows[:30], 16)
    assert merkle.merkle_diff(spark, a, b, ["k", "j"], ["a", "b"], 16, 4).count() == len(rows) - 30


def test_many_changes_a_run(spark):
    """Windows of a microsecond to ten years, overlapping, touching, open and empty."""
    rng = random.Random(7)
    changes = [(rng.randrange(3), i, s := rng.randrange(-1000, 1 << rng.randrange(4, 50)), None if i % 9 == 0 else s + rng.choice([0, 1, 15, 16, 17, 4096, 1 << 20, 1 << 30, 1 << 45, 1 << 62])) for i in range(80)]
    edges = [x for c in changes for x in c[2:] if x is not None]
    samples = [(i, rng.randrange(4), rng.choice([x - 1, x, x + 1, rng.randrange(1 << 50)]), "k") for i, x in enumerate(rng.choices(edges, k=400))] + [(1000, None, 5, "k"), (1001, 1, None, "k")]
    df = spark.createDataFrame(samples, "sample_id int, run_id int, at_us long, change string")
    got = sorted((r.sample_id, r.change_no, r.phase) for r in latency.tag_changes(df, spark.createDataFrame(changes, "run_id int, change_no int, started_us long, ended_us long")).collect() if r.change_no is not None)
    hit = lambda s, c: s[1] == c[0] and s[2] is not None and c[2] <= s[2] and (c[3] is None or s[2] < c[3])
    assert got == sorted((s[0], c[1], "during") for s in samples for c in changes if hit(s, c)) != []
    all_ = latency.tag_changes(df, spark.createDataFrame(changes, "run_id int, change_no int, started_us long, ended_us long"))
    assert sorted(r.sample_id for r in all_.where("phase = 'baseline'").collect()) == sorted(s[0] for s in samples if not any(hit(s, c) for c in changes))
    none = spark.createDataFrame([], "run_id int, change_no int, started_us long, ended_us long")
    assert latency.tag_changes(df, none).where("phase = 'baseline'").count() == len(samples)
    plan = all_._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_of_changes_are_not_shuffled(spark, monkeypatch):
    """Many ranges, long windows and repeated samples: every pair comes out, and no aggregate gathers pairs again."""
    monkeypatch.setattr(latency, "RANGE_ROWS", 5, raising=False)
    rng = random.Random(11)
    changes = [(i % 2, i, s := rng.randrange(900), None if i % 3 == 0 else s + rng.randrange(400)) for i in range(60)]
    samples = [(i, i % 3, rng.choice([7, rng.randrange(1000)])) for i in range(300)] * 2 + [(900, None, 5), (901, 1, None)]
    df = spark.createDataFrame(samples, "sample_id int, run_id int, at_us long")
    tagged = latency.tag_changes(df, spark.createDataFrame(changes, "run_id int, change_no int, started_us long, ended_us long"))
    hit = lambda s, c: s[1] == c[0] and s[2] is not None and c[2] <= s[2] and (c[3] is None or s[2] < c[3])
    want = [(s[0], c[1]) for s in samples for c in changes if hit(s, c)] + [(s[0], -1) for s in samples if not any(hit(s, c) for c in changes)]
    assert sorted((r.sample_id, -1 if r.change_no is None else r.change_no) for r in tagged.collect()) == sorted(want)
    assert "Aggregate" not in tagged._jdf.queryExecution().optimizedPlan().toString()


def test_a_written_pair_takes_little_however_many_windows(spark, tmp_path, monkeypatch):
    """A row in a file does not grow with the windows that hold a sample: 20,000 of them, and 4 ranges of 80 samples."""
    monkeypatch.setattr(latency, "RANGE_ROWS", 80)
    windows = spark.range(20_000).selectExpr("1L AS run_id", "id * 201 AS change_no", "id AS started_us", "CAST(NULL AS BIGINT) AS ended_us")
    samples = spark.range(-80, 320).selectExpr("id AS sample_id", "IF(id < 0, 2L, 1L) AS run_id", "30000 + id AS at_us")
    tagged = latency.tag_changes(samples, windows)
    tagged.write.parquet(path := str(tmp_path / "out"), compression="snappy")
    got = spark.read.parquet(path).groupBy("run_id", "phase").agg(F.count("*"), F.sum("sample_id"), F.sum("change_no")).collect()
    assert set(map(tuple, got)) == {(1, "during", 6_400_000, 20_000 * 320 * 319 // 2, 320 * 201 * 20_000 * 19_999 // 2), (2, "baseline", 80, -80 * 81 // 2, None)}
    assert sum(f.stat().st_size for f in Path(path).rglob("*.parquet")) < 0.5 * 6_400_000


def test_blocks_and_tiles_of_pairs(spark, monkeypatch):
    """Lists that do not come out even, one moment with many samples, windows that repeat, have no number or hold every range."""
    for name, n in (("RANGE_ROWS", 9), ("BLOCK_ROWS", 8), ("TILE_ROWS", 3), ("TILE_WINDOWS", 2)):
        monkeypatch.setattr(latency, name, n, raising=False)
    rng = random.Random(3)
    changes = [(rng.choice(["a", "b"]), i, s := rng.randrange(-50, 900), rng.choice([None, s, s + 3, s + rng.randrange(1, 1500)])) for i in range(70)]
    changes += [("a", 5, -9, None), ("a", 5, -9, None), ("b", None, 10, 700), ("c", 7, 0, None), (None, 8, 0, None), ("a", 9, None, 5)]
    samples = [(i, rng.choice(["a", "a", "b", "c", "d", None]), rng.choice([500, 500, None] + [rng.randrange(1000)] * 5)) for i in range(350)] * 2
    tagged = latency.tag_changes(spark.createDataFrame(samples, "sample_id int, run_id string, at_us long"), spark.createDataFrame(changes, "run_id string, change_no int, started_us long, ended_us long"))
    hit = lambda s, c: None not in (s[1], s[2], c[2]) and s[1] == c[0] and c[2] <= s[2] and (c[3] is None or s[2] < c[3])
    want = [(*s, c[1], "during") for s in samples for c in changes if hit(s, c)] + [(*s, None, "baseline") for s in samples if not any(hit(s, c) for c in changes)]
    assert plain(tagged.select("sample_id", "run_id", "at_us", "change_no", "phase").rdd.map(tuple)) == sorted(map(repr, want))


@pytest.mark.parametrize("rows", [3, 64])
def test_quantiles_by_change_without_pairs(spark, monkeypatch, rows):
    """Parts and batches of any size, a frequent value, nulls, windows that repeat a change: the figures of tag_changes."""
    monkeypatch.setattr(latency, "PART_ROWS", rows)
    monkeypatch.setattr(latency, "BATCH", 7)
    monkeypatch.setattr(latency, "RANGE_ROWS", 50)
    rng = random.Random(5)
    changes = [(i % 2, i % 37, s := rng.randrange(900), None if i % 5 == 0 else s + rng.randrange(300)) for i in range(40)] + [(0, 90, 2000, 2001), (0, 91, None, 5), (1, 92, 5, 5), (None, 93, 0, None)]
    samples = [(i, rng.choice([0, 0, 1, 2, None]), rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(1000)] + [rng.randrange(1000)] * 8), rng.choice([None, 7, 7, 7, 8, rng.randrange(-50, 5000)])) for i in range(500)]
    samples += [(1000 + i, 0, "nulls", 950 + i, None) for i in range(9)] + [(2000, 0, "once", 2000, 4)]
    df = spark.createDataFrame(samples, "sample_id int, run_id int, class string, at_us long, took_us long")
    windows = spark.createDataFrame(changes, "run_id int, change_no int, started_us long, ended_us long")
    want = latency.quantiles_ranked(latency.tag_changes(df, windows), ["run_id", "change_no", "class"])
    got = latency.quantiles_by_change(df, windows, ["class"])
    assert plain(got.select(*want.columns)) == plain(want)
    assert plain(latency.quantiles_by_change(df, windows.limit(0), ["class"]).select(*want.columns)) == plain(latency.quantiles_ranked(latency.tag_changes(df, windows.limit(0)), ["run_id", "change_no", "class"]))


def test_counts_add_up(spark):
    """Value counts of two halves give the figures of the whole."""
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 2, rng.choice(["baseline", "during"]), rng.choice(["a", "slow_read", ""]), rng.randrange(1, 9000)) for i in range(900)], "run_id int, phase string, class string, took_us long")
    by = ["run_id", "phase", "class"]
    halves = latency.value_counts(df.where("took_us % 2 = 0"), by).unionByName(latency.value_counts(df.where("took_us % 2 = 1"), by))
    assert plain(latency.overall_of_counts(halves)) == plain(latency.overall(df))
    whole = df.where(F.col("class") != "slow_read").groupBy("run_id", "phase").count()
    assert {(r.run_id, r.phase): r.n for r in latency.overall(df).where("class = ''").groupBy("run_id", "phase").agg(F.max("n").alias("n")).collect()} == {(r.run_id, r.phase): r["count"] for r in whole.collect()}


@pytest.mark.parametrize(
    "text,limit,problem",
    [
        ("1m30s", 90_000_000, ""), ("1h0.5s", 3_600_500_000, ""), (".5s", 500_000, ""), ("2.s", 2_000_000, ""), ("+3ms", 3000, ""), ("1.5µs", 1, ""), ("500ns", 0, ""),
        ("-1s", None, "a limit must be positive"), ("0", None, "a limit must be positive"), ("0s", None, "a limit must be positive"), ("5", None, "not a duration"), ("1m 30s", None, "not a duration"), ("s", None, "not a duration"), ("1.2.3s", None, "not a duration"), (".s", None, "not a duration"), ("", None, "not a duration"),
    ],
)
def test_durations(spark, text, limit, problem):
    r = latency.budget_terms(spark.createDataFrame([(1, f" p99 = {text} ")], "run_id int, budget string")).first()
    assert (r.term, r.limit_us, r.problem) == ("p99", limit, problem)
