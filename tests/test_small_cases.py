import random

import pytest
from pyspark.sql import functions as F

from tablestate.functions.scalars import humanize_bytes, humanize_duration, humanize_rows
from tablestate.operators import corpus, findings, hazards, latency, ledger, sizing, state
from tablestate.plans import catalog
from tablestate.plans.queries_af import micros
from tablestate.plans.registry import Views
from tablestate.sources.tables import read_tables, read_texts, write_report
from tablestate.streaming import streams


def test_quantiles_are_ranks(spark):
    rows = [("fast", 1000)] * 990 + [("fast", 1_000_000)] * 10
    df = spark.createDataFrame(rows, "class string, took_us long")
    for f in (latency.quantiles, latency.quantiles_ranked):
        r = f(df, ["class"]).first()
        assert (r.n, r.p50, r.p99, r.p999, r["max"]) == (1000, 1000, 1000, 1_000_000, 1_000_000)
    empty = latency.quantiles(df.limit(0), []).first()
    assert (empty.n, empty.p50, empty["max"]) == (0, 0, 0)


def test_instrument_is_left_out_overall(spark):
    rows = [(1, "during", "point_read", 1000)] * 100 + [(1, "during", "slow_read", 1_000_000)] * 100
    out = {r["class"]: r for r in latency.overall(spark.createDataFrame(rows, "run_id int, phase string, class string, took_us long")).collect()}
    assert (out[""].n, out[""]["max"], out["slow_read"]["max"]) == (100, 1000, 1_000_000)


def test_longest_block_keeps_the_first(spark):
    rows = [(1, 7, "Lock:relation", "a", 5), (2, 7, "Lock:relation", "b", 5), (3, 7, "IO:x", "", 99), (4, 7, "", "c", 99), (5, 8, "Lock:relation", "z", 0)]
    out = {r.run_id: r for r in latency.blocked_readings(spark.createDataFrame(rows, "reading_no long, run_id int, event string, relation string, waiting_us long")).collect()}
    assert (out[7].blocked, out[7].longest_us, out[7].longest_relation) == (2, 5, "a")
    assert (out[8].blocked, out[8].longest_us, out[8].longest_relation) == (1, 0, "")


def test_estimate_cases(spark):
    rates = spark.createDataFrame([(1, float(10 << 20), 1e9, float(5 << 20), 1e9, True), (2, float(1 << 20), 1.0, float(1 << 20), 1.0, True), (3, 0.0, 0.0, 1.0, 1.0, False)], "server int, rewrite_bytes double, rewrite_rows double, index_bytes double, index_rows double, known boolean")
    stats = spark.createDataFrame([("t", 100, 100 << 20), ("s", 100, 10 << 20), ("e", 0, 0)], "relation string, n_rows long, n_bytes long")
    work = spark.createDataFrame([(1, "t", 3), (1, "t", 4), (1, "t", 2), (1, "t", 1), (2, "s", 3), (3, "t", 3), (1, "e", 3), (1, "gone", 3)], "server int, relation string, duration int")
    out = [(r.server, r.relation, r.low_s) for r in sizing.estimate(work, stats, rates).collect()]
    assert sorted(x for x in out if x[2]) == [(1, "t", 7.5), (1, "t", 7.5), (1, "t", 15.0), (2, "s", 75.0)] and len(out) == 8


@pytest.mark.parametrize("f,value,want", [(humanize_rows, 999, "999"), (humanize_rows, 1_234_567, "1.2M"), (humanize_bytes, 340 << 30, "340.0 GB"), (humanize_bytes, 512, "512 B"), (humanize_duration, 2_280_000_000, "38m0s"), (humanize_duration, 1_250_000, "1.3s"), (humanize_duration, 3_600_000_000, "1h0m0s"), (humanize_duration, 59_990_000, "1m0s")])
def test_humanize(spark, f, value, want):
    assert spark.range(1).select(f(F.lit(value).cast("long"))).first()[0] == want


def test_fingerprint_and_diff(spark):
    lines = spark.createDataFrame([(1, 0, "columns", "a"), (1, 0, "columns", "b"), (2, 0, "columns", "b"), (2, 0, "columns", "a"), (3, 1, "indexes", "a"), (3, 0, "columns", "b")], "db long, section_no int, section string, line string")
    digest = {r.db: r.sha256 for r in state.schema_fingerprint(lines).collect()}
    assert digest[1] == digest[2] != digest[3]
    a, b = (spark.createDataFrame([(x,) for x in t], "line string") for t in (["x", "x", "y", " "], ["y", "y", "z"]))
    assert sorted((r.sign, r.line) for r in state.schema_diff(a, b).collect()) == [("+", "z"), ("-", "x"), ("-", "x")]


def test_checksum_minds_nulls_not_order(spark):
    make = lambda rows: tuple(state.table_checksum(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first())
    assert make([("x", None), ("y", "z")]) == make([("y", "z"), ("x", None)])
    assert make([("x", None)]) != make([("x", "null")]) != make([("x", "")])
    assert make([]) == (0, "0", "0")


def test_empty_step_and_unknown_kind_are_uninferable(spark):
    steps = spark.createDataFrame([(1, 0, 0, "ddl_tx"), (1, 0, 1, "ddl_notx"), (1, 0, 2, "ddl_tx")], "db int, migration_no int, step_no int, step_kind string")
    objects = spark.createDataFrame([(1, 0, 0, True), (1, 0, 0, None), (1, 0, 2, True)], "db int, migration_no int, step_no int, satisfied boolean")
    done = state.step_satisfied(steps, objects, ["db", "migration_no", "step_no"])
    assert {r.step_no: r.satisfied for r in done.collect()} == {0: None, 1: None, 2: True}
    assert [r.step_no for r in state.refused_steps(done).collect()] == [1]
    assert all(r.pending for r in state.pending_steps(done, None, ["db"]).collect())


def test_ledger_fold_ignores_arrival_order(spark):
    rows = [(1, 0, 3, "succeeded", "", None, 3), (1, 0, 1, "running", "", None, 1), (1, 0, 2, "checkpoint", "", 42, 2)]
    for order in (rows, rows[::-1]):
        r = ledger.ledger_fold(spark.createDataFrame(order, "migration_no int, step_no int, seq int, event string, error string, position long, at_ts int")).first()
        assert (r.status, r.attempts, r.started, r.finished, r.checkpoint) == ("succeeded", 1, 1, 3, 42)


def test_owner_and_epoch_must_both_match(spark):
    rows = [(1, "r", "a", 1), (2, "r", "b", 2), (3, "r", "a", 1), (4, "r", "a", 2), (5, "r", "b", 2)]
    out = ledger.stale_writer_filter(spark.createDataFrame(rows, "seq int, resource string, owner string, epoch int"))
    assert {r.seq: r.accepted for r in out.collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}


def logged_beats(rng, n, resources):
    """(seq, resource, owner, epoch, at_us) in the order of seq; times rise, now and then by more than the time to live."""
    at, out = 0, []
    for i in range(n):
        at += rng.choice([0, 1, 5, 5, 5, 40])
        out.append((i, rng.choice(resources), rng.choice("ab"), i // 25 - (rng.random() < 0.2), at))
    return out


@pytest.mark.parametrize("run", [1, 7, 1_000_000])
def test_fences_and_intervals_do_not_depend_on_runs(spark, run):
    """One resource has most of the rows; whatever the runs, verdicts and intervals are those of one pass in order."""
    beats = logged_beats(random.Random(3), 300, [1, 1, 1, 1, 2])
    df = spark.createDataFrame(beats, "seq long, resource long, owner string, epoch long, at_us long")
    top, taker, want = {}, {}, []
    for seq, r, owner, epoch, _ in beats:
        taker.setdefault((r, epoch), owner)
        top[r] = max(top.get(r, -9), epoch)
        want.append((seq, epoch == top[r] and owner == taker[r, epoch]))
    got = ledger.stale_writer_filter(df.select("seq", "resource", "owner", "epoch"), run)
    assert got.columns == ["seq", "resource", "owner", "epoch", "accepted"]
    assert sorted((r.seq, r.accepted) for r in got.collect()) == want
    spans, ttl = {1: [], 2: []}, 20
    for seq, r, owner, epoch, at in beats:
        last = spans[r][-1] if spans[r] else None
        if last and last[0] == owner and last[1] == epoch and at - last[3] <= ttl:
            last[3], last[4] = at, last[4] + 1
        else:
            spans[r].append([owner, epoch, at, at, 1])
    want = []
    for r, own in spans.items():
        for i, (owner, epoch, began, last, n) in enumerate(own):
            following = own[i + 1][2] if i + 1 < len(own) else None
            lost = following is not None and following <= last + ttl
            want.append((r, owner, epoch, began, following if lost else last + ttl, n, "lost" if lost else "expired"))
    assert sorted(map(tuple, ledger.ownership_intervals(df, ttl, run).collect())) == sorted(want)


def test_quantiles_by_ranges(spark):
    rng = random.Random(5)
    rows = [(g, None if rng.random() < 0.05 else int(rng.lognormvariate(6, 2)) - 3) for g in ("a", "a", "b", None) for _ in range(700)] + [("c", None), ("d", 7)]
    df = spark.createDataFrame(rows, "g string, took_us long")
    want = sorted(map(repr, latency.quantiles(df, ["g"]).collect()))
    for width in (1, 64, 1024, 1 << 40):
        assert sorted(map(repr, latency.quantiles_ranked(df, ["g"], width).collect())) == want


def test_overlaps(spark):
    rows = [("r", "a", 0, 100), ("r", "b", 10, 50), ("r", "a", 20, 30), ("r", "b", 100, 120)]
    out = ledger.overlapping_owners(spark.createDataFrame(rows, "resource string, owner string, started long, ended long")).collect()
    assert sorted((r.owner, r.started) for r in out) == [("a", 20), ("b", 10)]


ACTION = "repo int, migration_no int, step_no int, stmt_no int, action_no int, step_kind string, no_lock_timeout boolean, action_kind string, schema_name string, relation string, column_name string, referenced string, constraint_name string, type_name string, mods array<int>, concurrent boolean, not_valid boolean, if_exists boolean, has_where boolean, filled_by string, condition_text string, label string, columns array<struct<name string, type_name string, mods array<int>>>, literals array<string>"


def action(kind, stmt, relation="t", step=0, migration=1, **over):
    base = dict(repo=1, migration_no=migration, step_no=step, stmt_no=stmt, action_no=0, step_kind="ddl_tx", no_lock_timeout=False, action_kind=kind, schema_name="", relation=relation, column_name="c", referenced="o", constraint_name="k", type_name="text", mods=None, concurrent=False, not_valid=False, if_exists=False, has_where=True, filled_by="none", condition_text="", label="l", columns=None, literals=None)
    return tuple((base | over).values())


def test_rules_flag_and_stay_silent(spark):
    rows = [
        action("create_table", 0, "mine"), action("create_index", 1, "mine"), action("create_index", 2, "theirs"), action("create_index", 3, "theirs", concurrent=True),
        action("set_not_null", 4, "theirs"), action("add_check", 5, "theirs", not_valid=True, condition_text="theirs.c is not null"), action("validate_constraint", 6, "theirs"), action("truncate", 7, "Mine"),
    ]
    actions = spark.createDataFrame(rows, ACTION)
    stats = spark.createDataFrame([("theirs", True, 5_000_000, 10)], "relation string, exists boolean, n_rows long, n_bytes long")
    got = {(r.stmt_no, r.rule_id, r.severity) for r in hazards.single_action_rules(hazards.with_context(actions, stats)).collect()}
    assert got == {(2, "L001", 3), (3, "L002", 3), (7, "L033", 3)}
    old = {(r.stmt_no, r.rule_id) for r in hazards.single_action_rules(hazards.with_context(actions, stats, 11), 11).collect()}
    assert (4, "L005") in old


def test_fresh_and_versions(spark):
    rows = [action("create_table", 0, "T"), action("update", 1, "t"), action("drop_table", 2, "t"), action("update", 3, "t"), action("attach_partition", 4, "p", referenced="q")]
    actions = spark.createDataFrame(rows, ACTION)
    assert {r.stmt_no: r.fresh for r in hazards.fresh_at(actions, actions).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False}
    mode = lambda v: {r.locked: r.mode for r in hazards.effects(actions, v).where("stmt_no = 4").collect()}
    assert mode(11) == {"p": 8, "q": 8} and mode(12) == {"p": 4, "q": 8}
    assert hazards.effects(spark.createDataFrame([action("grant", 0)], ACTION)).count() == 0


def test_locks_by_name(spark):
    rows = [(*action("lock_table", 0), 6), (*action("lock_table", 1), None), (*action("lock_table", 2, "o"), 1)]
    named = spark.createDataFrame(rows, ACTION + ", lock_mode int")
    assert {r.stmt_no: (r.locked, r.mode, r.duration, r.implicit) for r in hazards.effects(named).collect()} == {0: ("t", 6, 1, False), 1: ("t", 8, 1, False), 2: ("o", 1, 1, False)}
    assert [r["mode"] for r in hazards.effects(named.drop("lock_mode")).collect()] == [8, 8, 8]
    assert {r.stmt_no: (r.blocks_reads, r.blocks_writes) for r in hazards.statement_profile(named).collect()} == {0: (False, True), 1: (True, True), 2: (False, False)}


def test_schemas_and_several_actions_of_a_statement(spark):
    rows = [
        action("create_table", 0, schema_name="app"), action("create_index", 1, schema_name="app"), action("create_index", 1, schema_name="audit", action_no=1), action("create_index", 1, action_no=2),
        action("add_column", 2, type_name="varchar", mods=[5], schema_name="app"), action("alter_type", 3, type_name="varchar", mods=[9]), action("alter_type", 3, type_name="varchar", mods=[7], action_no=1), action("alter_type", 4, type_name="text"),
    ]
    actions = spark.createDataFrame(rows, ACTION)
    assert {(r.stmt_no, r.action_no): r.created for r in hazards.created_here(actions, actions).where("stmt_no = 1").collect()} == {(1, 0): True, (1, 1): False, (1, 2): True}
    prior = {(r.stmt_no, r.action_no): r.prior.mods for r in hazards.type_before(actions).collect()}
    assert prior == {(3, 0): [5], (3, 1): [5], (4, 0): [7]}
    stats = spark.createDataFrame([], "relation string, exists boolean, n_rows long, n_bytes long")
    ctx = {(r.stmt_no, r.action_no): (r.created, r.column_added, r.in_place) for r in hazards.with_context(actions, stats).collect()}
    assert ctx == {(0, 0): (False, False, False), (1, 0): (True, False, False), (1, 1): (False, False, False), (1, 2): (True, False, False), (2, 0): (True, False, False), (3, 0): (True, True, True), (3, 1): (True, True, True), (4, 0): (True, True, True)}


def test_context_by_windows_is_context_by_joins(spark, sf_dir):
    """with_context gives what the operators that it stands for give one by one."""
    at = Views(spark, sf_dir)
    a = at.ddl_actions
    place = [*hazards.STMT, "action_no"]
    got = hazards.with_context(a, at.relation_stats.withColumn("exists", F.lit(True))).select(*place, "created", "column_added", "proven", "in_place", "duration")
    want = hazards.not_null_proof(hazards.column_added_in_file(hazards.created_here(a, a), a), a).select(*place, "created", "column_added", F.expr("proven AND action_kind = 'set_not_null'").alias("proven"))
    typed = hazards.in_place_type_change(hazards.type_before(a)).select(*place, "in_place")
    worst = hazards.effects(a).where("not implicit").groupBy(*place).agg(F.max("duration").alias("duration"))
    want = want.join(typed, place, "left").join(worst, place, "left").fillna({"in_place": False, "duration": 0})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_suppression_steps(spark):
    f = spark.createDataFrame([(1, "a", "L001", "s1", 2), (2, "a", "L001", "s2", 2), (3, "b", "L001", "s1", 2)], "finding_id int, file string, rule_id string, step string, severity int")
    d = spark.createDataFrame([("a", "L001", "s1", ""), ("b", "L001", "", "broken")], "file string, rule_id string, step string, problem string")
    assert sorted(r.finding_id for r in findings.suppress(f, d).collect()) == [2, 3]
    assert {r.file: r.used for r in findings.mark_used(d, f).collect()} == {"a": True, "b": False}


def test_sections(spark):
    text = "@@ ignore L001 reason=\"x\"\n@@ step: one\n\nbody\n@@ step: two\n@@ odd\n"
    lines = corpus.explode_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [(r.line_no, r.offset) for r in lines.orderBy("line_no").collect()][:3] == [(1, 0), (2, 26), (3, 39)]
    out = {r.section: (r.text, r.problem) for r in corpus.section_text(corpus.section_of(lines)).collect()}
    assert out == {"one": ("body", ""), "two": ("", "empty section")}
    assert [r.line for r in corpus.unknown_markers(lines).collect()] == ["@@ odd"]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for kind in ("parquet", "json"):
        write_report(df, str(tmp_path / f"t.{kind}"), kind)
        assert sorted(map(tuple, read_tables(spark, str(tmp_path), ["t"], kind, {"t": df.schema})["t"].collect())) == [(1, "a"), (2, "b")]
    write_report(df, str(tmp_path / "by"), by=["k"])
    write_report(df.where("k = 2").withColumn("v", F.lit("c")), str(tmp_path / "by"), by=["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "by")).collect()) == [(1, "a"), (2, "c")]
    (tmp_path / "x.sql").write_text("one\ntwo")
    assert read_texts(spark, str(tmp_path / "x.sql")).first().text == "one\ntwo"


def test_stale_writers_stream(spark, tmp_path):
    rows = [(1, 1, "a", 1, "2024-01-01 00:00:00"), (2, 1, "b", 2, "2024-01-01 00:00:01"), (3, 1, "a", 1, "2024-01-01 00:00:02"), (4, 1, "b", 2, "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "seq long, resource long, owner string, epoch long, at string").withColumn("at_ts", F.to_timestamp("at")).drop("at").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out = streams.run_once(streams.stream_stale_writers(live, 1000), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {r.seq: r.outcome for r in out if r.seq > 0} == {1: "accepted", 2: "accepted", 3: "refused", 4: "accepted"}


def test_whole_queries_leave_nothing_out(spark, sf_dir):
    """Overlaps of all heartbeats and never-granted tables of all repos, against brute force."""
    at = Views(spark, sf_dir)
    beats = [(r.resource, r.owner, r.at, r.at + 20_000_000_000) for r in at.heartbeats.select("resource", "owner", micros("at_ts").alias("at")).collect()]
    want = []
    for a in beats:
        n = sum(a[0] == b[0] and a[1] != b[1] and b[3] > a[2] and (b[2], b[3], b[1]) < (a[2], a[3], a[1]) for b in beats)
        want += [(*a, n)] * (n > 0)
    assert sorted(map(tuple, catalog.QUERIES["c9_overlapping_owners_whole"](spark, sf_dir).collect())) == sorted(want)
    rows = at.ddl_actions.collect()
    creates, lineage = ("create_table", "create_partition", "create_referencing"), {r.repo for r in rows if r.action_kind in ("grant", "grant_all")}
    files = {}
    for r in rows:
        files.setdefault((r.repo, r.migration_no), []).append(r)
    want = set()
    for (repo, migration), file in files.items():
        for m in file:
            if m.action_kind in creates and repo in lineage:
                dropped = any(r.action_kind == "drop_table" and r.relation == m.relation for r in file)
                granted = any((r.action_kind == "grant_all" or (r.action_kind == "grant" and r.relation == m.relation)) and (r.step_no, r.stmt_no) > (m.step_no, m.stmt_no) for r in file)
                if not dropped and not granted:
                    want.add((repo, migration, m.step_no, m.stmt_no, m.relation))
    assert sorted(map(tuple, catalog.QUERIES["g14_never_granted"](spark, sf_dir).collect())) == sorted(want)
    assert any(repo % 2 for repo, *_ in want)


def test_findings_are_worked_out_once_to_be_sorted(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    schema = "repo long, migration_no long, step_no long, stmt_no long, action_no long, relation string, rule_id string, severity int"
    rows = [(i % 3, 50 - i, 0, i % 2, 0, "t", f"L00{i % 7}", 1) for i in range(50)]
    found = spark.createDataFrame(rows, schema).repartition(3).mapInPandas(count, schema)
    got = [tuple(r) for r in hazards.order_findings(found).collect()]
    assert got == sorted(rows) and seen.value == len(rows)
