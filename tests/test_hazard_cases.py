"""Rules of schema changes on hand-made logs: what they flag and what they leave alone, without SQL beside them."""

import pytest
from pyspark.sql import functions as F
from test_small_cases import ACTION, action

from tablestate.functions.scalars import not_null_column
from tablestate.operators import hazards
from tablestate.sources.tables import nested

NO_STATS = "relation string, exists boolean, n_rows long, n_bytes long"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), ACTION)


def found(spark, actions):
    ctx = hazards.with_context(actions, spark.createDataFrame([], NO_STATS))
    return {(r.stmt_no, r.action_no, r.rule_id) for r in hazards.single_action_rules(ctx).collect()}


@pytest.mark.parametrize(
    "was,new,in_place",
    [
        (("numeric", [10, 2]), ("numeric", [12, 2]), True),
        (("numeric", [10, 2]), ("numeric", [12, 4]), False),
        (("numeric", [10, 2]), ("numeric", [8, 2]), False),
        (("numeric", [10]), ("numeric", [12]), False),
        (("numeric", [10]), ("numeric", [10]), True),
        (("numeric", [10, 2]), ("numeric", None), True),
        (("numeric", None), ("numeric", [10, 2]), False),
        (("varchar", [5]), ("varchar", [9]), True),
        (("varchar", [9]), ("varchar", [5]), False),
        (("varchar", []), ("varchar", [5]), False),
        (("varchar", [5]), ("varchar", []), True),
        (("varchar", [5]), ("text", None), True),
        (("text", None), ("text", []), True),
        (("text", None), ("varchar", [5]), False),
        (("int", None), ("bigint", None), False),
    ],
)
def test_in_place(spark, was, new, in_place):
    """A column born in a create table in an earlier file, named in another case."""
    born = action("create_table", 0, "T", migration=1, columns=[("A", "text", None), ("C", *was)])
    change = action("alter_type", 0, "t", migration=2, type_name=new[0], mods=new[1])
    r = hazards.in_place_type_change(hazards.type_before(log(spark, born, change))).first()
    assert (r.in_place, r.prior.type_name, r.prior.mods) == (in_place, was[0], was[1] or [])


def test_type_history(spark):
    """Strictly before, last one wins, across files, not undone by a drop; unknown columns stay unknown."""
    rows = [
        action("create_table", 0, columns=[("c", "varchar", [3]), ("d", "int", None)]),
        action("drop_table", 1),
        action("add_column", 2, column_name="C", type_name="varchar", mods=[4]),
        action("alter_type", 3, type_name="varchar", mods=[6]),
        action("alter_type", 0, migration=2, type_name="varchar", mods=[8]),
        action("alter_type", 1, migration=2, column_name="e"),
        action("alter_type", 2, "other", migration=2),
    ]
    prior = {(r.migration_no, r.stmt_no): r.prior and (r.prior.type_name, r.prior.mods) for r in hazards.type_before(log(spark, *rows)).collect()}
    assert prior == {(1, 3): ("varchar", [4]), (2, 0): ("varchar", [6]), (2, 1): None, (2, 2): None}


def test_renames_of_columns_born_in_the_file(spark):
    rows = [
        action("create_table", 0, "other", columns=[("c", "int", None)]),
        action("create_table", 1, "old", migration=1, columns=[("c", "int", None)]),
        action("rename_column", 0, "OLD", migration=2, column_name="c"),
        action("alter_type", 1, "old", migration=2, column_name="d"),
        action("rename_column", 2, "Old", migration=2, column_name="D"),
        action("add_column", 3, "old", migration=2, column_name="e"),
        action("rename_column", 3, "old", migration=2, column_name="e", action_no=1),
        action("rename_column", 4, "old", migration=2, column_name="e"),
    ]
    actions = log(spark, *rows)
    added = {(r.migration_no, r.stmt_no): r.column_added for r in hazards.column_added_in_file(actions.where("action_kind = 'rename_column'"), actions).collect()}
    assert added == {(2, 0): False, (2, 2): True, (2, 3): False, (2, 4): True}
    assert {f for f in found(spark, actions) if f[2] == "L031"} == {(0, 0, "L031"), (3, 1, "L031")}


@pytest.mark.parametrize(
    "text,column",
    [
        ("c IS NOT NULL", "c"),
        ("((T.C is  not\nnull))", "c"),
        ('"C" IS NOT NULL', "C"),
        ('(app."T".("x") IS NOT NULL)', None),
        ('("app" . "T" . "a ""b""" IS NOT NULL)', 'a "b"'),
        ("(c) IS NOT NULL", "c"),
        ("(c)IS NOT NULL", "c"),
        ("((c) IS NOT NULL", None),
        ("c IS NULL", None),
        ("c IS NOT NULL AND d IS NOT NULL", None),
        ("lower(c) IS NOT NULL", None),
        ("c > 0", None),
        ("", None),
        (None, None),
    ],
)
def test_what_a_check_says(spark, text, column):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(not_null_column(F.col("t"))).first()[0] == column


def test_proofs_by_column(spark):
    """A check on the column, checked at once or validated under its name anywhere in the file; nothing else."""
    check = lambda stmt, over: action("add_check", stmt, **({"not_valid": True, "condition_text": "c IS NOT NULL"} | over))
    valid = lambda stmt, **over: action("validate_constraint", stmt, **over)
    cases = [
        ([check(0, {}), valid(2)], True),
        ([check(0, {})], False),
        ([check(0, {"not_valid": False})], True),
        ([check(0, {"condition_text": "d IS NOT NULL"}), valid(2)], False),
        ([check(0, {"not_valid": False, "condition_text": "c > 0"})], False),
        ([check(0, {}), valid(2, constraint_name="other")], False),
        ([check(0, {}), valid(2, relation="T")], False),
        ([check(0, {"relation": "u"}), valid(2, relation="u")], False),
        ([valid(0), check(2, {})], True),
        ([check(0, {}), valid(2, migration=9)], False),
    ]
    rows = [r[:1] + (1000 * i + r[1],) + r[2:] for i, (file, _) in enumerate(cases) for r in [*file, action("set_not_null", 1)]]
    actions = log(spark, *rows)
    asked = hazards.not_null_proof(actions.where("action_kind = 'set_not_null'"), actions)
    want = {1000 * i + 1: proven for i, (_, proven) in enumerate(cases)}
    assert {r.migration_no: r.proven for r in asked.collect()} == want
    ctx = hazards.with_context(actions, spark.createDataFrame([], NO_STATS)).where("action_kind = 'set_not_null'")
    assert {r.migration_no: r.proven for r in ctx.collect()} == want


def test_grants_by_file(spark):
    cases = [
        ([action("create_table", 0)], True),
        ([action("create_table", 0), action("grant", 1)], False),
        ([action("grant", 0), action("create_table", 1)], True),
        ([action("create_table", 0), action("grant", 0, action_no=1)], True),
        ([action("create_table", 0), action("grant", 1, "T")], True),
        ([action("create_table", 0), action("grant_all", 0, "", step=1)], False),
        ([action("grant_all", 0, ""), action("create_table", 1)], True),
        ([action("drop_table", 0), action("create_table", 1)], False),
        ([action("create_table", 0), action("drop_table", 1, "T")], True),
    ]
    rows = [r[:1] + (1 + i,) + r[2:] for i, (file, _) in enumerate(cases) for r in file]
    rows += [action("grant", 0, migration=50), action("create_table", 0, migration=50, relation="elsewhere")]
    got = {r.migration_no for r in hazards.never_granted(log(spark, *rows)).collect()}
    assert got == {1 + i for i, (_, flagged) in enumerate(cases) if flagged} | {50}
    assert hazards.never_granted(log(spark, *[r for r in rows if not r[7].startswith("grant")])).count() == 0


def test_lock_domains(spark):
    """Access exclusive alone; a covered view adds no domain but its statement counts; parents come first."""
    lock = lambda stmt, relation, step: action("truncate", stmt, relation, step=step)
    rows = [
        lock(0, "a", 0), lock(1, "b", 0),
        lock(0, "a", 1), action("create_index", 1, "b", step=1),
        lock(0, "a", 2), action("drop_index", 1, "a_key", step=2),
        lock(0, "a", 3), action("drop_view", 1, "seen", step=3),
        lock(0, "b", 4), action("drop_view", 1, "seen", step=4),
        lock(0, "a", 5), action("drop_view", 1, "seen", step=5), lock(1, "b", 5) [:4] + (1,) + lock(1, "b", 5)[5:],
        lock(0, "b", 6), action("drop_view", 1, "owned", step=6),
    ]
    parents = spark.createDataFrame([(1, 1, 1, "a_key", "A"), (1, 1, 2, "owned", "a")], "repo int, migration_no int, ord int, relation string, parent string")
    views = spark.createDataFrame([(1, "seen", "a"), (1, "owned", "b")], "repo int, relation string, base string")
    got = {r.step_no: (r.n_domains, r.n_stmts) for r in hazards.lock_domains(log(spark, *rows), parents, views).collect()}
    assert got == {0: (2, 2), 4: (2, 2), 5: (2, 2), 6: (2, 2)}


def test_labels_in_literals(spark):
    rows = [
        action("add_enum_value", 0, label="new"),
        action("update", 1, literals=["x", "new", "new"]),
        action("insert", 2, literals=["NEW"]),
        action("add_column", 3, literals=["new"]), action("add_column", 3, literals=["new"], action_no=1),
        action("insert", 0, literals=["new"], step=1),
        action("insert", 0, migration=2, literals=["new"]), action("add_enum_value", 1, migration=2, label="new"),
    ]
    assert sorted(r.stmt_no for r in hazards.used_after_added_in_txn(log(spark, *rows)).collect()) == [1, 3]


def test_one_finding_a_statement(spark):
    rows = [action(kind, stmt, f"t{n}", action_no=n) for stmt, kind in enumerate(("drop_table", "truncate", "drop_column")) for n in range(3)]
    rows += [action("create_table", 3, "mine"), action("truncate", 4, "mine"), action("truncate", 4, "theirs", action_no=1), action("truncate", 4, "others", action_no=2)]
    assert found(spark, log(spark, *rows)) == {(0, 0, "L030"), (1, 0, "L033"), (2, 0, "L030"), (2, 1, "L030"), (2, 2, "L030"), (4, 1, "L033")}


def test_bare_names_before_a_backfill(spark):
    rows = [action("create_index", 0, "T"), action("create_index", 1, "t"), action("update", 0, "t", step=1, step_kind="backfill")]
    assert [r.stmt_no for r in hazards.before_backfill(log(spark, *rows)).collect()] == [1]


def test_every_kind_has_its_locks(spark):
    """Each rule of the table for a version applies to an action with its flags, and an unknown kind locks nothing."""
    rows = [action(r[0], i, concurrent=bool(r[1]), not_valid=bool(r[2]), filled_by=r[3] or "none") for i, r in enumerate(hazards.RULES)]
    for version in (10, 16):
        got = {(r.stmt_no, r.ord) for r in hazards.effects(log(spark, *rows), version).collect()}
        assert {(i, i) for i, r in enumerate(hazards.RULES) if r[4] <= version <= r[5]} <= got
        for stmt, rule in got:
            assert hazards.RULES[stmt][0] == hazards.RULES[rule][0]
    assert hazards.effects(log(spark, action("grant_all", 0))).count() == 0


def test_nested_columns_from_text(spark):
    df = spark.createDataFrame([(1, "[10,2]", '[{"name":"a","type_name":"int","mods":[]}]'), (2, None, None)], "k int, mods string, columns string")
    read = {r.k: r for r in nested(df, mods=hazards.MODS_TYPE, columns=hazards.COLUMNS_TYPE, literals=hazards.LITERALS_TYPE).collect()}
    assert read[1].mods == [10, 2] and read[1].columns[0].type_name == "int" and read[2].mods is None
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|[Mm]alformed"):
        nested(df.limit(1).withColumn("mods", F.lit("no array")), mods=hazards.MODS_TYPE).collect()
