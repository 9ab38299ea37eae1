"""Policy documents, bounds from footers, figures from Spark's catalog, markers of rules that cannot be silenced."""

import json

import pytest
from pyspark.sql import functions as F

from tablestate.operators import backfill, corpus, findings, ledger, state

RULES = ["L000", "L001", "L002"]


def documents(spark, *texts):
    return spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "repo int, document string")


@pytest.mark.parametrize("path,clean", [("./a//b/", "a/b"), ("a/../b", "b"), ("../a", "../a"), ("a/../../b", "../b"), (".", "."), ("a/..", "."), ("", ""), ("/a/", "/a"), ("././db", "db")])
def test_paths(spark, path, clean):
    assert spark.createDataFrame([(path,)], "p string").select(findings.clean_path(F.col("p"))).first()[0] == clean


def test_documents_of_many_repositories(spark):
    docs = documents(
        spark,
        {"rules": {"L001": "warn", "L002": "off"}, "overrides": [{"path": "./db/", "rules": {"L001": "off"}}, {"path": "db/x/../y", "rules": {"L001": "error"}}]},
        {"rules": {"L001": "info"}},
        "",
        {"overrides": [{"path": "db", "rules": {"L002": "error"}}, {"path": "db", "rules": {"L002": "warn"}}]},
        {},
    )
    dirs = spark.createDataFrame([(r, d) for r in range(5) for d in ("db", "db/y/z", "dbx", "./db/w/")], "repo int, directory string")
    got = {(r.repo, r.directory, r.rule_id): r.severity for r in findings.resolve_documents(findings.read_policies(docs), dirs).collect()}
    want = {(0, "db", "L001"): 0, (0, "db/y/z", "L001"): 3, (0, "dbx", "L001"): 2, (0, "./db/w/", "L001"): 0, **{(0, d, "L002"): 0 for d in ("db", "db/y/z", "dbx", "./db/w/")}}
    want |= {(1, d, "L001"): 1 for d in ("db", "db/y/z", "dbx", "./db/w/")} | {(3, d, "L002"): 2 for d in ("db", "db/y/z", "./db/w/")}
    assert got == want
    assert findings.validate_documents(docs, RULES).count() == 0


def test_documents_that_are_refused(spark):
    docs = documents(
        spark,
        {"colour": 1},
        {"thresholds": {"big_rows": -1, "small_bytes": 0, "huge": 3}},
        {"rules": {"L000": "warn", "L009": "off", "L001": "loud"}},
        {"overrides": [{"path": "a", "rules": {}}, {"rules": {"L002": "x"}, "paths": "b"}]},
        "no document",
        None,
    )
    got = {(r.repo, r.scope_no, r.item, r.value, r.problem) for r in findings.validate_documents(docs, RULES).collect()}
    assert got == {
        (0, None, "field", "colour", "unknown field"),
        (1, None, "field", "huge", "unknown field"),
        (1, None, "threshold", "big_rows=-1", "a threshold cannot be negative"),
        (2, 0, "rule", "L000", "cannot be graded"),
        (2, 0, "rule", "L009", "unknown rule"),
        (2, 0, "level", "loud", "unknown level"),
        (3, 2, "field", "paths", "unknown field"),
        (3, 2, "path", "", "missing path"),
        (3, 2, "level", "x", "unknown level"),
        (4, None, "document", "no document", "not a policy document"),
    }


def test_bounds_from_footers(spark, tmp_path):
    """Minimum and maximum are pushed into the reader, which reads no column; nulls and empty tables are minded."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(5, "x"), (None, "y"), (-3, "z")], "k long, v string").coalesce(1).write.parquet(path)
    df = backfill.footer_bounds(spark, path, "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(k), MAX(k)]" in plan
    assert tuple(df.first()) == (-3, 5) == tuple(backfill.key_bounds(spark.read.parquet(path), "k").first())
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    spark.createDataFrame([(None, "no bounds here")], "k long, v string").write.mode("append").parquet(path)
    assert backfill.stored_bounds(spark, path, "k") == (-3, 5)
    with pytest.raises(Exception, match="No such|exist"):
        backfill.stored_bounds(spark, str(tmp_path / "gone"), "k")
    spark.createDataFrame([], "k long").write.parquet(str(tmp_path / "none"))
    assert tuple(backfill.footer_bounds(spark, str(tmp_path / "none"), "k").first()) == (None, None)


def test_backfill_by_given_bounds(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(50).selectExpr("id AS k", "CAST(NULL AS STRING) AS v").write.parquet(path)
    src = spark.read.parquet(path)
    bounds = backfill.stored_bounds(spark, path, "k")
    out = backfill.run_backfill(spark, src, "k", {"v": F.lit("done")}, F.col("v").isNull(), 10, str(tmp_path / "out"), 2, bounds=bounds)
    assert out.where("v = 'done'").count() == 50


def test_figures_from_the_catalog(spark):
    """Unknown row counts stay null until the table is analysed; then they are those of the table, and zero is zero."""
    names = ["stats_some", "stats_none", "no_such_table"]
    try:
        spark.range(7).write.saveAsTable("stats_some")
        spark.range(0).write.saveAsTable("stats_none")
        before = {r.relation: r.n_rows for r in state.table_stats(spark, names).collect()}
        assert before == {"stats_some": None, "stats_none": None}
        after = state.table_stats(spark, names, analyze=True)
        assert {r.relation: (r.n_rows, r.n_bytes > 0) for r in after.collect()} == {"stats_some": (7, True), "stats_none": (0, True)}
        asked = spark.createDataFrame([("stats_some",), ("gone",)], "relation string")
        assert {r.relation: (r.exists, r.n_rows) for r in state.relation_stats(asked, after).collect()} == {"stats_some": (True, 7), "gone": (False, 0)}
    finally:
        for name in names[:2]:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_own_rule_cannot_be_silenced(spark):
    text = '@@ ignore L000 reason="no"\n@@ ignore L001 reason="yes"\n@@ ignore L999 reason="no"\n'
    lines = corpus.section_of(corpus.explode_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert [r.problem for r in corpus.directives(lines, RULES).orderBy("line_no").collect()] == ["names a rule that cannot be silenced", "", "names no known rule"]


def test_summary_counts_migrations(spark):
    rows = [(1, 0, m, "applied" if m else "skipped", m == 2, 10) for m in (0, 0, 1, 2)] + [(1, 1, 0, "skipped", False, 5)]
    got = {r.run_no: (r.migrations, r.steps_total, r.applied, r.skipped, r.repaired, r.duration_us) for r in ledger.run_summary(spark.createDataFrame(rows, "job int, run_no int, migration_no int, outcome string, repaired boolean, took_us long")).collect()}
    assert got == {0: (3, 4, 2, 2, 1, 40), 1: (1, 1, 0, 1, 0, 5)}
