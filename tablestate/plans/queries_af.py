"""Queries of families A to F over the derived views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import humanize_bytes, humanize_duration, humanize_rows
from ..operators import adoption, backfill, latency, ledger, merkle, sizing, state
from ..sources.tables import shared_folder
from .registry import Views, query

BATCH = 1000
_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP '2024-01-01 00:00:00', {})"
_MICROS_SQL = "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', {})"


def work():
    """The rows of v_backfill that need work."""
    return F.col("filled").isNull()


def change():
    return {"filled": F.col("legacy")}


def micros(c: str):
    """Microseconds since 2024, the same in every session time zone."""
    return F.expr(_MICROS.format(c))


_PLAN = """SELECT id, legacy, filled, CAST(floor((id - s - 1) / 1000) AS BIGINT) AS slice_no, s + CAST(floor((id - s - 1) / 1000) AS BIGINT) * 1000 AS lo,
       s + CAST(floor((id - s - 1) / 1000) AS BIGINT) * 1000 + 1000 AS hi FROM (SELECT *, (SELECT min(id) - 1 FROM v_backfill) AS s FROM v_backfill) b"""
_COUNTS = f"SELECT slice_no, hi, count(*) AS rows_in_range, CAST(count(CASE WHEN filled IS NULL THEN 1 END) AS BIGINT) AS rows_touched FROM ({_PLAN}) p GROUP BY slice_no, hi"


@query("SELECT min(id) AS low, max(id) AS high FROM v_backfill")
def a1_key_bounds(v: Views) -> DataFrame:
    return backfill.key_bounds(v.backfill, "id")


@query("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def a1_footer_bounds(v: Views) -> DataFrame:
    return backfill.footer_bounds(v.spark, f"{v.sf_dir}/orders.parquet", "o_orderkey")


@query(f"SELECT id, slice_no, lo, hi FROM ({_PLAN}) p")
def a2_slice_plan(v: Views) -> DataFrame:
    return backfill.slice_plan(v.backfill, "id", BATCH).select("id", "slice_no", "lo", "hi")


@query("""SELECT id, legacy, CASE WHEN id > lo AND id <= hi AND filled IS NULL THEN legacy ELSE filled END AS filled
  FROM v_backfill, (SELECT min(id) + (max(id) - min(id)) // 4 AS lo, max(id) - (max(id) - min(id)) // 4 AS hi FROM v_backfill) k""")
def a3_apply_slices(v: Views) -> DataFrame:
    """The middle half of the key range."""
    low, high = backfill.key_bounds(v.backfill, "id").first()
    quarter = (high - low) // 4
    return backfill.apply_slices(v.backfill, "id", work(), change(), low + quarter, high - quarter)


@query(_COUNTS)
def a4_slice_counts(v: Views) -> DataFrame:
    return backfill.slice_counts(v.backfill, "id", work(), BATCH)


@query(f"SELECT 'orders' AS job, slice_no, hi AS position, CAST(sum(rows_touched) OVER (ORDER BY slice_no) AS BIGINT) AS rows FROM ({_COUNTS}) c")
def a5_progress(v: Views) -> DataFrame:
    counts = backfill.slice_counts(v.backfill, "id", work(), BATCH).withColumn("job", F.lit("orders"))
    return backfill.progress(counts, ["job"], wave=64)


@query("""SELECT j.job, CASE WHEN m.n > 0 THEN m.p ELSE j.start END AS position, CAST(coalesce(m.r, 0) AS BIGINT) AS rows, coalesce(m.n, 0) > 0 AS resumed
  FROM (SELECT s_suppkey AS job, s_suppkey - 1 AS start FROM supplier) j LEFT JOIN (SELECT job, max(position) AS p, sum(n_rows) AS r, count(*) AS n FROM v_manifest GROUP BY job) m ON m.job = j.job""")
def a6_resume_point(v: Views) -> DataFrame:
    jobs = v.table("supplier").select(F.col("s_suppkey").alias("job"), (F.col("s_suppkey") - 1).alias("start"))
    return backfill.resume_point(jobs, v.manifest, "job")


@query("SELECT count(CASE WHEN filled IS NULL THEN 1 END) AS remaining, count(CASE WHEN filled IS NULL THEN 1 END) = 0 AS done FROM v_backfill")
def a7_remaining(v: Views) -> DataFrame:
    return backfill.remaining(v.backfill, work())


@query("""SELECT count(CASE WHEN id > cut AND filled IS NOT NULL THEN 1 END) AS filled_above, count(CASE WHEN id <= cut AND filled IS NULL THEN 1 END) AS unfilled_at_or_below
  FROM v_backfill, (SELECT min(id) + (max(id) - min(id)) // 2 AS cut FROM v_backfill) k""")
def a8_cursor_audit(v: Views) -> DataFrame:
    """A cursor in the middle of the key range."""
    low, high = backfill.key_bounds(v.backfill, "id").first()
    return backfill.cursor_audit(v.backfill, "id", work(), low + (high - low) // 2)


@query("SELECT id, legacy, coalesce(filled, legacy) AS filled FROM v_backfill")
def a9_run_backfill(v: Views) -> DataFrame:
    """The key is that of the stored orders less 100, so its bounds come from their footers."""
    src = v.backfill
    low, high = backfill.stored_bounds(v.spark, f"{v.sf_dir}/orders.parquet", "o_orderkey")
    bounds = (low - 100, high - 100) if low is not None else None
    slices = max(1, -(-(high - low + 1) // (4 * BATCH))) if bounds else 1
    return backfill.run_backfill(v.spark, src, "id", change(), work(), BATCH, f"{shared_folder(v.spark)}/backfill-{uuid.uuid4().hex}", slices, bounds=bounds)


@query("""SELECT job, batch_no, size, expected_size, CASE WHEN max_lag_bytes > 0 AND lag_bytes > max_lag_bytes THEN took_ms ELSE 0 END AS pause_ms, size = expected_size AS ok FROM (
SELECT *, CASE WHEN p_size IS NULL THEN 1000 ELSE greatest(100, least(50000, CASE WHEN (p_max > 0 AND p_lag > p_max) OR p_took > 500 THEN CAST(floor(p_size / 2) AS BIGINT) ELSE CAST(floor(p_size * 5 / 4) AS BIGINT) END)) END AS expected_size FROM (
SELECT *, lag(size) OVER w AS p_size, lag(took_ms) OVER w AS p_took, lag(lag_bytes) OVER w AS p_lag, lag(max_lag_bytes) OVER w AS p_max FROM v_batch_log WINDOW w AS (PARTITION BY job ORDER BY batch_no)) x) y""")
def a10_pacing_audit(v: Views) -> DataFrame:
    return backfill.pacing_audit(v.batch_log)


@query("SELECT cluster, sample, coalesce(max(sent - replay), 0) AS lag_bytes FROM v_replicas GROUP BY cluster, sample")
def a11_lag_by_source(v: Views) -> DataFrame:
    return backfill.lag_by_source(v.replicas, ["cluster", "sample"])


# --- B

_NAMED = "schema_name NOT IN ('pg_catalog', 'information_schema', 'bookkeeping')"
_BEGINS = "NOT starts_with({}schema_name, 'pg_') AND {}schema_name NOT IN ('information_schema', 'bookkeeping')"
_LINES = f"""
SELECT db, 0 AS section_no, 'columns' AS section, schema_name || '.' || relation || '.' || name || ' ' || data_type || ' null=' || nullable || ' default=' || coalesce(default_text, '-') AS line FROM v_cat_columns WHERE {_NAMED}
UNION ALL SELECT i.db, 1, 'indexes', r.schema_name || '.' || r.name || ' valid=' || CASE WHEN valid THEN 't' ELSE 'f' END || ' ready=' || CASE WHEN ready THEN 't' ELSE 'f' END || ' live=t ' || definition
  FROM v_cat_indexes i JOIN v_cat_relations r ON r.db = i.db AND r.oid = i.oid WHERE {_BEGINS.format("r.", "r.")}
UNION ALL SELECT db, 2, 'constraints', schema_name || '.' || relation || '.' || name || ' type=' || kind || ' validated=' || CASE WHEN validated THEN 't' ELSE 'f' END || ' ' || definition FROM v_cat_constraints WHERE {_BEGINS.format("", "")}
UNION ALL SELECT db, 3, 'sequences', schema_name || '.' || name || ' start=' || CAST(start_value AS STRING) || ' increment=' || CAST(increment AS STRING) FROM v_cat_sequences WHERE {_NAMED}
UNION ALL SELECT db, 4, 'ownership', schema_name || '.' || name || ' owner=' || owner FROM v_cat_relations WHERE {_BEGINS.format("", "")} AND kind IN ('r', 'p', 'S', 'v', 'm')
UNION ALL SELECT db, 5, 'grants', schema_name || '.' || relation || ' ' || grantor || ' -> ' || grantee || ': ' || privilege FROM v_cat_grants WHERE {_NAMED}"""


def _lines(v: Views) -> DataFrame:
    return state.catalog_lines(v.cat_columns, v.cat_indexes, v.cat_constraints, v.cat_sequences, v.cat_relations, v.cat_grants)


@query(_LINES)
def b1_catalog_lines(v: Views) -> DataFrame:
    return _lines(v)


@query(f"""SELECT db, sha256(string_agg('[' || section || ']' || chr(10) || text, '' ORDER BY section_no)) AS sha256 FROM (
SELECT d.db, s.section_no, s.section, coalesce(t.text, '') AS text FROM (SELECT DISTINCT db FROM ({_LINES}) l) d
CROSS JOIN (SELECT 0 AS section_no, 'columns' AS section UNION ALL SELECT 1, 'indexes' UNION ALL SELECT 2, 'constraints' UNION ALL SELECT 3, 'sequences' UNION ALL SELECT 4, 'ownership' UNION ALL SELECT 5, 'grants') s
LEFT JOIN (SELECT db, section_no, string_agg(line || chr(10), '' ORDER BY line) AS text FROM ({_LINES}) l GROUP BY db, section_no) t ON t.db = d.db AND t.section_no = s.section_no) x GROUP BY db""")
def b2_schema_fingerprint(v: Views) -> DataFrame:
    return state.schema_fingerprint(_lines(v))


@query(f"SELECT db, section_no, section, line, CAST(row_number() OVER (PARTITION BY db ORDER BY section_no, line) AS INTEGER) AS position FROM ({_LINES}) l")
def b3_schema_describe(v: Views) -> DataFrame:
    return state.schema_describe(_lines(v))


@query(f"""SELECT w.db, '-' AS sign, w.line FROM ({_LINES}) w WHERE w.db + 1 IN (SELECT db FROM ({_LINES}) d) AND NOT EXISTS (SELECT 1 FROM ({_LINES}) g WHERE g.db = w.db + 1 AND g.line = w.line)
UNION ALL SELECT g.db - 1, '+', g.line FROM ({_LINES}) g WHERE g.db - 1 IN (SELECT db FROM ({_LINES}) d) AND NOT EXISTS (SELECT 1 FROM ({_LINES}) w WHERE w.db = g.db - 1 AND w.line = g.line)""")
def b4_schema_diff(v: Views) -> DataFrame:
    return state.neighbour_diffs(_lines(v))


_MD5 = "md5('=' || CAST(c_custkey AS STRING) || '|' || '=' || c_name || '|' || '=' || c_mktsegment || '|' || coalesce('=' || CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_nationkey AS STRING) END, 'null'))"


@query(f"""SELECT c_mktsegment AS part, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr({_MD5}, 1, 15) AS BIGINT) AS HUGEINT)) AS STRING) AS low,
       CAST(sum(CAST(CAST('0x' || substr({_MD5}, 16, 15) AS BIGINT) AS HUGEINT)) AS STRING) AS high FROM customer GROUP BY c_mktsegment""")
def b5_table_checksum(v: Views) -> DataFrame:
    c = v.table("customer").select(F.col("c_mktsegment").alias("part"), "c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("nation"))
    return state.table_checksum(c, ["c_custkey", "c_name", "c_mktsegment", "nation"], ["part"])


_GOT = "SELECT CASE WHEN id % 89 = 0 THEN id + 10000000 ELSE id END AS id, legacy, CASE WHEN id % 50 = 0 THEN 'x' ELSE filled END AS filled FROM v_backfill WHERE id % 97 <> 0"


@query(f"""SELECT * FROM (SELECT coalesce(w.id, g.id) AS id, CASE WHEN g.id IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'extra' WHEN w.filled IS DISTINCT FROM g.filled THEN 'changed' END AS kind,
       CASE WHEN w.id IS NOT NULL AND g.id IS NOT NULL THEN 'filled' ELSE '' END AS changed FROM v_backfill w FULL OUTER JOIN ({_GOT}) g ON g.id = w.id) d WHERE kind IS NOT NULL""")
def b6_row_diff(v: Views) -> DataFrame:
    want = v.backfill
    got = want.where("id % 97 <> 0").select(F.when(F.col("id") % 89 == 0, F.col("id") + 10_000_000).otherwise(F.col("id")).alias("id"), "legacy", F.when(F.col("id") % 50 == 0, "x").otherwise(F.col("filled")).alias("filled"))
    return state.row_diff(want, got, ["id"], ["legacy", "filled"])


_LINE = "sha256('=' || CAST(id AS STRING) || '|' || coalesce('=' || legacy, 'null') || '|' || coalesce('=' || filled, 'null'))"
_BUCKETS = 1000


def _tree_sql(buckets: int, fan: int) -> str:
    n, out = merkle.depth(buckets, fan), []
    for level in range(1, n + 1):
        out.append(f"""t{level} AS (SELECT CAST(floor(node / {fan}) AS BIGINT) AS node, CAST(sum(n_rows) AS BIGINT) AS n_rows, sha256(string_agg(lpad(CAST(node AS STRING), 20, '0') || '=' || digest, ',' ORDER BY node)) AS digest FROM t{level - 1} GROUP BY 1)""")
    return f""", line AS (SELECT CAST(('0x' || substr(md5('=' || CAST(id AS STRING)), 1, 8)) AS BIGINT) % {buckets} AS node, {_LINE} AS line FROM v_backfill),
t0 AS (SELECT node, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(line || ':' || CAST(n AS STRING), ',' ORDER BY line || ':' || CAST(n AS STRING))) AS digest FROM (SELECT node, line, count(*) AS n FROM line GROUP BY node, line) c GROUP BY node),
{', '.join(out)}
""" + " UNION ALL ".join(f"SELECT {level} AS level, node, n_rows, digest FROM t{level}" for level in range(n + 1))


@query(_tree_sql(_BUCKETS, merkle.FAN))
def b5_merkle_tree(v: Views) -> DataFrame:
    return merkle.tree(merkle.leaves(v.backfill, ["id"], ["legacy", "filled"], _BUCKETS), _BUCKETS)


@query(f"""SELECT * FROM (SELECT coalesce(w.id, g.id) AS id, CASE WHEN g.id IS NULL THEN 'missing' WHEN w.id IS NULL THEN 'extra' WHEN w.filled IS DISTINCT FROM g.filled THEN 'changed' END AS kind,
       CASE WHEN w.id IS NOT NULL AND g.id IS NOT NULL THEN 'filled' ELSE '' END AS changed FROM v_backfill w FULL OUTER JOIN ({_GOT}) g ON g.id = w.id) d WHERE kind IS NOT NULL""")
def b6_merkle_diff(v: Views) -> DataFrame:
    """Both tables digested in the shared folder, then compared from the roots down."""
    want = v.backfill
    got = want.where("id % 97 <> 0").select(F.when(F.col("id") % 89 == 0, F.col("id") + 10_000_000).otherwise(F.col("id")).alias("id"), "legacy", F.when(F.col("id") % 50 == 0, "x").otherwise(F.col("filled")).alias("filled"))
    paths = [f"{shared_folder(v.spark)}/digested-{uuid.uuid4().hex}" for _ in range(2)]
    for df, path in zip((want, got), paths):
        merkle.save_digested(df, path, ["id"], ["legacy", "filled"], _BUCKETS)
    return merkle.merkle_diff(v.spark, *paths, ["id"], ["legacy", "filled"], _BUCKETS)


_FOLD = """SELECT migration_no, step_no, coalesce(arg_max(event, seq) FILTER (WHERE event <> 'checkpoint'), 'pending') AS status, count(*) FILTER (WHERE event = 'running') AS attempts,
       coalesce(arg_max(error, seq) FILTER (WHERE event <> 'checkpoint'), '') AS error, arg_max(at_ts, seq) FILTER (WHERE event = 'running') AS started_at,
       arg_max(at_ts, seq) FILTER (WHERE event IN ('succeeded', 'failed')) AS finished_at, arg_max(position, seq) FILTER (WHERE position IS NOT NULL) AS checkpoint
  FROM v_ledger_events GROUP BY migration_no, step_no"""


@query(f"""SELECT 'invalid index' AS check_name, CAST(db AS STRING) || '.' || name AS detail FROM v_catalog_objects WHERE kind = 'index' AND NOT (valid AND ready)
UNION ALL SELECT 'unvalidated constraint', CAST(db AS STRING) || '.' || name FROM v_catalog_objects WHERE kind = 'constraint' AND NOT validated
UNION ALL SELECT 'step not succeeded', CAST(migration_no AS STRING) || '/' || CAST(step_no AS STRING) FROM ({_FOLD}) f WHERE status <> 'succeeded'
UNION ALL SELECT DISTINCT 'migration not succeeded', CAST(migration_no AS STRING) FROM ({_FOLD}) f WHERE status <> 'succeeded'
UNION ALL SELECT 'ownership held', CAST(resource AS STRING) FROM (SELECT resource, max(epoch) AS e FROM v_heartbeats GROUP BY resource) h WHERE e % 2 = 1
UNION ALL SELECT 'idle in transaction', CAST(pid AS STRING) FROM v_activity WHERE state = 'idle in transaction'""")
def b7_problem_report(v: Views) -> DataFrame:
    held = v.heartbeats.groupBy("resource").agg((F.max("epoch") % 2 == 1).alias("held"))
    return state.problem_report(v.catalog_objects, ledger.ledger_fold(v.ledger_events), held, v.activity)


_SATISFIED = """SELECT e.db, e.migration_no, e.step_no, e.step_kind, e.kind, e.name, CASE e.kind WHEN 'other' THEN NULL WHEN 'index' THEN coalesce(c.valid AND c.ready, FALSE) WHEN 'index_absent' THEN c.db IS NULL ELSE c.db IS NOT NULL END AS satisfied
  FROM v_expected_objects e LEFT JOIN v_catalog_objects c ON c.db = e.db AND c.kind = replace(e.kind, '_absent', '') AND c.schema_name = e.schema_name AND c.name = e.name AND c.member = e.member"""
_STEPS = f"""SELECT db, migration_no, step_no, step_kind, CASE WHEN count(*) = count(satisfied) THEN bool_and(satisfied) END AS satisfied FROM ({_SATISFIED}) s GROUP BY db, migration_no, step_no, step_kind"""
_BY = ["db", "migration_no", "step_no"]


def _objects(v: Views) -> DataFrame:
    return state.object_satisfied(v.expected_objects, v.catalog_objects)


def _steps(v: Views) -> DataFrame:
    objects = _objects(v)
    return state.step_satisfied(objects.select(*_BY, "step_kind").distinct(), objects, _BY)


@query(_SATISFIED)
def b8_object_satisfied(v: Views) -> DataFrame:
    return _objects(v).select(*_BY, "step_kind", "kind", "name", "satisfied")


@query(_STEPS)
def b9_step_satisfied(v: Views) -> DataFrame:
    return _steps(v)


@query(f"SELECT * FROM ({_STEPS}) s WHERE step_kind IN ('ddl_notx', 'backfill') AND satisfied IS NULL")
def b10_refused_steps(v: Views) -> DataFrame:
    return state.refused_steps(_steps(v))


@query(f"""SELECT db, migration_no, step_no, step_kind, satisfied, bool_or(NOT done) OVER (PARTITION BY db ORDER BY migration_no, step_no) AS pending FROM (
SELECT s.*, coalesce(s.satisfied, s.step_kind = 'ddl_tx' AND coalesce(s.db % 2 = 0 AND s.step_no < 3, FALSE)) AS done FROM ({_STEPS}) s) d""")
def b11_pending_steps(v: Views) -> DataFrame:
    steps = _steps(v)
    said = steps.where("db % 2 = 0 and step_no < 3").select(*_BY, F.lit("succeeded").alias("status"))
    return state.pending_steps(steps, said, _BY).select(*_BY, "step_kind", "satisfied", "pending")


@query("SELECT p.migration_no, p.step_no, p.checksum AS planned, l.checksum AS recorded FROM v_plan_steps p JOIN v_ledger_rows l ON l.migration_no = p.migration_no AND l.step_no = p.step_no WHERE l.status = 'succeeded' AND p.checksum <> l.checksum")
def b12_checksum_drift(v: Views) -> DataFrame:
    return state.checksum_drift(v.plan_steps, v.ledger_rows)


@query("SELECT doc_id, sha256(regexp_replace(lower(regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), '[ \\t\\r\\n]+', ' ', 'g')) AS checksum FROM documents")
def b13_normalized_checksum(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", state.normalized_checksum(F.col("text")).alias("checksum"))


@query("""SELECT q.relation, s.relation IS NOT NULL AS exists, greatest(coalesce(s.n_rows, 0), 0) AS n_rows, greatest(coalesce(s.n_bytes, 0), 0) AS n_bytes
  FROM (SELECT DISTINCT relation FROM v_ddl_actions) q LEFT JOIN (SELECT relation, CASE WHEN n_rows % 5 = 0 THEN n_rows ELSE -1 END AS n_rows, n_bytes FROM v_relation_stats) s ON s.relation = q.relation""")
def b14_relation_stats(v: Views) -> DataFrame:
    known = v.relation_stats.withColumn("n_rows", F.when(F.col("n_rows") % 5 == 0, F.col("n_rows")).otherwise(-1))
    return state.relation_stats(v.ddl_actions, known)


@query("""SELECT relation, string_agg(name, ',' ORDER BY ord) AS columns, CASE WHEN count(*) = 1 THEN max(name) END AS paging_key FROM (
SELECT k.relation, k.ord, a.name FROM (SELECT relation, unnest(string_split(conkey, ',')) AS attnum, generate_subscripts(string_split(conkey, ','), 1) AS ord FROM v_constraint_keys) k
  JOIN v_attributes a ON a.relation = k.relation AND a.attnum = CAST(k.attnum AS INTEGER)) x GROUP BY relation""")
def b15_primary_key_columns(v: Views) -> DataFrame:
    keys = v.constraint_keys.select("relation", F.transform(F.split("conkey", ","), lambda x: x.cast("int")).alias("conkey"))
    return state.primary_key_columns(keys, v.attributes).withColumn("columns", F.array_join("columns", ","))


# --- C


@query("""SELECT coalesce(l.migration_no, p.migration_no) AS migration_no, coalesce(l.step_no, p.step_no) AS step_no, coalesce(p.kind, l.kind) AS kind, coalesce(l.status, 'pending') AS status,
       coalesce(l.attempts, 0) AS attempts, coalesce(l.checksum, p.checksum) AS checksum FROM v_ledger_rows l FULL OUTER JOIN v_plan_steps p ON l.migration_no = p.migration_no AND l.step_no = p.step_no""")
def c1_ledger_upsert(v: Views) -> DataFrame:
    return ledger.ledger_upsert(v.ledger_rows, v.plan_steps)


@query(f"SELECT migration_no, step_no, status, attempts, error, {_MICROS_SQL.format('started_at')} AS started_us, {_MICROS_SQL.format('finished_at')} AS finished_us, checkpoint FROM ({_FOLD}) f")
def c2_ledger_fold(v: Views) -> DataFrame:
    return ledger.ledger_fold(v.ledger_events).select("migration_no", "step_no", "status", "attempts", "error", micros("started").alias("started_us"), micros("finished").alias("finished_us"), "checkpoint")


@query(f"""SELECT migration_no, step_no, status, attempts, error, CASE WHEN checkpoint IS NULL THEN '' ELSE '{{"cursor":' || CAST(checkpoint AS STRING) || '}}' END AS checkpoint FROM ({_FOLD}) f""")
def c3_status_report(v: Views) -> DataFrame:
    return ledger.status_report(ledger.ledger_fold(v.ledger_events), v.plan_steps)


_SUMMARY = """SELECT job, run_no, count(DISTINCT migration_no) AS migrations, count(*) AS steps_total, count(*) FILTER (WHERE outcome = 'applied') AS applied, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE repaired) AS repaired,
       CAST(sum(took_us) AS BIGINT) AS duration_us FROM v_step_results GROUP BY job, run_no"""


@query(_SUMMARY)
def c4_run_summary(v: Views) -> DataFrame:
    return ledger.run_summary(v.step_results)


@query(f"SELECT job, run_no, applied = 0 AND repaired = 0 AS converged FROM (SELECT *, lag(run_no) OVER (PARTITION BY job ORDER BY run_no) AS prior FROM ({_SUMMARY}) s) x WHERE prior IS NOT NULL")
def c5_convergence_check(v: Views) -> DataFrame:
    return ledger.convergence_check(ledger.run_summary(v.step_results))


@query("SELECT * FROM v_ledger_rows WHERE attempts > 0 OR status IN ('running', 'failed')")
def c6_reconcile_candidates(v: Views) -> DataFrame:
    return ledger.reconcile_candidates(v.ledger_rows)


@query("""SELECT seq, resource, owner, epoch, epoch = max(epoch) OVER (PARTITION BY resource ORDER BY seq) AND owner = first_value(owner) OVER (PARTITION BY resource, epoch ORDER BY seq) AS accepted FROM v_heartbeats""")
def c7_stale_writer_filter(v: Views) -> DataFrame:
    return ledger.stale_writer_filter(v.heartbeats.select("seq", "resource", "owner", "epoch"))


TTL_US = 600_000_000


def _intervals_sql(rows: str) -> str:
    """Intervals of beats and releases (seq, resource, owner, epoch, at_us, kind)."""
    return f""", h AS ({rows}),
pair AS (SELECT r.seq, r.resource, r.owner, r.epoch, r.at_us, arg_max({{'owner': b.owner, 'epoch': b.epoch, 'at_us': b.at_us, 'seq': b.seq}}, (b.at_us, b.seq)) AS last
  FROM h r LEFT JOIN h b ON b.kind = 'beat' AND b.resource = r.resource AND (b.at_us, b.seq) < (r.at_us, r.seq) WHERE r.kind = 'release' GROUP BY ALL),
fits AS (SELECT *, row_number() OVER (PARTITION BY resource, last.at_us, last.seq ORDER BY at_us, seq) AS k FROM pair WHERE last.owner = owner AND last.epoch = epoch AND at_us - last.at_us <= {TTL_US}),
beat AS (SELECT h.*, f.at_us AS released FROM h LEFT JOIN fits f ON f.k = 1 AND f.resource = h.resource AND f.last.seq = h.seq AND f.last.at_us = h.at_us WHERE h.kind = 'beat'),
spans AS (SELECT resource, island, min(owner) AS owner, min(epoch) AS epoch, min(at_us) AS started, max(at_us) AS last, max(released) AS released, count(*) AS beats FROM (
SELECT *, sum(fresh) OVER (PARTITION BY resource ORDER BY at_us, seq) AS island FROM (
SELECT *, CASE WHEN coalesce(lag(owner) OVER w <> owner OR lag(epoch) OVER w <> epoch OR at_us - lag(at_us) OVER w > {TTL_US} OR lag(released) OVER w IS NOT NULL, TRUE) THEN 1 ELSE 0 END AS fresh
  FROM beat WINDOW w AS (PARTITION BY resource ORDER BY at_us, seq)) a) b GROUP BY resource, island)
SELECT resource, owner, epoch, started, coalesce(released, least(last + {TTL_US}, coalesce(nxt, last + {TTL_US}))) AS ended, beats, CASE WHEN released IS NOT NULL THEN 'released' WHEN nxt <= last + {TTL_US} THEN 'lost' ELSE 'expired' END AS how
  FROM (SELECT *, lead(started) OVER (PARTITION BY resource ORDER BY island) AS nxt FROM spans) d"""


_BEATS = f"SELECT seq, resource, owner, epoch, {_MICROS_SQL.format('at_ts')} AS at_us"


@query(_intervals_sql(f"{_BEATS}, 'beat' AS kind FROM v_heartbeats"))
def c8_ownership_intervals(v: Views) -> DataFrame:
    return ledger.ownership_intervals(v.heartbeats.select("seq", "resource", "owner", "epoch", micros("at_ts").alias("at_us")), TTL_US)


@query(_intervals_sql(f"{_BEATS}, kind FROM v_heartbeats"))
def c8_released_intervals(v: Views) -> DataFrame:
    return ledger.ownership_intervals(v.heartbeats.select("seq", "resource", "owner", "epoch", micros("at_ts").alias("at_us"), "kind"), TTL_US)


def _held(beats: DataFrame) -> DataFrame:
    return beats.select("resource", "owner", micros("at_ts").alias("started"), (micros("at_ts") + 20_000_000_000).alias("ended"))


_OVERLAPS = f""", i AS (SELECT seq, resource, owner, {_MICROS_SQL.format('at_ts')} AS started, {_MICROS_SQL.format('at_ts')} + 20000000000 AS ended FROM v_heartbeats)
SELECT a.resource, a.owner, a.started, a.ended, count(*) AS others_open FROM i a JOIN i b ON a.resource = b.resource AND a.owner <> b.owner AND b.ended > a.started
   AND (b.started < a.started OR (b.started = a.started AND (b.ended < a.ended OR (b.ended = a.ended AND b.owner < a.owner)))) GROUP BY a.seq, a.resource, a.owner, a.started, a.ended"""


@query(_OVERLAPS)
def c9_overlapping_owners(v: Views) -> DataFrame:
    return ledger.overlapping_owners(_held(v.heartbeats))


@query(_OVERLAPS)
def c9_overlapping_owners_whole(v: Views) -> DataFrame:
    """The name under which the whole input was first covered."""
    return ledger.overlapping_owners(_held(v.heartbeats))


@query("SELECT *, CAST(row_number() OVER (PARTITION BY db ORDER BY migration_no, step_no) AS INTEGER) AS position, count(*) OVER (PARTITION BY db) AS total FROM v_plan_steps")
def c10_step_order_and_numbering(v: Views) -> DataFrame:
    return ledger.step_order_and_numbering(v.plan_steps)


# --- D

_APPLIED = "SELECT db, version FROM (SELECT db, version, arg_max(is_applied, id) AS ok FROM v_history_log WHERE version <> 0 GROUP BY db, version) h WHERE ok"
_REPORT = f"""SELECT coalesce(f.db, a.db) AS db, coalesce(f.version, a.version) AS version, CASE WHEN f.version IS NULL THEN 'no file' WHEN a.version IS NULL THEN 'recheck' ELSE 'adopted' END AS state
  FROM v_history_files f FULL OUTER JOIN ({_APPLIED}) a ON a.db = f.db AND a.version = f.version"""
_MARKS = "SELECT d.db, CAST(CASE WHEN m.version IS NULL THEN -1 WHEN m.dirty THEN m.version - 1 ELSE m.version END AS BIGINT) AS mark, coalesce(m.dirty, FALSE) AS dirty FROM (SELECT DISTINCT db FROM v_history_log) d LEFT JOIN v_history_marks m ON m.db = d.db"


def _adopted(v: Views) -> DataFrame:
    return adoption.adoption_report(v.history_files, adoption.latest_per_version(v.history_log, ["db"]), ["db"])


@query(_APPLIED)
def d1_latest_per_version(v: Views) -> DataFrame:
    return adoption.latest_per_version(v.history_log, ["db"])


@query(_MARKS)
def d2_high_water_mark(v: Views) -> DataFrame:
    return adoption.high_water_mark(v.history_marks, v.history_log.select("db").distinct())


@query(f"SELECT 'set' AS history, db, version, state FROM ({_REPORT}) r UNION ALL SELECT 'mark', f.db, f.version, CASE WHEN f.version <= m.mark THEN 'adopted' ELSE 'recheck' END FROM v_history_files f JOIN ({_MARKS}) m ON m.db = f.db")
def d3_adoption_report(v: Views) -> DataFrame:
    marks = adoption.high_water_mark(v.history_marks, v.history_log.select("db").distinct())
    by_set = _adopted(v).select(F.lit("set").alias("history"), "db", "version", "state")
    return by_set.unionByName(adoption.adoption_by_mark(v.history_files, marks).select(F.lit("mark").alias("history"), "db", "version", "state"))


@query(f""", good AS (SELECT DISTINCT version FROM ({_REPORT}) r WHERE state = 'adopted'), plan AS (SELECT * FROM v_plan_steps WHERE migration_no IN (SELECT version FROM good))
SELECT coalesce(l.migration_no, p.migration_no) AS migration_no, coalesce(l.step_no, p.step_no) AS step_no, coalesce(p.kind, l.kind) AS kind,
       CASE WHEN coalesce(l.migration_no, p.migration_no) IN (SELECT version FROM good) THEN 'succeeded' ELSE coalesce(l.status, 'pending') END AS status, coalesce(l.attempts, 0) AS attempts, coalesce(l.checksum, p.checksum) AS checksum
  FROM v_ledger_rows l FULL OUTER JOIN plan p ON l.migration_no = p.migration_no AND l.step_no = p.step_no""")
def d4_adopt(v: Views) -> DataFrame:
    return adoption.adopt(v.ledger_rows, v.plan_steps, _adopted(v).where("state = 'adopted'"))


@query(f"SELECT db, count(*) FILTER (WHERE state = 'adopted') AS adopted, count(*) FILTER (WHERE state = 'recheck') AS recheck, count(*) FILTER (WHERE state = 'no file') AS no_file FROM ({_REPORT}) r GROUP BY db")
def d5_fleet_adoption(v: Views) -> DataFrame:
    return adoption.fleet_adoption(_adopted(v))


# --- E

_TAGGED = "SELECT l.*, CASE WHEN l.at_ts < r.change_start THEN 'baseline' ELSE 'during' END AS phase FROM v_latencies l JOIN v_runs r ON r.run_id = l.run_id"
_FIGURES = """count(took_us) AS n, CAST(coalesce(quantile_disc(took_us, 0.5), 0) AS BIGINT) AS p50, CAST(coalesce(quantile_disc(took_us, 0.99), 0) AS BIGINT) AS p99,
       CAST(coalesce(quantile_disc(took_us, 0.999), 0) AS BIGINT) AS p999, CAST(coalesce(max(took_us), 0) AS BIGINT) AS max"""
_OVERALL = f"""SELECT run_id, phase, class, {_FIGURES} FROM ({_TAGGED}) t GROUP BY run_id, phase, class
UNION ALL SELECT run_id, phase, '' AS class, {_FIGURES} FROM ({_TAGGED}) t WHERE class <> 'slow_read' GROUP BY run_id, phase"""


def _tagged(v: Views) -> DataFrame:
    return latency.tag_phase(v.latencies, v.runs)


@query(f"SELECT sample_id, run_id, class, took_us, phase FROM ({_TAGGED}) t")
def e1_tag_phase(v: Views) -> DataFrame:
    return _tagged(v).select("sample_id", "run_id", "class", "took_us", "phase")


_CHANGES = f"""SELECT l.sample_id, l.run_id, l.class, l.took_us, c.change_no, CASE WHEN c.change_no IS NULL THEN 'baseline' ELSE 'during' END AS phase
  FROM v_latencies l LEFT JOIN v_changes c ON c.run_id = l.run_id AND c.started <= l.at_ts AND (c.ended IS NULL OR l.at_ts < c.ended)"""


def _with_changes(v: Views) -> tuple[DataFrame, DataFrame]:
    changes = v.changes.select("run_id", "change_no", micros("started").alias("started_us"), micros("ended").alias("ended_us"))
    return v.latencies.withColumn("at_us", micros("at_ts")).drop("at_ts"), changes


@query(_CHANGES)
def e1_tag_changes(v: Views) -> DataFrame:
    return latency.tag_changes(*_with_changes(v)).drop("at_us")


@query(f"SELECT run_id, change_no, class, {_FIGURES} FROM ({_CHANGES}) c GROUP BY run_id, change_no, class")
def e2_quantiles_by_change(v: Views) -> DataFrame:
    """Many overlapping changes a run: figures of each, and of what no change touches."""
    return latency.quantiles_by_change(*_with_changes(v), ["class"])


@query(f"SELECT run_id, class, {_FIGURES} FROM v_latencies GROUP BY run_id, class")
def e2_quantiles(v: Views) -> DataFrame:
    return latency.quantiles(v.latencies, ["run_id", "class"])


@query(f"SELECT class, {_FIGURES} FROM v_latencies GROUP BY class")
def e2_quantiles_ranked(v: Views) -> DataFrame:
    return latency.quantiles_ranked(v.latencies, ["class"])


@query(_OVERALL)
def e3_overall(v: Views) -> DataFrame:
    return latency.overall(_tagged(v))


_SIDE = ", ".join(f"CAST(coalesce(max(CASE WHEN phase = '{p}' THEN {c} END), 0) AS BIGINT) AS {p}_{c}" for p in ("baseline", "during") for c in ("n", "p50", "p99", "p999", "max"))
_RATIO = ", ".join(f"CASE WHEN baseline_{c} > 0 THEN during_{c} / baseline_{c} END AS ratio_{c}" for c in ("p50", "p99", "p999", "max"))


@query(f"SELECT *, {_RATIO} FROM (SELECT run_id, {_SIDE} FROM ({_OVERALL}) o WHERE class = '' GROUP BY run_id) s")
def e4_before_after(v: Views) -> DataFrame:
    return latency.before_after(latency.overall(_tagged(v)).where("class = ''"))


_READINGS = """SELECT a.reading_no, a.run_id, CASE WHEN a.wait_event IS NULL THEN '' ELSE a.wait_type || ':' || a.wait_event END AS event, coalesce(l.relation, '') AS relation, a.waiting_us
  FROM v_activity a LEFT JOIN (SELECT DISTINCT sample_at, pid, relation FROM v_locks WHERE NOT granted AND locktype = 'relation') l ON l.sample_at = a.sample_at AND l.pid = a.pid WHERE a.state = 'active'"""


def _readings(v: Views) -> DataFrame:
    return latency.active_readings(v.activity, v.locks)


@query(_READINGS)
def e5_active_readings(v: Views) -> DataFrame:
    return _readings(v)


@query(f"""SELECT * FROM (SELECT run_id, event, samples, share, CAST(row_number() OVER (PARTITION BY run_id ORDER BY samples DESC, event) AS INTEGER) AS rank FROM (
SELECT run_id, event, count(*) AS samples, count(*) / sum(count(*)) OVER (PARTITION BY run_id) AS share FROM ({_READINGS}) r GROUP BY run_id, event) s WHERE event <> '') t WHERE rank <= 4""")
def e6_wait_attribution(v: Views) -> DataFrame:
    return latency.wait_attribution(_readings(v)).select("run_id", "event", "samples", "share", "rank")


_BLOCKED = f"""SELECT run_id, count(*) FILTER (WHERE event <> '' AND relation <> '') AS blocked, CAST(coalesce(max(waiting_us) FILTER (WHERE event <> '' AND relation <> '' AND waiting_us > 0), 0) AS BIGINT) AS longest_us,
       coalesce(first(relation ORDER BY waiting_us DESC, reading_no) FILTER (WHERE event <> '' AND relation <> '' AND waiting_us > 0), '') AS longest_relation FROM ({_READINGS}) r GROUP BY run_id"""


@query(_BLOCKED)
def e7_blocked_readings(v: Views) -> DataFrame:
    return latency.blocked_readings(_readings(v))


@query(f"""SELECT run_id, blocked, waits - blocked AS other_waits, CASE WHEN waits > 0 THEN blocked / waits ELSE 0.0 END AS share FROM (
SELECT run_id, count(*) FILTER (WHERE event <> '' AND relation <> '') AS blocked, count(*) FILTER (WHERE event <> '') AS waits FROM ({_READINGS}) r GROUP BY run_id) x""")
def e8_blocked_share(v: Views) -> DataFrame:
    return latency.blocked_share(_readings(v))


_TERMS = """SELECT run_id, term, CASE WHEN problem = '' THEN us END AS limit_us, problem FROM (
SELECT *, CASE WHEN value IS NULL THEN 'not name=duration' WHEN us IS NULL THEN 'not a duration' WHEN us <= 0 THEN 'a limit must be positive' WHEN term NOT IN ('p50', 'p99', 'p999', 'max_block') THEN 'unknown term' ELSE '' END AS problem FROM (
SELECT *, CASE WHEN regexp_matches(value, '^[-+]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)(ns|us|ms|s|m|h))+$') THEN CAST(floor((CASE WHEN value LIKE '-%' THEN -1 ELSE 1 END) *
  list_sum(list_transform(regexp_extract_all(value, '[0-9.]+(ns|us|ms|s|m|h)'), lambda t: CAST(regexp_extract(t, '^[0-9.]+') AS DOUBLE) * CASE regexp_extract(t, '[a-z]+$') WHEN 'ns' THEN 0.001 WHEN 'us' THEN 1 WHEN 'ms' THEN 1000 WHEN 's' THEN 1000000 WHEN 'm' THEN 60000000 ELSE 3600000000 END))) AS BIGINT) END AS us FROM (
SELECT run_id, trim(split_part(part, '=', 1)) AS term, CASE WHEN instr(part, '=') > 0 THEN trim(split_part(part, '=', 2)) END AS value FROM (
SELECT run_id, unnest(string_split(budget, ',')) AS part FROM v_runs WHERE trim(budget) <> '') a) b) c) d"""
_VIOLATIONS = f"""SELECT t.run_id, t.term, t.limit_us AS allowed_us, CAST(x.reached AS BIGINT) AS reached_us FROM ({_TERMS}) t JOIN (
SELECT run_id, 'p50' AS term, p50 AS reached FROM ({_OVERALL}) o WHERE phase = 'during' AND class = '' UNION ALL SELECT run_id, 'p99', p99 FROM ({_OVERALL}) o WHERE phase = 'during' AND class = ''
UNION ALL SELECT run_id, 'p999', p999 FROM ({_OVERALL}) o WHERE phase = 'during' AND class = '' UNION ALL SELECT run_id, 'max_block', longest_us FROM ({_BLOCKED}) b) x ON x.run_id = t.run_id AND x.term = t.term
 WHERE t.problem = '' AND x.reached > t.limit_us"""


def _violations(v: Views) -> DataFrame:
    return latency.violations(latency.overall(_tagged(v)), latency.blocked_readings(_readings(v)), latency.budget_terms(v.runs))


@query(_TERMS)
def e9_budget_terms(v: Views) -> DataFrame:
    return latency.budget_terms(v.runs)


@query(_VIOLATIONS)
def e10_violations(v: Views) -> DataFrame:
    return _violations(v)


@query(f"SELECT r.run_id, coalesce(x.n, 0) AS n_violations, coalesce(x.n, 0) > 0 OR NOT r.applied AS failed FROM v_runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM ({_VIOLATIONS}) v GROUP BY run_id) x ON x.run_id = r.run_id")
def e11_verdict(v: Views) -> DataFrame:
    return latency.verdict(v.runs, _violations(v))


@query(f"""SELECT r.run_id, 'no slow reader' AS problem FROM v_runs r WHERE r.run_id NOT IN (SELECT run_id FROM ({_TAGGED}) t WHERE class = 'slow_read')
UNION ALL SELECT r.run_id, 'nothing measured in baseline' FROM v_runs r WHERE r.run_id NOT IN (SELECT run_id FROM ({_TAGGED}) t WHERE phase = 'baseline')
UNION ALL SELECT r.run_id, 'nothing measured in during' FROM v_runs r WHERE r.run_id NOT IN (SELECT run_id FROM ({_TAGGED}) t WHERE phase = 'during')""")
def e12_coverage_check(v: Views) -> DataFrame:
    return latency.coverage_check(v.runs, _tagged(v))


# --- F

_RATES = """SELECT *, least(rewrite_bytes, rewrite_rows, index_bytes, index_rows) > 0 AS known FROM (
SELECT server, max(CASE WHEN rewrite_us < 1000 THEN 0.0 ELSE n_bytes / (rewrite_us / 1e6) END) AS rewrite_bytes, max(CASE WHEN rewrite_us < 1000 THEN 0.0 ELSE n_rows / (rewrite_us / 1e6) END) AS rewrite_rows,
       max(CASE WHEN index_us < 1000 THEN 0.0 ELSE n_bytes / (index_us / 1e6) END) AS index_bytes, max(CASE WHEN index_us < 1000 THEN 0.0 ELSE n_rows / (index_us / 1e6) END) AS index_rows FROM v_probes GROUP BY server) p"""
_ESTIMATE = f"""SELECT server, relation, CASE WHEN ok THEN cost * 0.75 END AS low_s, CASE WHEN ok THEN cost * 2.0 END AS high_s FROM (
SELECT *, coalesce(known, FALSE) AND duration > 1 AND n_bytes > 0 AND cost * 2.0 >= 1 AS ok FROM (
SELECT m.server, m.relation, m.duration, s.n_bytes, t.known, greatest(CASE WHEN m.duration = 4 THEN CASE WHEN index_bytes > 0 THEN n_bytes / index_bytes ELSE 0.0 END ELSE CASE WHEN rewrite_bytes > 0 THEN n_bytes / rewrite_bytes ELSE 0.0 END END,
       CASE WHEN m.duration = 4 THEN CASE WHEN index_rows > 0 THEN n_rows / index_rows ELSE 0.0 END ELSE CASE WHEN rewrite_rows > 0 THEN n_rows / rewrite_rows ELSE 0.0 END END) AS cost
  FROM v_measured m LEFT JOIN v_relation_stats s ON s.relation = m.relation LEFT JOIN ({_RATES}) t ON t.server = m.server) c) d"""


def _estimates(v: Views) -> DataFrame:
    return sizing.estimate(v.measured, v.relation_stats, sizing.throughput(v.probes))


@query(_RATES)
def f1_throughput(v: Views) -> DataFrame:
    return sizing.throughput(v.probes)


@query(f"SELECT server, relation, round(low_s, 6) AS low_s, round(high_s, 6) AS high_s FROM ({_ESTIMATE}) e")
def f2_estimate(v: Views) -> DataFrame:
    return _estimates(v).withColumns({c: F.round(c, 6) for c in ("low_s", "high_s")})


@query(f"""SELECT e.server, count(*) AS n, count(*) FILTER (WHERE greatest(took_us / 1e6 / ((low_s + high_s) / 2), ((low_s + high_s) / 2) / (took_us / 1e6)) <= 2) AS within_2
  FROM ({_ESTIMATE}) e JOIN v_measured m ON m.server = e.server AND m.relation = e.relation WHERE low_s IS NOT NULL AND took_us > 0 GROUP BY e.server""")
def f3_estimate_accuracy(v: Views) -> DataFrame:
    return sizing.estimate_accuracy(_estimates(v), v.measured)


_SIZES = "(SELECT q.relation, s.relation IS NOT NULL AS there, coalesce(s.n_rows, 0) AS n_rows, coalesce(s.n_bytes, 0) AS n_bytes FROM (SELECT DISTINCT relation FROM v_ddl_actions) q LEFT JOIN v_relation_stats s ON s.relation = q.relation) z"


@query(f"SELECT relation, CASE WHEN NOT there THEN 2 WHEN n_rows >= 1000000 OR n_bytes >= 1073741824 THEN 3 WHEN n_rows < 10000 AND n_bytes < 8388608 THEN 1 ELSE 2 END AS severity FROM {_SIZES}")
def f4_size_grade(v: Views) -> DataFrame:
    stats = state.relation_stats(v.ddl_actions, v.relation_stats)
    return stats.select("relation", sizing.size_grade(F.col("exists"), F.col("n_rows"), F.col("n_bytes")).alias("severity"))


@query(f"SELECT relation, there AND (n_rows >= 1000000 OR n_bytes >= 200000000) AS large FROM {_SIZES}")
def f5_is_large(v: Views) -> DataFrame:
    stats = state.relation_stats(v.ddl_actions, v.relation_stats)
    return stats.select("relation", sizing.is_large(F.col("exists"), F.col("n_rows"), F.col("n_bytes"), big_bytes=200_000_000).alias("large"))


def _tenths_sql(x: str) -> str:
    return f"CAST(CAST(floor(floor({x} * 10 + 0.5) / 10) AS BIGINT) AS STRING) || '.' || CAST(CAST(floor({x} * 10 + 0.5) AS BIGINT) % 10 AS STRING)"


@query(f"""SELECT l_orderkey, l_linenumber, n, CASE WHEN n >= 1000000000 THEN {_tenths_sql('(n / 1000000000)')} || 'B' WHEN n >= 1000000 THEN {_tenths_sql('(n / 1000000)')} || 'M' WHEN n >= 1000 THEN {_tenths_sql('(n / 1000)')} || 'k' ELSE CAST(n AS STRING) END AS rows_text,
       CASE WHEN n >= 1099511627776 THEN {_tenths_sql('(n / 1099511627776)')} || ' TB' WHEN n >= 1073741824 THEN {_tenths_sql('(n / 1073741824)')} || ' GB' WHEN n >= 1048576 THEN {_tenths_sql('(n / 1048576)')} || ' MB' WHEN n >= 1024 THEN {_tenths_sql('(n / 1024)')} || ' kB' ELSE CAST(n AS STRING) || ' B' END AS bytes_text,
       CASE WHEN n >= 3600000000 THEN CAST(CAST(floor(mi / 60) AS BIGINT) AS STRING) || 'h' || CAST(mi % 60 AS STRING) || 'm0s'
            WHEN n >= 60000000 THEN CASE WHEN se >= 3600 THEN CAST(CAST(floor(se / 3600) AS BIGINT) AS STRING) || 'h0m0s' ELSE CAST(CAST(floor(se / 60) AS BIGINT) AS STRING) || 'm' || CAST(se % 60 AS STRING) || 's' END
            WHEN te >= 600 THEN '1m0s' WHEN te % 10 = 0 THEN CAST(CAST(floor(te / 10) AS BIGINT) AS STRING) || 's' ELSE CAST(CAST(floor(te / 10) AS BIGINT) AS STRING) || '.' || CAST(te % 10 AS STRING) || 's' END AS duration_text
  FROM (SELECT *, CAST(floor(n / 6e7 + 0.5) AS BIGINT) AS mi, CAST(floor(n / 1e6 + 0.5) AS BIGINT) AS se, CAST(floor(n / 1e5 + 0.5) AS BIGINT) AS te FROM (
SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 977 WHEN 2 THEN 1000003 ELSE 90000049 END AS n FROM lineitem) a) b""")
def f6_humanize(v: Views) -> DataFrame:
    scale = F.when(F.col("l_linenumber") % 4 == 0, 1).when(F.col("l_linenumber") % 4 == 1, 977).when(F.col("l_linenumber") % 4 == 2, 1000003).otherwise(90000049)
    n = v.table("lineitem").select("l_orderkey", "l_linenumber", (F.floor("l_extendedprice").cast("long") * scale.cast("long")).alias("n"))
    return n.select("*", humanize_rows(F.col("n")).alias("rows_text"), humanize_bytes(F.col("n")).alias("bytes_text"), humanize_duration(F.col("n")).alias("duration_text"))
