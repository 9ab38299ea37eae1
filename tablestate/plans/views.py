"""Views over the given tables that give every operator data, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

_LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"

#: Kinds of schema changes: the common ones first. A few more would be no kinds of the rule table.
KINDS = """
create_table create_index add_column alter_type set_not_null add_foreign_key add_check drop_table rename_column truncate update delete grant add_enum_value
validate_constraint add_primary_key vacuum_full refresh_view attach_partition lock_table drop_column rename_table cluster use_enum_value drop_view drop_sequence
drop_index rename_index vacuum analyze reindex_index reindex_table create_partition create_referencing column_default drop_not_null add_exclusion drop_constraint
column_setting storage_setting detach_partition alter_other select select_for_update insert grant_all reindex_schema cluster_all""".split()
_KIND = f"split_part('{' '.join(KINDS)}', ' ', CAST((l_partkey + rn) % {len(KINDS)} + 1 AS INTEGER))"
_Q = "CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING)"

VIEWS: dict[str, str] = {
    # A
    "v_backfill": """
SELECT o_orderkey - 100 AS id, o_orderpriority AS legacy,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE NULL END AS filled
  FROM orders""",
    "v_batch_log": f"""
SELECT l_suppkey AS job, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_ORDER}) AS batch_no,
       CAST(floor(l_quantity * 25) AS BIGINT) AS size, CAST(floor(l_extendedprice / 100) AS BIGINT) AS took_ms,
       CAST(floor(l_discount * 100000) AS BIGINT) AS lag_bytes, CAST(5000 AS BIGINT) AS max_lag_bytes
  FROM lineitem""",
    "v_manifest": """
SELECT job, batch_no AS wave, batch_no * 1000 - 500 AS position, size AS n_rows FROM v_batch_log WHERE job % 7 <> 0""",
    "v_replicas": """
SELECT l_suppkey % 10 AS cluster, CAST(l_linenumber AS BIGINT) AS sample, CAST(floor(l_extendedprice * 10) AS BIGINT) AS sent,
       CASE WHEN l_returnflag = 'A' OR l_suppkey % 10 = 3 THEN NULL ELSE CAST(floor(l_extendedprice * 10) AS BIGINT) - CAST(floor(l_discount * 1000) AS BIGINT) END AS replay
  FROM lineitem""",
    # B, C
    "v_plan_steps": """
SELECT o_custkey AS migration_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS step_no,
       o_custkey % 20 AS db, CASE o_orderstatus WHEN 'F' THEN 'ddl_tx' WHEN 'O' THEN 'ddl_notx' ELSE 'backfill' END AS kind,
       md5(o_orderpriority) AS checksum
  FROM orders""",
    "v_ledger_rows": """
SELECT migration_no, step_no, 'old_' || kind AS kind, CASE migration_no % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'succeeded' END AS status,
       migration_no % 3 AS attempts, CASE WHEN step_no % 2 = 0 THEN checksum ELSE md5(checksum) END AS checksum
  FROM v_plan_steps WHERE migration_no % 5 <> 0
UNION ALL SELECT -1 AS migration_no, CAST(0 AS BIGINT) AS step_no, 'gone' AS kind, 'succeeded' AS status, CAST(1 AS BIGINT) AS attempts, '-' AS checksum""",
    "v_ledger_events": """
SELECT l_orderkey AS migration_no, CAST(l_linenumber AS BIGINT) AS step_no,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
       l_shipdate AS at_ts,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed' WHEN l_returnflag = 'R' THEN 'running' WHEN l_returnflag = 'A' THEN 'succeeded' ELSE 'checkpoint' END AS event,
       CASE WHEN l_returnflag = 'N' THEN CAST(floor(l_quantity * 1000) AS BIGINT) ELSE NULL END AS position,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'lock timeout' ELSE '' END AS error
  FROM lineitem""",
    "v_step_results": """
SELECT o_custkey % 50 AS job, o_custkey AS migration_no, CAST(floor(o_totalprice) AS BIGINT) % 4 AS run_no, o_orderkey AS step,
       CASE WHEN o_custkey % 2 = 0 AND CAST(floor(o_totalprice) AS BIGINT) % 4 > 0 THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'applied' ELSE 'skipped' END AS outcome,
       CASE WHEN o_custkey % 2 = 0 AND CAST(floor(o_totalprice) AS BIGINT) % 4 > 0 THEN FALSE ELSE o_orderkey % 10 = 0 END AS repaired,
       CAST(floor(o_totalprice) AS BIGINT) AS took_us
  FROM orders""",
    "v_catalog_objects": """
SELECT s_nationkey AS db, kind, 'public' AS schema_name, name, '' AS member,
       bool_or(s_acctbal > 0) AS valid, bool_or(s_acctbal > 1000) AS ready, bool_or(s_acctbal > 500) AS validated
  FROM (SELECT s_nationkey, s_acctbal, 'obj_' || CAST(s_suppkey % 30 AS STRING) AS name,
               CASE s_suppkey % 5 WHEN 0 THEN 'index' WHEN 1 THEN 'column' WHEN 2 THEN 'constraint' WHEN 3 THEN 'relation' ELSE 'enum' END AS kind
          FROM supplier) s
 GROUP BY s_nationkey, kind, name""",
    "v_expected_objects": """
SELECT n_nationkey AS db, CASE WHEN n_nationkey % 5 = 0 AND k.step_no = 3 THEN 'other' ELSE k.kind END AS kind, 'public' AS schema_name, k.name, '' AS member,
       CAST(n_nationkey AS BIGINT) AS migration_no, k.step_no,
       CASE k.step_no WHEN 1 THEN 'ddl_notx' WHEN 3 THEN 'backfill' ELSE 'ddl_tx' END AS step_kind
  FROM nation
 CROSS JOIN (SELECT 'index' AS kind, 'obj_5' AS name, 0 AS step_no UNION ALL SELECT 'column', 'obj_11', 1
       UNION ALL SELECT 'constraint', 'obj_7', 1 UNION ALL SELECT 'relation', 'obj_3', 2
       UNION ALL SELECT 'enum', 'obj_4', 3 UNION ALL SELECT 'index_absent', 'obj_10', 4) k""",
    "v_cat_columns": """
SELECT CAST(c_nationkey AS BIGINT) AS db, CASE c_custkey % 9 WHEN 0 THEN 'pg_catalog' WHEN 1 THEN 'pg_temp' WHEN 2 THEN 'bookkeeping' ELSE 'public' END AS schema_name,
       'rel_' || CAST(c_custkey % 50 AS STRING) AS relation, 'col_' || CAST(c_custkey AS STRING) AS name, c_mktsegment AS data_type,
       CASE WHEN c_custkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS nullable, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '0' END AS default_text
  FROM customer""",
    "v_cat_relations": """
SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS db, s_suppkey % 40 AS oid, CASE s_suppkey % 7 WHEN 0 THEN 'pg_toast' WHEN 1 THEN 'bookkeeping' ELSE 'public' END AS schema_name,
       'rel_' || CAST(s_suppkey % 40 AS STRING) AS name, CASE s_suppkey % 4 WHEN 0 THEN 'i' WHEN 1 THEN 'v' ELSE 'r' END AS kind, 'owner_' || CAST(s_suppkey % 3 AS STRING) AS owner
  FROM supplier""",
    "v_cat_indexes": """
SELECT CAST(p_size % 25 AS BIGINT) AS db, p_partkey % 40 AS oid, p_partkey % 11 <> 0 AS valid, p_partkey % 13 <> 0 AS ready, TRUE AS live, 'btree (' || p_brand || ')' AS definition
  FROM part""",
    "v_cat_constraints": """
SELECT o_custkey % 25 AS db, CASE o_orderkey % 6 WHEN 0 THEN 'pg_x' ELSE 'public' END AS schema_name, 'rel_' || CAST(o_custkey % 40 AS STRING) AS relation,
       'con_' || CAST(o_orderkey AS STRING) AS name, o_orderstatus AS kind, o_orderkey % 8 <> 0 AS validated, 'CHECK ' || o_orderpriority AS definition
  FROM orders""",
    "v_cat_sequences": """
SELECT CAST(s_nationkey AS BIGINT) AS db, CASE s_suppkey % 9 WHEN 0 THEN 'pg_x' WHEN 1 THEN 'pg_catalog' ELSE 'public' END AS schema_name, 'seq_' || CAST(s_suppkey AS STRING) AS name,
       CAST(1 AS BIGINT) AS start_value, s_suppkey % 3 AS increment
  FROM supplier""",
    "v_cat_grants": """
SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS db, 'public' AS schema_name, 'rel_' || CAST(c_custkey % 50 AS STRING) AS relation, 'root' AS grantor, c_mktsegment AS grantee,
       CASE c_custkey % 2 WHEN 0 THEN 'SELECT' ELSE 'UPDATE' END AS privilege
  FROM customer""",
    "v_constraint_keys": """
SELECT DISTINCT 't' || CAST(p_size AS STRING) AS relation, CASE p_size % 3 WHEN 0 THEN '2' WHEN 1 THEN '3,1' ELSE '1,2,3' END AS conkey FROM part""",
    "v_attributes": """
SELECT DISTINCT 't' || CAST(p_size AS STRING) AS relation, a.attnum, 'c' || CAST(a.attnum AS STRING) AS name
  FROM part CROSS JOIN (SELECT 1 AS attnum UNION ALL SELECT 2 UNION ALL SELECT 3) a""",
    "v_heartbeats": """
SELECT event_id AS seq, user_id % 5 AS resource, 'owner_' || CAST(user_id % 3 AS STRING) AS owner,
       CAST(floor(event_id / 100) AS BIGINT) - CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS epoch, ts AS at_ts,
       CASE WHEN event_id % 13 = 0 THEN 'release' ELSE 'beat' END AS kind
  FROM events""",
    # D
    "v_history_log": """
SELECT event_id AS id, user_id % 3000 AS version, event_type <> 'error' AS is_applied, user_id % 4 AS db FROM events""",
    "v_history_files": """
SELECT DISTINCT user_id % 3000 + 20 AS version, user_id % 4 AS db FROM events""",
    "v_history_marks": """
SELECT db, max(version) AS version, db = 2 AS dirty FROM v_history_log WHERE db <> 3 AND version < 2000 GROUP BY db""",
    # E
    "v_runs": """
SELECT DISTINCT user_id % 10 AS run_id, TIMESTAMP '2024-01-16 00:00:00' AS change_start, user_id % 10 <> 3 AS applied,
       CASE user_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'p50=10ms, p99=250ms' WHEN 2 THEN 'p99=900us,max_block=100ms' WHEN 3 THEN 'p999=2s' WHEN 4 THEN 'p95=1s' WHEN 5 THEN 'p50' WHEN 6 THEN 'p50=0ms' WHEN 8 THEN 'p99=1m30s,p50=-1ms,p999=.5s20ms,max_block=5' ELSE 'max_block=50ms,p50=1h' END AS budget
  FROM events""",
    "v_latencies": """
SELECT event_id AS sample_id, user_id % 10 AS run_id, ts AS at_ts,
       CASE event_type WHEN 'view' THEN 'point_read' WHEN 'click' THEN 'range_read' WHEN 'purchase' THEN 'point_write' WHEN 'signup' THEN 'insert' ELSE 'slow_read' END AS class,
       CAST(floor(value * 1000) AS BIGINT) AS took_us
  FROM events WHERE NOT (user_id % 10 = 7 AND event_type = 'error')""",
    "v_changes": """
SELECT a.user_id % 10 AS run_id, a.event_id AS change_no, a.ts AS started, CASE WHEN a.event_id % 3 = 0 THEN NULL ELSE b.ts END AS ended
  FROM events a JOIN events b ON b.event_id = a.event_id + (a.event_id % 7) * (a.event_id % 7) * (a.event_id % 7) WHERE a.event_id % 67 = 0""",
    "v_activity": """
SELECT event_id AS reading_no, user_id % 10 AS run_id, ts AS sample_at, user_id AS pid,
       CASE event_type WHEN 'error' THEN 'Lock' WHEN 'click' THEN 'IO' WHEN 'purchase' THEN 'LWLock' ELSE NULL END AS wait_type,
       CASE event_type WHEN 'error' THEN 'relation' WHEN 'click' THEN 'DataFileRead' WHEN 'purchase' THEN 'WALWrite' ELSE NULL END AS wait_event,
       CASE WHEN event_id % 50 = 0 THEN 'idle in transaction' ELSE 'active' END AS state, CAST(floor(value * 1000) AS BIGINT) AS waiting_us
  FROM events""",
    "v_locks": """
SELECT ts AS sample_at, user_id AS pid, CASE WHEN event_id % 5 = 0 THEN 'tuple' ELSE 'relation' END AS locktype,
       event_type = 'signup' AS granted, 'rel_' || CAST(user_id % 7 AS STRING) AS relation
  FROM events WHERE event_type IN ('error', 'signup')""",
    # F
    "v_probes": """
SELECT s_suppkey AS server, CAST(200000 AS BIGINT) AS n_rows, CAST(20971520 AS BIGINT) AS n_bytes,
       CAST(floor(abs(s_acctbal) * 100) AS BIGINT) AS rewrite_us, CAST(floor(abs(s_acctbal) * 50) AS BIGINT) AS index_us
  FROM supplier""",
    "v_relation_stats": """
SELECT 't' || CAST(l_suppkey % 40 AS STRING) AS relation, CAST(count(*) * (l_suppkey % 40) * 40 AS BIGINT) AS n_rows, CAST(count(*) * (l_suppkey % 40) * 9000 AS BIGINT) AS n_bytes
  FROM lineitem WHERE l_suppkey % 40 <> 7 GROUP BY l_suppkey % 40""",
    "v_measured": """
SELECT m.server, m.relation, 1 + (m.server + r.n_rows) % 4 AS duration, CAST(floor(r.n_bytes / (1 + m.server % 9)) AS BIGINT) AS took_us
  FROM (SELECT DISTINCT l_suppkey AS server, 't' || CAST(l_partkey % 40 AS STRING) AS relation FROM lineitem) m JOIN v_relation_stats r ON r.relation = m.relation""",
    # G
    "v_ddl_actions": f"""
SELECT l_orderkey % 20 AS repo, l_orderkey AS migration_no,
       CASE WHEN l_orderkey % 3 = 0 THEN CAST(floor((rn - 1) / 4) AS BIGINT) ELSE CAST(floor((rn - 1) / 3) AS BIGINT) END AS step_no,
       CASE WHEN l_orderkey % 3 = 0 THEN CAST(floor((rn - 1) % 4 / 2) AS BIGINT) ELSE (rn - 1) % 3 END AS stmt_no, CASE WHEN l_orderkey % 3 = 0 THEN (rn - 1) % 2 ELSE CAST(0 AS BIGINT) END AS action_no,
       CASE WHEN l_orderkey % 4 = 0 THEN 'ddl_notx' WHEN l_orderkey % 9 = 0 AND rn > 3 THEN 'backfill' ELSE 'ddl_tx' END AS step_kind,
       l_orderkey % 11 = 0 AS no_lock_timeout,
       kind AS action_kind,
       CASE l_partkey % 5 WHEN 0 THEN 'app' WHEN 1 THEN 'audit' ELSE '' END AS schema_name, CASE WHEN l_suppkey % 80 < 40 THEN 't' ELSE 'T' END || CAST(l_suppkey % 40 AS STRING) AS relation, 'c' || CAST(l_partkey % 5 AS STRING) AS column_name,
       't' || CAST(l_partkey % 40 AS STRING) AS referenced, 'k' || CAST(l_partkey % 2 AS STRING) AS constraint_name,
       CASE l_returnflag WHEN 'A' THEN 'varchar' WHEN 'N' THEN 'text' ELSE 'numeric' END AS type_name,
       CASE WHEN l_returnflag = 'A' AND l_linenumber % 5 <> 0 THEN '[' || {_Q} || ']'
            WHEN l_returnflag = 'R' AND l_linenumber % 4 = 1 THEN '[' || {_Q} || ']' WHEN l_returnflag = 'R' AND l_linenumber % 4 > 1 THEN '[' || {_Q} || ',' || CAST(l_suppkey % 2 AS STRING) || ']' ELSE '[]' END AS mods,
       CASE WHEN kind NOT IN ('create_table', 'create_partition', 'create_referencing') OR l_linenumber % 6 = 5 THEN NULL
            ELSE '[{{"name":"c' || CAST((l_partkey + 1) % 5 AS STRING) || '","type_name":"varchar","mods":[' || {_Q} || ']}},{{"name":"C' || CAST(l_partkey % 5 AS STRING) || '","type_name":"numeric","mods":[' || {_Q} || ',' || CAST(l_partkey % 2 AS STRING) || ']}},{{"name":"c' || CAST((l_partkey + 3) % 5 AS STRING) || '","type_name":"text","mods":[]}}]' END AS columns,
       CASE WHEN kind IN ('use_enum_value', 'update', 'delete', 'insert', 'select', 'add_column') AND l_linenumber % 7 > 0
            THEN '["label_' || CAST((l_partkey + rn) % 3 AS STRING) || '","label_' || CAST(l_suppkey % 3 AS STRING) || '","text"]' ELSE NULL END AS literals,
       l_linestatus = 'O' AS concurrent, l_discount > 0.05 AS not_valid, l_tax > 0.04 AS if_exists, l_quantity > 25 AS has_where,
       CASE l_linenumber % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'constant' WHEN 2 THEN 'volatile' ELSE 'unique' END AS filled_by,
       CASE WHEN kind = 'add_check' AND l_suppkey % 6 < 3 THEN CASE l_suppkey % 6 WHEN 0 THEN 'c' || CAST(l_partkey % 5 AS STRING) || ' IS NOT NULL' WHEN 1 THEN '((t.C' || CAST(l_partkey % 5 AS STRING) || ' is  not null))' ELSE '("c' || CAST(l_partkey % 5 AS STRING) || '") IS NOT NULL' END
            WHEN kind = 'add_check' THEN CASE l_suppkey % 6 WHEN 3 THEN 'c1 > 0' WHEN 4 THEN 'c1 IS NOT NULL AND c2 IS NOT NULL' ELSE '"C1" IS NOT NULL' END
            ELSE CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'relkind = 1' ELSE 'indisvalid' END END AS condition_text,
       'label_' || CAST(l_partkey % 3 AS STRING) AS label, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(1 + l_linenumber % 8 AS INTEGER) END AS lock_mode
  FROM (SELECT *, {_KIND} AS kind FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) p) k""",
    "v_view_bases": """
SELECT DISTINCT l_orderkey % 20 AS repo, 't' || CAST(l_suppkey % 40 AS STRING) AS relation, 't' || CAST((l_suppkey + 1) % 40 AS STRING) AS base FROM lineitem""",
    "v_relation_parents": """
SELECT l_orderkey % 20 AS repo, l_orderkey AS migration_no, rn AS ord, 't' || CAST(l_suppkey % 40 AS STRING) AS relation, 't' || CAST(l_partkey % 40 AS STRING) AS parent
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) p""",
    # H
    "v_findings": """
SELECT doc_id AS finding_id, source AS corpus, source || '/' || lang AS file, 'step_' || CAST(doc_id % 3 AS STRING) AS step,
       'L00' || CAST(1 + n_chars % 9 AS STRING) AS rule_id, 1 + doc_id % 3 AS severity, n_chars AS span_start, n_chars % 4 = 0 AS fixable
  FROM documents""",
    "v_findings_after": """
SELECT finding_id, corpus, file, step, rule_id, CASE WHEN finding_id % 11 = 0 THEN severity % 3 + 1 ELSE severity END AS severity, span_start, fixable
  FROM v_findings WHERE finding_id % 5 <> 0
UNION ALL SELECT finding_id + 1000000000, corpus, file, step, rule_id, severity, span_start + 1, fixable FROM v_findings WHERE finding_id % 7 = 0""",
    "v_verdicts": """
SELECT doc_id AS finding_id, CASE WHEN toxic = 1 THEN 'FP' WHEN quality = 1 THEN 'TP' ELSE 'arguable' END AS verdict,
       CASE doc_id % 3 WHEN 0 THEN 'size' WHEN 1 THEN 'order' ELSE 'parser' END AS cause
  FROM labels""",
    "v_directives": """
SELECT DISTINCT source || '/' || lang || CASE WHEN doc_id % 25 = 0 THEN '' ELSE '/' || CAST(doc_id AS STRING) END AS file, doc_id AS line, 'L00' || CAST(1 + doc_id % 9 AS STRING) AS rule_id,
       CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'step_1' END AS step, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'seen' END AS reason,
       CASE WHEN doc_id % 7 = 0 THEN 'gives no reason' ELSE '' END AS problem,
       CASE WHEN doc_id % 3 = 0 THEN '20240817120000' WHEN doc_id % 3 = 1 THEN '20241399000000' ELSE CAST(doc_id AS STRING) END AS version
  FROM documents""",
    "v_policy_scopes": """
SELECT 0 AS scope_no, '' AS path, 'L00' || CAST(r.k AS STRING) AS rule_id, 1 + r.k % 3 AS severity FROM (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r
UNION ALL SELECT 1, 'src1', 'L001', 0 UNION ALL SELECT 2, 'src1/en', 'L001', 3 UNION ALL SELECT 3, 'src2/', 'L002', 1
UNION ALL SELECT 4, 'src', 'L003', 0 UNION ALL SELECT 5, './src3/en', 'L004', 2""",
    "v_policy_documents": """
SELECT c_custkey AS repo, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE '{"target_version":' || CAST(10 + c_custkey % 7 AS STRING) || ',"thresholds":{"big_rows":' || CAST(c_custkey % 5 * 1000 - CASE WHEN c_custkey % 11 = 0 THEN 5000 ELSE 0 END AS STRING) || '},"rules":{"L001":"warn","L00'
       || CAST(2 + c_custkey % 8 AS STRING) || '":"' || CASE c_custkey % 6 WHEN 0 THEN 'off' WHEN 1 THEN 'error' WHEN 2 THEN 'loud' ELSE 'info' END || '"},"overrides":[{"path":"./db/' || CAST(c_custkey % 3 AS STRING) || '/","rules":{"L001":"off","L002":"error"}},{"path":"'
       || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'db//' || CAST(c_custkey % 3 AS STRING) || '/x/../O' END || '","rules":{"L002":"warn","L' || lpad(CAST(c_custkey % 60 AS STRING), 3, '0') || '":"error"}}]' || CASE WHEN c_custkey % 13 = 0 THEN ',"colour":"red"' ELSE '' END || '}' END AS document
  FROM customer WHERE c_custkey % 60 <> 2""",
    "v_repo_directories": """
SELECT DISTINCT o_custkey AS repo, 'db/' || CAST(o_orderkey % 3 AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE '/' || o_orderstatus END AS directory FROM orders""",
    "v_policies": """
SELECT o_custkey AS repo, CASE o_orderkey % 7 WHEN 0 THEN 'rule' WHEN 1 THEN 'level' WHEN 2 THEN 'path' WHEN 3 THEN 'threshold' WHEN 4 THEN 'field' ELSE 'rule' END AS item,
       CASE o_orderkey % 5 WHEN 0 THEN 'L001' WHEN 1 THEN 'L999' WHEN 2 THEN 'warn' WHEN 3 THEN '' ELSE '-5' END AS value
  FROM orders""",
    # I
    "v_marked_texts": """
SELECT doc_id, '@@ ignore L001 reason="header"' || chr(10) || '@@ step: first' || chr(10) || text || chr(10) || '@@ step: second' || chr(10)
       || '@@ ignore L' || lpad(CAST(doc_id % 50 AS STRING), 3, '0') || CASE doc_id % 4 WHEN 0 THEN ' reason="ok"' WHEN 1 THEN '' WHEN 2 THEN ' reason=" "' ELSE '    reason="why not"' END || chr(10)
       || '@@ settings: table=t' || CAST(doc_id % 40 AS STRING) || '  key=id batch=' || CAST((doc_id % 5) * 100 AS STRING) || CASE doc_id % 3 WHEN 0 THEN ' max_lag_bytes=-1' WHEN 1 THEN '' ELSE ' colour=red' END || chr(10)
       || '@@ bogus' || chr(10) || 'body of ' || lang || CASE WHEN doc_id % 6 = 0 THEN chr(10) || '@@ step: second' || chr(10) || '@@ step: empty' || chr(10) ELSE '' END AS text
  FROM documents""",
    "v_paths": """
SELECT o_custkey % 10 AS repo, 'migrations/' || CASE WHEN o_orderkey % 50 = 0 THEN 'readme' ELSE CAST(o_orderkey % 5000 AS STRING) || '_' || lower(substr(o_orderpriority, 3)) END || CASE o_orderkey % 3 WHEN 0 THEN '.up.sql' WHEN 1 THEN '.sql' ELSE '.down.sql' END AS path
  FROM orders""",
}

_NAME = re.compile(r"\bv_[a-z_]+\b")
_TABLE = re.compile(r"\b(?:FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b", re.I)


def needed(sql: str) -> list[str]:
    """The views that sql reads, each after those that it reads itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def with_views(sql: str) -> str:
    """sql for DuckDB: the views that it reads in front of it. sql may begin with further WITH entries after a comma."""
    heads = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed(sql))
    body = sql.strip()
    if body.startswith(","):
        return f"WITH {heads}{body}"
    return f"WITH {heads} {body}" if heads else body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables in sf_dir."""
    text = f"SELECT * FROM {name}"
    names = needed(text)
    every = " ".join(VIEWS[n] for n in names)
    frames = {}
    for t in sorted({m.lower() for m in _TABLE.findall(every)}):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t == "events":
            df = df.withColumn("ts", df["ts"].cast("timestamp"))
        elif t == "lineitem":
            df = df.withColumn("l_shipdate", df["l_shipdate"].cast("timestamp"))
        frames[t] = df
    for n in names:
        frames[n] = spark.sql(_bind(VIEWS[n], frames), **{k: v for k, v in frames.items() if re.search(rf"\b{k}\b", VIEWS[n])})
    return frames[name]


def _bind(sql: str, frames: dict[str, DataFrame]) -> str:
    """Table names become parameters, so that no temporary view is left in the session; other braces are text."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    return re.sub(r"\b(FROM|JOIN)(\s+)(" + "|".join(map(re.escape, frames)) + r")\b", r"\1\2{\3}", sql)
