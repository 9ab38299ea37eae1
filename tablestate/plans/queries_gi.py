"""Queries of families G to I over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NOT_NULL_TEST
from ..operators import corpus, findings, hazards
from .registry import Views, query

#: The rules there are.
KNOWN_RULES = [f"L{k:03}" for k in (*range(12), *range(20, 26), *range(30, 34), *range(40, 43))]
NOW = "2024-12-01 00:00:00"
_KNOWN = ", ".join(f"'{r}'" for r in KNOWN_RULES)

# --- G


def _value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).upper()


_RULES = ", ".join(f"({i}, {', '.join(map(_value, r))})" for i, r in enumerate(hazards.RULES))
_EFF = f"""SELECT a.*, CASE WHEN r.side = 'relation' THEN a.relation ELSE a.referenced END AS locked, coalesce(CAST(r.mode AS INTEGER), a.lock_mode, 8) AS mode, r.duration, r.implicit, r.reason, r.ord FROM v_ddl_actions a
  JOIN (VALUES {_RULES}) r(ord, kind, r_concurrent, r_not_valid, r_filled_by, version_from, version_to, side, mode, duration, implicit, reason)
    ON r.kind = a.action_kind AND (r.r_concurrent IS NULL OR CAST(r.r_concurrent AS BOOLEAN) = a.concurrent) AND (r.r_not_valid IS NULL OR CAST(r.r_not_valid AS BOOLEAN) = a.not_valid) AND (r.r_filled_by IS NULL OR r.r_filled_by = a.filled_by)
   AND r.version_from <= {{0}} AND r.version_to >= {{0}}"""
EFF = _EFF.format(16)
_P = "{0}repo, {0}migration_no, {0}step_no, {0}stmt_no"
_S = "repo, migration_no, step_no, stmt_no"
_STEP = "repo, migration_no, step_no"
_AT = "({0}step_no, {0}stmt_no)"
_OUTSIDE = "(action_kind IN ('create_index', 'drop_index', 'reindex_index', 'reindex_table', 'detach_partition') AND concurrent) OR action_kind IN ('vacuum', 'vacuum_full', 'reindex_schema', 'cluster_all') OR (action_kind = 'add_enum_value' AND {0} < 12)"
_MADE = "action_kind IN ('create_table', 'create_partition', 'create_referencing')"
_COLUMNS = """from_json(columns, '[{"name":"VARCHAR","type_name":"VARCHAR","mods":["INTEGER"]}]')"""


@query(f"SELECT {_S}, locked, mode, duration, implicit, ord FROM ({EFF}) e")
def g1_effects(v: Views) -> DataFrame:
    return hazards.effects(v.ddl_actions).select(*hazards.STMT, "locked", "mode", "duration", "implicit", "ord")


@query(f"SELECT {_S}, locked, mode, duration, implicit, ord FROM ({_EFF.format(10)}) e")
def g1_effects_version_10(v: Views) -> DataFrame:
    return hazards.effects(v.ddl_actions, 10).select(*hazards.STMT, "locked", "mode", "duration", "implicit", "ord")


@query(f"""SELECT n.repo, n.migration_no, n.step_no, n.stmt_no, t.locked, t.mode, t.duration, coalesce(t.r, FALSE) AS blocks_reads, coalesce(t.w, FALSE) AS blocks_writes, n.no_tx FROM (
SELECT {_S}, bool_or({_OUTSIDE.format(16)}) AS no_tx FROM v_ddl_actions GROUP BY {_S}) n LEFT JOIN (
SELECT {_S}, first(locked ORDER BY mode DESC, duration DESC, action_no, ord) AS locked, first(mode ORDER BY mode DESC, duration DESC, action_no, ord) AS mode, first(duration ORDER BY mode DESC, duration DESC, action_no, ord) AS duration,
       bool_or(mode = 8) AS r, bool_or(mode >= 5) AS w FROM ({EFF}) e GROUP BY {_S}) t ON (t.repo, t.migration_no, t.step_no, t.stmt_no) = (n.repo, n.migration_no, n.step_no, n.stmt_no)""")
def g2_statement_profile(v: Views) -> DataFrame:
    return hazards.statement_profile(v.ddl_actions)


def _fresh_sql(probe: str, name: str) -> str:
    return f"""SELECT p.*, coalesce((SELECT first(e.{_MADE} ORDER BY e.step_no DESC, e.stmt_no DESC, e.action_kind = 'drop_table' DESC) FROM v_ddl_actions e WHERE e.repo = p.repo AND e.migration_no = p.migration_no AND lower(e.relation) = lower(p.{name})
   AND ((e.{_MADE} AND {_AT.format('e.')} <= {_AT.format('p.')}) OR (e.action_kind = 'drop_table' AND {_AT.format('e.')} < {_AT.format('p.')}))), FALSE) AS fresh FROM ({probe}) p"""


@query(f"SELECT {_S}, relation, fresh FROM ({_fresh_sql('SELECT * FROM v_ddl_actions', 'relation')}) f")
def g3_fresh_at(v: Views) -> DataFrame:
    a = v.ddl_actions
    return hazards.fresh_at(a, a).select(*hazards.STMT, "relation", "fresh")


_CREATED = f"EXISTS (SELECT 1 FROM v_ddl_actions e WHERE e.repo = a.repo AND e.migration_no = a.migration_no AND e.relation = a.relation AND e.{_MADE} AND (e.schema_name = a.schema_name OR e.schema_name = '' OR a.schema_name = '') AND {_AT.format('e.')} < {_AT.format('a.')})"


@query(f"SELECT {_P.format('a.')}, a.relation, {_CREATED} AS created FROM v_ddl_actions a")
def g4_created_here(v: Views) -> DataFrame:
    a = v.ddl_actions
    return hazards.created_here(a, a).select(*hazards.STMT, "relation", "created")


_BLOCKABLE = f"""SELECT f.*, NOT fresh AND NOT (action_kind = 'drop_table' AND if_exists AND NOT EXISTS (SELECT 1 FROM v_ddl_actions e WHERE e.repo = f.repo AND e.{_MADE} AND lower(e.relation) = lower(f.locked))) AS blockable
  FROM ({_fresh_sql(EFF, 'locked')}) f"""


@query(f"SELECT {_S}, locked, ord, blockable FROM ({_BLOCKABLE}) b")
def g5_blockable(v: Views) -> DataFrame:
    a = v.ddl_actions
    return hazards.blockable(hazards.effects(a), a).select(*hazards.STMT, "locked", "ord", "blockable")


#: Each time a column's type is said: adds and changes, and the columns that tables are created with.
_SAID = f"""SELECT {_S}, action_no, 0 AS nth, lower(relation) AS r, lower(column_name) AS c, type_name, coalesce(CAST(mods AS INTEGER[]), []) AS mods FROM v_ddl_actions WHERE action_kind IN ('add_column', 'alter_type')
UNION ALL SELECT {_S}, action_no, nth, lower(relation), lower(x.name), x.type_name, coalesce(x.mods, []) FROM (SELECT *, unnest({_COLUMNS}) AS x, unnest(range(len({_COLUMNS}))) AS nth FROM v_ddl_actions WHERE {_MADE}) n"""
_FILE_AT = "({0}migration_no, {0}step_no, {0}stmt_no)"
_PRIOR = f"""SELECT a.*, coalesce(CAST(a.mods AS INTEGER[]), []) AS new_mods, k.p.type_name AS prior_name, k.p.mods AS prior_mods FROM v_ddl_actions a LEFT JOIN (
SELECT q.repo, q.migration_no, q.step_no, q.stmt_no, q.action_no, arg_max({{'type_name': e.type_name, 'mods': e.mods}}, (e.migration_no, e.step_no, e.stmt_no, e.action_no, e.nth)) AS p
  FROM v_ddl_actions q JOIN ({_SAID}) e ON e.repo = q.repo AND e.r = lower(q.relation) AND e.c = lower(q.column_name) AND {_FILE_AT.format('e.')} < {_FILE_AT.format('q.')} WHERE q.action_kind = 'alter_type' GROUP BY ALL) k
    ON (k.repo, k.migration_no, k.step_no, k.stmt_no, k.action_no) = (a.repo, a.migration_no, a.step_no, a.stmt_no, a.action_no) WHERE a.action_kind = 'alter_type'"""
_TYPED = f"""SELECT *, coalesce((prior_name = type_name AND prior_mods = new_mods)
    OR (prior_name = 'varchar' AND type_name = 'varchar' AND (len(new_mods) = 0 OR (len(prior_mods) = 1 AND new_mods[1] >= prior_mods[1]))) OR (prior_name = 'varchar' AND type_name = 'text')
    OR (prior_name = 'numeric' AND type_name = 'numeric' AND (len(new_mods) = 0 OR (len(prior_mods) = 2 AND len(new_mods) = 2 AND new_mods[1] >= prior_mods[1] AND new_mods[2] = prior_mods[2]))), FALSE) AS in_place FROM ({_PRIOR}) y"""


@query(f"SELECT {_S}, prior_name, array_to_string(prior_mods, ',') AS prior_mods FROM ({_PRIOR}) t")
def g6_type_before(v: Views) -> DataFrame:
    prior = hazards.type_before(v.ddl_actions)
    return prior.select(*hazards.STMT, F.col("prior.type_name").alias("prior_name"), F.array_join(F.col("prior.mods").cast("array<string>"), ",").alias("prior_mods"))


@query(f"SELECT {_S}, in_place FROM ({_TYPED}) t")
def g7_in_place_type_change(v: Views) -> DataFrame:
    return hazards.in_place_type_change(hazards.type_before(v.ddl_actions)).select(*hazards.STMT, "in_place")


_ADDED = f"EXISTS (SELECT 1 FROM ({_SAID}) e WHERE e.repo = a.repo AND e.migration_no = a.migration_no AND e.r = lower(a.relation) AND e.c = lower(a.column_name) AND {_AT.format('e.')} < {_AT.format('a.')})"


@query(f"SELECT {_P.format('a.')}, a.column_name, {_ADDED} AS column_added FROM v_ddl_actions a")
def g8_column_added_in_file(v: Views) -> DataFrame:
    a = v.ddl_actions
    return hazards.column_added_in_file(a, a).select(*hazards.STMT, "column_name", "column_added")


@query(f""", lk AS (SELECT DISTINCT {_S}, locked FROM ({_BLOCKABLE}) b WHERE blockable AND mode = 8 AND step_kind = 'ddl_tx'),
par AS (SELECT repo, lower(relation) AS r, lower(first(parent ORDER BY migration_no DESC, ord DESC)) AS parent FROM v_relation_parents GROUP BY repo, lower(relation)),
dom AS (SELECT {_P.format('l.')}, coalesce(p.parent, CASE WHEN NOT EXISTS (SELECT 1 FROM v_view_bases w JOIN lk o ON o.repo = l.repo AND o.migration_no = l.migration_no AND o.step_no = l.step_no AND o.locked = lower(w.base)
          WHERE w.repo = l.repo AND lower(w.relation) = lower(l.locked)) THEN l.locked END) AS domain FROM lk l LEFT JOIN par p ON p.repo = l.repo AND p.r = lower(l.locked))
SELECT * FROM (SELECT {_STEP}, count(DISTINCT domain) AS n_domains, count(DISTINCT stmt_no) AS n_stmts FROM dom GROUP BY {_STEP}) d WHERE n_domains >= 2 AND n_stmts >= 2""")
def g9_lock_domains(v: Views) -> DataFrame:
    return hazards.lock_domains(v.ddl_actions, v.relation_parents, v.view_bases)


@query(f""", b AS (SELECT * FROM ({_BLOCKABLE}) x WHERE blockable AND step_kind = 'ddl_tx'),
h AS (SELECT {_STEP}, first(stmt_no ORDER BY duration DESC, stmt_no, action_no, ord) AS stmt_no, first(locked ORDER BY duration DESC, stmt_no, action_no, ord) AS locked, max(duration) AS duration FROM b WHERE NOT implicit AND duration >= 2 GROUP BY {_STEP})
SELECT h.*, count(*) AS others FROM h JOIN (SELECT DISTINCT {_S} FROM b WHERE mode >= 5) o ON o.repo = h.repo AND o.migration_no = h.migration_no AND o.step_no = h.step_no AND o.stmt_no <> h.stmt_no GROUP BY ALL""")
def g10_long_work_with_company(v: Views) -> DataFrame:
    return hazards.long_work_with_company(v.ddl_actions)


@query(f"""SELECT {_P.format('a.')}, a.action_no, CASE a.action_kind WHEN 'create_index' THEN 'L022' ELSE 'L023' END AS rule_id FROM v_ddl_actions a WHERE a.action_kind IN ('create_index', 'add_foreign_key')
   AND EXISTS (SELECT 1 FROM v_ddl_actions f WHERE f.repo = a.repo AND f.migration_no = a.migration_no AND f.relation = a.relation AND f.step_kind = 'backfill' AND f.step_no > a.step_no)""")
def g11_before_backfill(v: Views) -> DataFrame:
    return hazards.before_backfill(v.ddl_actions)


@query(f"""SELECT DISTINCT {_P.format('u.')}, u.label FROM (SELECT *, unnest(CAST(literals AS VARCHAR[])) AS label FROM (SELECT {_S}, step_kind, literals FROM v_ddl_actions) w) u WHERE u.step_kind = 'ddl_tx' AND EXISTS (
SELECT 1 FROM v_ddl_actions a WHERE a.repo = u.repo AND a.migration_no = u.migration_no AND a.step_no = u.step_no AND a.label = u.label AND a.action_kind = 'add_enum_value' AND a.step_kind = 'ddl_tx' AND u.stmt_no > a.stmt_no)""")
def g12_used_after_added_in_txn(v: Views) -> DataFrame:
    return hazards.used_after_added_in_txn(v.ddl_actions)


@query(f"SELECT {_STEP}, max(mode) AS mode FROM ({EFF}) e GROUP BY {_STEP} HAVING max(mode) >= 5 AND bool_or(no_lock_timeout)")
def g13_timeout_off(v: Views) -> DataFrame:
    return hazards.timeout_off(v.ddl_actions)


_NEVER = f"""SELECT DISTINCT {_P.format('m.')}, m.relation FROM v_ddl_actions m WHERE m.{_MADE} AND m.repo IN (SELECT repo FROM v_ddl_actions WHERE action_kind IN ('grant', 'grant_all'))
   AND NOT EXISTS (SELECT 1 FROM v_ddl_actions e WHERE e.repo = m.repo AND e.migration_no = m.migration_no AND ((e.action_kind = 'drop_table' AND e.relation = m.relation)
     OR (((e.action_kind = 'grant' AND e.relation = m.relation) OR e.action_kind = 'grant_all') AND {_AT.format('e.')} > {_AT.format('m.')})))"""


@query(_NEVER)
def g14_never_granted(v: Views) -> DataFrame:
    return hazards.never_granted(v.ddl_actions)


@query(_NEVER)
def g14_never_granted_whole(v: Views) -> DataFrame:
    """The name under which the whole input was first covered."""
    return hazards.never_granted(v.ddl_actions)


_TEST = NOT_NULL_TEST.replace("'", "''")
_CHECKS = f"""SELECT repo, migration_no, relation, constraint_name, not_valid, CASE WHEN regexp_matches(condition_text, '{_TEST}') AND len(string_split(condition_text, '(')) = len(string_split(condition_text, ')'))
  THEN CASE WHEN regexp_extract(condition_text, '{_TEST}', 1) <> '' THEN replace(regexp_extract(condition_text, '{_TEST}', 1), '""', '"') ELSE lower(regexp_extract(condition_text, '{_TEST}', 2)) END END AS proven_column FROM v_ddl_actions WHERE action_kind = 'add_check'"""
_PROVEN = f"""EXISTS (SELECT 1 FROM ({_CHECKS}) c WHERE c.repo = a.repo AND c.migration_no = a.migration_no AND c.relation = a.relation AND c.proven_column = a.column_name
  AND (NOT c.not_valid OR EXISTS (SELECT 1 FROM v_ddl_actions d WHERE d.repo = c.repo AND d.migration_no = c.migration_no AND d.relation = c.relation AND d.constraint_name = c.constraint_name AND d.action_kind = 'validate_constraint')))"""


@query(f"SELECT {_P.format('a.')}, {_PROVEN} AS proven FROM v_ddl_actions a WHERE a.action_kind = 'set_not_null'")
def g15_not_null_proof(v: Views) -> DataFrame:
    a = v.ddl_actions
    return hazards.not_null_proof(a.where("action_kind = 'set_not_null'"), a).select(*hazards.STMT, "proven")


_CTX = f"""SELECT a.*, {_CREATED} AS created, {_ADDED} AS column_added, {_PROVEN} AS proven, coalesce(t.in_place, FALSE) AS in_place, coalesce(w.duration, 0) AS worst,
       CASE WHEN s.relation IS NULL THEN 2 WHEN s.n_rows >= 1000000 OR s.n_bytes >= 1073741824 THEN 3 WHEN s.n_rows < 10000 AND s.n_bytes < 8388608 THEN 1 ELSE 2 END AS sized,
       coalesce(s.n_rows >= 1000000 OR s.n_bytes >= 1073741824, FALSE) AS large
  FROM v_ddl_actions a LEFT JOIN ({_TYPED}) t ON (t.repo, t.migration_no, t.step_no, t.stmt_no, t.action_no) = (a.repo, a.migration_no, a.step_no, a.stmt_no, a.action_no)
  LEFT JOIN (SELECT {_S}, action_no, max(duration) AS duration FROM ({EFF}) e WHERE NOT implicit GROUP BY {_S}, action_no) w ON (w.repo, w.migration_no, w.step_no, w.stmt_no, w.action_no) = (a.repo, a.migration_no, a.step_no, a.stmt_no, a.action_no)
  LEFT JOIN v_relation_stats s ON s.relation = a.relation"""
_CASES = [
    ("L001", "action_kind = 'create_index' AND NOT concurrent AND NOT created", "sized"),
    ("L002", f"({_OUTSIDE.format(16)}) AND step_kind = 'ddl_tx'", "3"),
    ("L003", "action_kind = 'add_column' AND worst = 3 AND NOT created", "sized"),
    ("L004", "action_kind = 'alter_type' AND NOT in_place AND NOT created", "sized"),
    ("L005", "action_kind = 'set_not_null' AND NOT created AND NOT proven", "sized"),
    ("L006", "action_kind = 'add_foreign_key' AND NOT not_valid AND NOT created", "sized"),
    ("L007", "action_kind = 'add_check' AND NOT not_valid AND NOT created", "sized"),
    ("L008", "action_kind = 'add_primary_key' AND NOT concurrent AND NOT created", "sized"),
    ("L009", "action_kind = 'add_column' AND filled_by = 'unique' AND NOT created", "2"),
    ("L010", "action_kind IN ('vacuum_full', 'cluster')", "3"),
    ("L011", "action_kind = 'refresh_view' AND NOT concurrent", "2"),
    ("L030", "action_kind IN ('drop_table', 'drop_column') AND NOT created", "2"),
    ("L031", "action_kind IN ('rename_table', 'rename_column') AND NOT created AND NOT column_added", "3"),
    ("L033", "action_kind = 'truncate' AND NOT created", "3"),
    ("L040", "action_kind IN ('update', 'delete') AND NOT has_where AND step_kind <> 'backfill' AND NOT created", "sized"),
    ("L041", "action_kind = 'delete' AND large AND step_kind <> 'backfill' AND NOT created", "sized"),
    ("L042", "action_kind = 'create_index' AND concurrent AND condition_text <> '' AND condition_text NOT LIKE '%indisvalid%'", "1"),
]
_EVERY = " UNION ALL ".join(f"SELECT {_S}, action_no, relation, '{r}' AS rule_id, CAST({s} AS INTEGER) AS severity, action_kind FROM ctx WHERE {c}" for r, c, s in _CASES)
#: Dropped and emptied tables: one finding a statement.
_FOUND = f""", ctx AS ({_CTX}), every AS ({_EVERY})
SELECT {_S}, action_no, relation, rule_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY {_S}, rule_id, severity, CASE WHEN (rule_id, action_kind) IN (('L030', 'drop_table'), ('L033', 'truncate')) THEN -1 ELSE action_no END ORDER BY action_no, relation) AS k FROM every) x WHERE k = 1"""


def _found(v: Views) -> DataFrame:
    a = v.ddl_actions
    return hazards.single_action_rules(hazards.with_context(a, v.relation_stats.withColumn("exists", F.lit(True))))


@query(_FOUND)
def g16_single_action_rules(v: Views) -> DataFrame:
    return _found(v)


@query(_FOUND)
def g17_order_findings(v: Views) -> DataFrame:
    return hazards.order_findings(_found(v))


@query(f"SELECT DISTINCT locked AS relation FROM ({EFF}) e")
def g18_relations_touched(v: Views) -> DataFrame:
    return hazards.relations_touched(v.ddl_actions)


# --- H

_DIRS = "(SELECT DISTINCT file AS directory FROM v_findings) d"
_SCOPE = "regexp_replace(regexp_replace(path, '^(\\./)+', ''), '/+$', '')"
_POLICY = f"""SELECT directory, rule_id, CAST(arg_max(severity, scope_no) AS BIGINT) AS severity FROM {_DIRS} JOIN (SELECT *, {_SCOPE} AS p FROM v_policy_scopes) s ON s.p = '' OR directory = s.p OR starts_with(directory, s.p || '/') GROUP BY directory, rule_id"""


def _policy(v: Views) -> DataFrame:
    return findings.resolve_policy(v.policy_scopes, v.findings.select(F.col("file").alias("directory")).distinct()).withColumn("severity", F.col("severity").cast("long"))


@query(_POLICY)
def h1_resolve_policy(v: Views) -> DataFrame:
    return _policy(v)


@query(f"""SELECT * FROM (SELECT *, CASE WHEN item = 'rule' AND value NOT IN ({_KNOWN}) THEN 'unknown rule' WHEN item = 'rule' AND value = 'L000' THEN 'cannot be graded' WHEN item = 'level' AND value NOT IN ('off', 'info', 'warn', 'error') THEN 'unknown level' WHEN item = 'path' AND value = '' THEN 'missing path'
       WHEN item = 'threshold' AND coalesce(TRY_CAST(value AS BIGINT), -1) < 0 THEN 'not a threshold' WHEN item NOT IN ('rule', 'level', 'path', 'threshold') THEN 'unknown field' END AS problem FROM v_policies) p WHERE problem IS NOT NULL""")
def h2_validate_policy(v: Views) -> DataFrame:
    return findings.validate_policy(v.policies, KNOWN_RULES)


#: Scopes of documents by the JSON functions; paths of the given documents need no more than these replacements.
_DOC_SCOPES = f"""SELECT repo, 0 AS scope_no, '' AS path, '$.rules' AS spot, document FROM v_policy_documents WHERE document <> ''
UNION ALL SELECT repo, i + 1, coalesce(json_extract_string(document, '$.overrides[' || i || '].path'), ''), '$.overrides[' || i || '].rules', document FROM (SELECT *, unnest(range(CAST(json_array_length(document, '$.overrides') AS BIGINT))) AS i FROM v_policy_documents WHERE document <> '') o"""
_DOC_RULES = f"""SELECT repo, scope_no, replace(replace(regexp_replace(regexp_replace(path, '^(\\./)+', ''), '/+$', ''), '//', '/'), '/x/..', '') AS path, rule, json_extract_string(document, spot || '.' || rule) AS level FROM (SELECT *, unnest(json_keys(document, spot)) AS rule FROM ({_DOC_SCOPES}) s) r"""
_DOC_PROBLEMS = f"""SELECT repo, CAST(NULL AS INTEGER) AS scope_no, 'field' AS item, k AS value, 'unknown field' AS problem FROM (SELECT repo, unnest(json_keys(document)) AS k FROM v_policy_documents WHERE document <> '') f WHERE k NOT IN ('target_version', 'thresholds', 'rules', 'overrides')
UNION ALL SELECT repo, CAST(scope_no AS INTEGER), 'path', '', 'missing path' FROM ({_DOC_SCOPES}) s WHERE scope_no > 0 AND path = ''
UNION ALL SELECT repo, CAST(scope_no AS INTEGER), 'rule', rule, CASE WHEN rule = 'L000' THEN 'cannot be graded' ELSE 'unknown rule' END FROM ({_DOC_RULES}) r WHERE rule = 'L000' OR rule NOT IN ({_KNOWN})
UNION ALL SELECT repo, CAST(scope_no AS INTEGER), 'level', level, 'unknown level' FROM ({_DOC_RULES}) r WHERE level NOT IN ('off', 'info', 'warn', 'error')
UNION ALL SELECT repo, NULL, 'threshold', 'big_rows=' || json_extract_string(document, '$.thresholds.big_rows'), 'a threshold cannot be negative' FROM v_policy_documents WHERE document <> '' AND CAST(json_extract_string(document, '$.thresholds.big_rows') AS BIGINT) < 0"""


@query(_DOC_PROBLEMS)
def h2_policy_documents(v: Views) -> DataFrame:
    return findings.validate_documents(v.policy_documents, KNOWN_RULES)


@query(f"""SELECT d.repo, d.directory, r.rule AS rule_id, CAST(arg_max(CASE r.level WHEN 'off' THEN 0 WHEN 'info' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END, r.scope_no) AS BIGINT) AS severity
  FROM v_repo_directories d JOIN ({_DOC_RULES}) r ON r.repo = d.repo AND (r.path = '' OR d.directory = r.path OR starts_with(d.directory, r.path || '/'))
 WHERE d.repo NOT IN (SELECT repo FROM ({_DOC_PROBLEMS}) p) GROUP BY d.repo, d.directory, r.rule""")
def h1_policy_documents(v: Views) -> DataFrame:
    """Documents without problems, of many repositories, resolved for the directories of each."""
    docs = v.policy_documents
    sound = findings.read_policies(docs.join(findings.validate_documents(docs, KNOWN_RULES).select("repo").distinct(), "repo", "left_anti"))
    return findings.resolve_documents(sound, v.repo_directories)


_GRADED = f"""SELECT * FROM (SELECT f.finding_id, f.corpus, f.file, f.step, f.rule_id, CAST(coalesce(p.severity, f.severity) AS BIGINT) AS severity, f.span_start, f.fixable FROM v_findings f LEFT JOIN ({_POLICY}) p ON p.directory = f.file AND p.rule_id = f.rule_id) g WHERE severity > 0"""
_MATCH = "d.problem = '' AND d.file = f.file AND d.rule_id = f.rule_id AND (d.step = '' OR d.step = f.step)"
_LEFT = f"SELECT * FROM ({_GRADED}) f WHERE NOT EXISTS (SELECT 1 FROM v_directives d WHERE {_MATCH})"


def _graded(v: Views) -> DataFrame:
    return findings.apply_policy(v.findings, _policy(v))


@query(_GRADED)
def h3_apply_policy(v: Views) -> DataFrame:
    return _graded(v)


@query(_LEFT)
def h4_suppress(v: Views) -> DataFrame:
    return findings.suppress(_graded(v), v.directives)


_USED = f"SELECT d.*, EXISTS (SELECT 1 FROM ({_GRADED}) f WHERE {_MATCH}) AS used FROM v_directives d"


@query(_USED)
def h4_mark_used(v: Views) -> DataFrame:
    return findings.mark_used(v.directives, _graded(v))


@query(f"SELECT file, step, rule_id, severity, span_start FROM ({_LEFT}) f UNION ALL SELECT file, step, 'L000', 3, line FROM v_directives WHERE problem <> ''")
def h5_broken_directives(v: Views) -> DataFrame:
    return findings.broken_directives(findings.suppress(_graded(v), v.directives), v.directives)


@query(f"""SELECT file, line, rule_id, CAST(greatest(CAST(floor(date_diff('second', try_strptime(CASE WHEN length(version) = 14 THEN version END, '%Y%m%d%H%M%S'), TIMESTAMP '{NOW}') / 86400) AS BIGINT), CASE WHEN try_strptime(CASE WHEN length(version) = 14 THEN version END, '%Y%m%d%H%M%S') IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS age_days,
       CASE WHEN problem <> '' THEN 'broken' WHEN used THEN 'used' ELSE 'unused' END AS state, CASE WHEN problem <> '' THEN problem ELSE reason END AS text FROM ({_USED}) d""")
def h6_suppression_audit(v: Views) -> DataFrame:
    return findings.suppression_audit(findings.mark_used(v.directives, _graded(v)), NOW)


@query("SELECT corpus, count(*) AS total, count(*) FILTER (WHERE severity = 3) AS errors, count(*) FILTER (WHERE severity = 2) AS warnings, count(*) FILTER (WHERE fixable) AS fixable, count(*) FILTER (WHERE severity = 3) > 0 AS failed FROM v_findings GROUP BY corpus")
def h7_finding_counts(v: Views) -> DataFrame:
    return findings.finding_counts(v.findings, "corpus")


_JUDGED = "v_findings f LEFT JOIN v_verdicts w ON w.finding_id = f.finding_id"


@query(f"SELECT CASE WHEN grouping(corpus) = 1 THEN 'all' ELSE corpus END AS corpus, count(*) AS findings, count(*) FILTER (WHERE verdict = 'TP') AS tp, count(*) FILTER (WHERE verdict = 'FP') AS fp, count(*) FILTER (WHERE verdict = 'FP') / count(*) AS fp_rate FROM {_JUDGED} GROUP BY ROLLUP (corpus)")
def h8_precision_tally(v: Views) -> DataFrame:
    return findings.precision_tally(v.findings, v.verdicts)


@query("SELECT cause, count(*) AS fp FROM v_findings f JOIN v_verdicts w ON w.finding_id = f.finding_id WHERE verdict = 'FP' GROUP BY cause")
def h9_fp_by_cause(v: Views) -> DataFrame:
    return findings.fp_by_cause(v.findings, v.verdicts)


@query(f"""SELECT rule_id, findings, fp, CASE WHEN sum(findings) OVER () > findings THEN (sum(fp) OVER () - fp) / (sum(findings) OVER () - findings) END AS rate_without FROM (
SELECT rule_id, count(*) AS findings, count(*) FILTER (WHERE verdict = 'FP') AS fp FROM {_JUDGED} GROUP BY rule_id) r""")
def h9_fp_by_rule(v: Views) -> DataFrame:
    return findings.fp_by_rule(v.findings, v.verdicts)


@query("""SELECT coalesce(b.finding_id, a.finding_id) AS finding_id, CASE WHEN a.finding_id IS NULL THEN 'killed' WHEN b.finding_id IS NULL THEN 'new' WHEN a.severity <> b.severity THEN 'regraded' ELSE 'survived' END AS change
  FROM v_findings b FULL OUTER JOIN v_findings_after a ON a.finding_id = b.finding_id""")
def h10_rerun_compare(v: Views) -> DataFrame:
    return findings.rerun_compare(v.findings, v.findings_after)


# --- I

_LINES = """SELECT doc_id, line_no, line, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (
SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no FROM v_marked_texts) x"""
_SECTIONS = f"""SELECT doc_id, line_no, line, section_no, coalesce(max(CASE WHEN starts_with(line, '@@ step:') THEN trim(substr(line, 9)) END) OVER (PARTITION BY doc_id, section_no), '') AS section FROM (
SELECT *, CAST(sum(CASE WHEN starts_with(line, '@@ step:') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section_no FROM ({_LINES}) l) s"""


def _sections(v: Views) -> DataFrame:
    return corpus.section_of(corpus.explode_lines(v.marked_texts))


@query(_LINES)
def i1_explode_lines(v: Views) -> DataFrame:
    return corpus.explode_lines(v.marked_texts)


@query(f"SELECT doc_id, line_no, section_no, section FROM ({_SECTIONS}) s")
def i2_section_of(v: Views) -> DataFrame:
    return _sections(v).select("doc_id", "line_no", "section_no", "section")


@query(f"""SELECT doc_id, section_no, section, text, CASE WHEN trim(text) = '' THEN 'empty section' ELSE '' END AS problem FROM (
SELECT doc_id, section_no, section, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT starts_with(line, '@@ ')), ''), '^[\n]+', '') AS text FROM ({_SECTIONS}) s WHERE section_no > 0 GROUP BY doc_id, section_no, section) t""")
def i3_section_text(v: Views) -> DataFrame:
    return corpus.section_text(_sections(v))


@query(f"""SELECT doc_id, line_no, section, rule_id, CASE WHEN problem = '' THEN reason ELSE '' END AS reason, problem FROM (
SELECT *, CASE WHEN rule_id = '' THEN 'names no rule' WHEN rule_id NOT IN ({_KNOWN}) THEN 'names no known rule' WHEN rule_id = 'L000' THEN 'names a rule that cannot be silenced' WHEN NOT starts_with(rest, 'reason=') THEN 'gives no reason' WHEN reason = '' THEN 'has no quoted reason' ELSE '' END AS problem FROM (
SELECT *, trim(regexp_extract(rest, '^reason="(.*)"$', 1)) AS reason FROM (
SELECT doc_id, line_no, section, split_part(body, ' ', 1) AS rule_id, trim(substr(body, length(split_part(body, ' ', 1)) + 1)) AS rest FROM (
SELECT *, trim(regexp_replace(substr(line, 10), '[ \t]+', ' ', 'g')) AS body FROM ({_SECTIONS}) s WHERE starts_with(line, '@@ ignore')) a) b) c) d""")
def i4_directives(v: Views) -> DataFrame:
    return corpus.directives(_sections(v), KNOWN_RULES)


_KV = "coalesce(max(CASE WHEN k = '{0}' THEN val END), {1})"


@query(f"""SELECT doc_id, section, table_name, key_name, batch, max_lag_bytes, CASE WHEN odd THEN 'a setting is not name=value' WHEN other THEN 'unknown setting' WHEN bad_batch THEN 'batch is not a positive number' WHEN bad_lag THEN 'max_lag_bytes is not a number'
       WHEN table_name = '' OR key_name = '' THEN 'table and key are needed' ELSE '' END AS problem FROM (
SELECT doc_id, section, line_no, {_KV.format('table', "''")} AS table_name, {_KV.format('key', "''")} AS key_name, coalesce(max(CASE WHEN k = 'batch' THEN TRY_CAST(val AS BIGINT) END), 1000) AS batch, coalesce(max(CASE WHEN k = 'max_lag_bytes' THEN TRY_CAST(val AS BIGINT) END), 0) AS max_lag_bytes,
       bool_or(instr(field, '=') = 0) AS odd, bool_or(k NOT IN ('table', 'key', 'batch', 'max_lag_bytes')) AS other, bool_or(k = 'batch' AND coalesce(TRY_CAST(val AS BIGINT), 0) <= 0) AS bad_batch, bool_or(k = 'max_lag_bytes' AND coalesce(TRY_CAST(val AS BIGINT), -1) < 0) AS bad_lag FROM (
SELECT *, split_part(field, '=', 1) AS k, split_part(field, '=', 2) AS val FROM (
SELECT doc_id, section, line_no, unnest(regexp_split_to_array(trim(substr(line, 13)), '[ \t]+')) AS field FROM ({_SECTIONS}) s WHERE starts_with(line, '@@ settings:')) a WHERE field <> '') b GROUP BY doc_id, section, line_no) c""")
def i5_settings(v: Views) -> DataFrame:
    return corpus.settings(_sections(v))


@query(f"SELECT doc_id, line_no, line FROM ({_LINES}) l WHERE starts_with(line, '@@ ') AND split_part(substr(line, 4), ' ', 1) NOT IN ('step:', 'ignore', 'settings:')")
def i6_unknown_markers(v: Views) -> DataFrame:
    return corpus.unknown_markers(corpus.explode_lines(v.marked_texts))


_VERSIONS = """SELECT repo, path, CAST(CASE WHEN d <> '' THEN d END AS BIGINT) AS version, regexp_extract(base, '^([0-9]+)_(.+)$', 2) AS name, CASE WHEN d = '' THEN 'not <version>_<name>' ELSE '' END AS problem FROM (
SELECT *, regexp_extract(base, '^([0-9]+)_(.+)$', 1) AS d FROM (SELECT repo, path, regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.sql$', ''), '\\.up$', '') AS base FROM v_paths WHERE NOT suffix(path, '.down.sql')) a) b"""


@query(_VERSIONS)
def i7_version_and_name(v: Views) -> DataFrame:
    return corpus.version_and_name(v.paths)


@query(f"""SELECT 'version' AS what, CAST(repo AS STRING) AS place, CAST(version AS STRING) AS key, count(*) AS n FROM ({_VERSIONS}) p WHERE version IS NOT NULL GROUP BY repo, version HAVING count(*) > 1
UNION ALL SELECT 'section', CAST(doc_id AS STRING), section, count(*) FROM (SELECT DISTINCT doc_id, section_no, section FROM ({_SECTIONS}) s WHERE section_no > 0) s GROUP BY doc_id, section HAVING count(*) > 1""")
def i8_duplicates(v: Views) -> DataFrame:
    versions = corpus.duplicates(corpus.version_and_name(v.paths).where("version is not null"), ["repo", "version"])
    sections = corpus.duplicates(_sections(v).where("section_no > 0").select("doc_id", "section_no", "section").distinct(), ["doc_id", "section"])
    shape = lambda df, what, place, key: df.select(F.lit(what).alias("what"), F.col(place).cast("string").alias("place"), F.col(key).cast("string").alias("key"), "n")
    return shape(versions, "version", "repo", "version").unionByName(shape(sections, "section", "doc_id", "section"))
