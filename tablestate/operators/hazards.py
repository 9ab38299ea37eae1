"""G. Hazards in a fleet's log of schema changes.

actions: repo, migration_no, step_no, stmt_no, action_no, step_kind, no_lock_timeout, action_kind, schema_name,
relation, column_name, referenced, constraint_name, type_name, mods, concurrent, not_valid, if_exists, has_where,
filled_by, condition_text, label, and, where the log has them, lock_mode, columns, literals. A statement's place is
(migration_no, step_no, stmt_no); a migration is a file. lock_mode is the mode that a lock_table action names (null:
the strongest). mods are a type's modifiers, numeric(10,2) has [10, 2]; columns are those of a created table, an array
of (name, type_name, mods); literals are the string literals of the action's statement. Null arrays are empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import not_null_column
from ..sources.tables import shared_folder
from .sizing import is_large, size_grade

STMT = ["repo", "migration_no", "step_no", "stmt_no"]
STEP = ["repo", "migration_no", "step_no"]

#: What each action locks on a Postgres server. Modes 1 access share, 2 row share, 3 row exclusive,
#: 4 share update exclusive, 5 share, 6 share row exclusive, 7 exclusive, 8 access exclusive; durations 1 instant,
#: 2 scan, 3 rewrite, 4 index build. None: any. Columns: action, concurrent, not valid, filled by, version from and
#: to, locked side, mode (None: the one that the action names), duration, implicit, reason.
RULES = [
    ("create_index", True, None, None, 0, 99, "relation", 4, 4, False, "built beside traffic"),
    ("create_index", False, None, None, 0, 99, "relation", 5, 4, False, "built while writers wait"),
    ("drop_table", None, None, None, 0, 99, "relation", 8, 1, False, "dropped"),
    ("drop_view", None, None, None, 0, 99, "relation", 8, 1, False, "dropped"),
    ("drop_sequence", None, None, None, 0, 99, "relation", 8, 1, False, "dropped"),
    ("drop_index", True, None, None, 0, 99, "relation", 4, 1, False, "dropped beside traffic"),
    ("drop_index", False, None, None, 0, 99, "relation", 8, 1, False, "dropped"),
    ("rename_table", None, None, None, 0, 99, "relation", 8, 1, False, "renamed"),
    ("rename_column", None, None, None, 0, 99, "relation", 8, 1, False, "renamed"),
    ("rename_index", None, None, None, 0, 11, "relation", 8, 1, False, "renamed"),
    ("rename_index", None, None, None, 12, 99, "relation", 4, 1, False, "renamed"),
    ("truncate", None, None, None, 0, 99, "relation", 8, 1, False, "emptied"),
    ("vacuum", None, None, None, 0, 99, "relation", 4, 2, False, "cleaned"),
    ("vacuum_full", None, None, None, 0, 99, "relation", 8, 3, False, "copied"),
    ("analyze", None, None, None, 0, 99, "relation", 4, 2, False, "sampled"),
    ("cluster", None, None, None, 0, 99, "relation", 8, 3, False, "copied in index order"),
    ("cluster", None, None, None, 0, 99, "referenced", 8, 3, True, "index rebuilt"),
    ("reindex_index", True, None, None, 0, 99, "relation", 4, 4, False, "rebuilt beside traffic"),
    ("reindex_index", False, None, None, 0, 99, "relation", 8, 4, False, "rebuilt"),
    ("reindex_table", True, None, None, 0, 99, "relation", 4, 4, False, "rebuilt beside traffic"),
    ("reindex_table", False, None, None, 0, 99, "relation", 5, 4, False, "rebuilt while writers wait"),
    ("refresh_view", True, None, None, 0, 99, "relation", 7, 2, False, "merged while writers wait"),
    ("refresh_view", False, None, None, 0, 99, "relation", 8, 3, False, "replaced"),
    ("create_partition", None, None, None, 0, 99, "referenced", 8, 1, True, "parent of the new partition"),
    ("create_referencing", None, None, None, 0, 99, "referenced", 6, 1, True, "referenced by the new table"),
    ("add_column", None, None, "none", 0, 99, "relation", 8, 1, False, "column added"),
    ("add_column", None, None, "constant", 0, 10, "relation", 8, 3, False, "rows rewritten for a default"),
    ("add_column", None, None, "constant", 11, 99, "relation", 8, 1, False, "default kept aside"),
    ("add_column", None, None, "volatile", 0, 99, "relation", 8, 3, False, "rows rewritten for a default"),
    ("add_column", None, None, "sequence", 0, 99, "relation", 8, 3, False, "rows rewritten for numbers"),
    ("add_column", None, None, "generated", 0, 99, "relation", 8, 3, False, "rows rewritten for an expression"),
    ("add_column", None, None, "unique", 0, 99, "relation", 8, 4, False, "index built under the lock"),
    ("drop_column", None, None, None, 0, 99, "relation", 8, 1, False, "column dropped"),
    ("column_default", None, None, None, 0, 99, "relation", 8, 1, False, "default changed"),
    ("drop_not_null", None, None, None, 0, 99, "relation", 8, 1, False, "null allowed"),
    ("set_not_null", None, None, None, 0, 99, "relation", 8, 2, False, "rows checked for null"),
    ("alter_type", None, None, None, 0, 99, "relation", 8, 3, False, "rows rewritten for a type"),
    ("add_foreign_key", None, True, None, 0, 99, "relation", 6, 1, False, "key added unchecked"),
    ("add_foreign_key", None, True, None, 0, 99, "referenced", 6, 1, True, "referenced by the key"),
    ("add_foreign_key", None, False, None, 0, 99, "relation", 6, 2, False, "key added and checked"),
    ("add_foreign_key", None, False, None, 0, 99, "referenced", 6, 2, True, "referenced by the key"),
    ("add_check", None, True, None, 0, 99, "relation", 8, 1, False, "check added unchecked"),
    ("add_check", None, False, None, 0, 99, "relation", 8, 2, False, "check added and checked"),
    ("add_primary_key", True, None, None, 0, 99, "relation", 8, 1, False, "index adopted"),
    ("add_primary_key", False, None, None, 0, 99, "relation", 8, 4, False, "index built under the lock"),
    ("add_exclusion", None, None, None, 0, 99, "relation", 8, 4, False, "index built under the lock"),
    ("validate_constraint", None, None, None, 0, 99, "relation", 4, 2, False, "rows checked beside traffic"),
    ("drop_constraint", None, None, None, 0, 99, "relation", 8, 1, False, "constraint dropped"),
    ("column_setting", None, None, None, 0, 99, "relation", 4, 1, False, "setting changed"),
    ("storage_setting", None, None, None, 0, 99, "relation", 4, 1, False, "setting changed"),
    ("attach_partition", None, None, None, 0, 11, "relation", 8, 1, False, "partition attached"),
    ("attach_partition", None, None, None, 12, 99, "relation", 4, 1, False, "partition attached"),
    ("attach_partition", None, None, None, 0, 99, "referenced", 8, 2, False, "rows checked against the bound"),
    ("detach_partition", True, None, None, 0, 99, "relation", 4, 1, False, "partition detached beside traffic"),
    ("detach_partition", True, None, None, 0, 99, "referenced", 4, 1, False, "partition detached beside traffic"),
    ("detach_partition", False, None, None, 0, 99, "relation", 8, 1, False, "partition detached"),
    ("detach_partition", False, None, None, 0, 99, "referenced", 8, 1, False, "partition detached"),
    ("alter_other", None, None, None, 0, 99, "relation", 8, 1, False, "other change"),
    ("lock_table", None, None, None, 0, 99, "relation", None, 1, False, "locked by name until the transaction ends"),
    ("select", None, None, None, 0, 99, "relation", 1, 2, False, "read"),
    ("select_for_update", None, None, None, 0, 99, "relation", 2, 2, False, "read and locked"),
    ("insert", None, None, None, 0, 99, "relation", 3, 1, False, "written"),
    ("update", None, None, None, 0, 99, "relation", 3, 2, False, "searched and written"),
    ("delete", None, None, None, 0, 99, "relation", 3, 2, False, "searched and written"),
]
CREATES = ("create_table", "create_partition", "create_referencing")
COLUMNS_TYPE, MODS_TYPE, LITERALS_TYPE = "array<struct<name:string,type_name:string,mods:array<int>>>", "array<int>", "array<string>"
RULE_COLUMNS = "ord int, kind string, r_concurrent boolean, r_not_valid boolean, r_filled_by string, version_from int, version_to int, side string, mode int, duration int, implicit boolean, reason string"


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], RULE_COLUMNS)


def effects(actions: DataFrame, version: int = 16) -> DataFrame:
    """actions with locked, mode, duration, implicit, reason, ord: a row for each lock. Actions that lock nothing have none.

    A broadcast join with the fixed rule table; flags and the version's range decide among a kind's rules. Actions
    without a column lock_mode name none.
    """
    r = F.broadcast(rule_table(actions.sparkSession).where((F.col("version_from") <= version) & (F.col("version_to") >= version)))
    same = lambda rule, own: F.col(rule).isNull() | (F.col(rule) == F.col(own))
    joined = actions.join(r, (F.col("kind") == F.col("action_kind")) & same("r_concurrent", "concurrent") & same("r_not_valid", "not_valid") & same("r_filled_by", "filled_by"))
    locked = F.when(F.col("side") == "relation", F.col("relation")).otherwise(F.col("referenced"))
    named = F.coalesce("lock_mode", F.lit(8)).cast("int") if "lock_mode" in actions.columns else F.lit(8)
    return joined.withColumns({"locked": locked, "mode": F.coalesce("mode", named)}).drop("kind", "r_concurrent", "r_not_valid", "r_filled_by", "version_from", "version_to", "side")


def outside_transaction(version: int = 16) -> Column:
    """Whether an action refuses to run in a transaction."""
    kind, beside = F.col("action_kind"), F.col("concurrent")
    with_flag = kind.isin("create_index", "drop_index", "reindex_index", "reindex_table", "detach_partition") & beside
    always = kind.isin("vacuum", "vacuum_full", "reindex_schema", "cluster_all")
    return with_flag | always | ((kind == "add_enum_value") & F.lit(version < 12))


def statement_profile(actions: DataFrame, version: int = 16) -> DataFrame:
    """For each statement its strongest lock and what it blocks; ties keep the first."""
    e = effects(actions, version)
    rank = F.struct("mode", "duration", -F.col("action_no"), -F.col("ord"))
    top = e.groupBy(*STMT).agg(F.max_by(F.struct("locked", "mode", "duration"), rank).alias("top"), F.bool_or(F.col("mode") == 8).alias("blocks_reads"), F.bool_or(F.col("mode") >= 5).alias("blocks_writes"))
    no_tx = actions.groupBy(*STMT).agg(F.bool_or(outside_transaction(version)).alias("no_tx"))
    return no_tx.join(top, STMT, "left").select(*STMT, "top.locked", "top.mode", "top.duration", F.coalesce("blocks_reads", F.lit(False)).alias("blocks_reads"), F.coalesce("blocks_writes", F.lit(False)).alias("blocks_writes"), "no_tx")


def fresh_at(probes: DataFrame, actions: DataFrame, name: str = "relation") -> DataFrame:
    """probes with fresh: the relation is this migration's own creation at that statement.

    A creation counts at its own statement, a drop only after it; names are compared in lower case. One sort by
    migration and name, no theta join.
    """
    key = ["repo", "migration_no", "__name"]
    born = F.when(F.col("action_kind").isin(*CREATES), True).when(F.col("action_kind") == "drop_table", False)
    events = actions.withColumn("__born", born).where("__born is not null").select("repo", "migration_no", F.lower("relation").alias("__name"), "step_no", "stmt_no", F.when(F.col("__born"), 0).otherwise(2).alias("__turn"), "__born", F.lit(False).alias("__probe"))
    asked = probes.withColumns({"__name": F.lower(F.col(name)), "__turn": F.lit(1), "__born": F.lit(None).cast("boolean"), "__probe": F.lit(True)})
    w = Window.partitionBy(*key).orderBy("step_no", "stmt_no", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(events, allowMissingColumns=True)
    return both.withColumn("fresh", F.coalesce(F.last("__born", ignorenulls=True).over(w), F.lit(False))).where("__probe").drop("__name", "__turn", "__born", "__probe")


def created_here(probes: DataFrame, actions: DataFrame, name: str = "relation") -> DataFrame:
    """probes with created: the relation was created strictly earlier in the same file; a later drop does not undo it.

    Names are compared as written; schemas match when equal or when either is empty.
    """
    made = actions.where(F.col("action_kind").isin(*CREATES)).groupBy("repo", "migration_no", F.col("relation").alias("__r"), F.col("schema_name").alias("__s")).agg(F.min(F.struct("step_no", "stmt_no")).alias("__first"))
    by_name = made.groupBy("repo", "migration_no", "__r").agg(F.map_from_entries(F.collect_list(F.struct("__s", "__first"))).alias("__made"))
    joined = probes.join(by_name.withColumnRenamed("__r", name), ["repo", "migration_no", name], "left")
    here = F.struct("step_no", "stmt_no")
    hit = F.exists(F.map_entries("__made"), lambda e: ((e["key"] == F.col("schema_name")) | (e["key"] == "") | (F.col("schema_name") == "")) & (e["value"] < here))
    return joined.withColumn("created", F.coalesce(hit, F.lit(False))).drop("__made")


def blockable(e: DataFrame, actions: DataFrame) -> DataFrame:
    """effects with blockable: can the lock block anyone: not on a fresh relation, not a drop-if-exists of one never created."""
    ever = actions.where(F.col("action_kind").isin(*CREATES)).select("repo", F.lower("relation").alias("__ever")).distinct().withColumn("__made", F.lit(True))
    fresh = fresh_at(e, actions, "locked").withColumn("__ever", F.lower("locked")).join(ever, ["repo", "__ever"], "left")
    idle = (F.col("action_kind") == "drop_table") & F.col("if_exists") & F.col("__made").isNull()
    return fresh.withColumn("blockable", ~F.col("fresh") & ~idle).drop("__ever", "__made")


def _array(df: DataFrame, name: str, kind: str) -> Column:
    """An array column, empty where it is null or the log has none."""
    empty = F.array().cast(kind)
    return F.coalesce(F.col(name).cast(kind), empty) if name in df.columns else empty


def type_events(actions: DataFrame) -> DataFrame:
    """(repo, place, relation, column_name, spec, nth): each time a column's type is said, by a create, an add or a change.

    Names are in lower case. spec is (type_name, mods); nth orders what one statement says of a column.
    """
    spec = F.struct("type_name", _array(actions, "mods", MODS_TYPE).alias("mods"))
    said = actions.where("action_kind IN ('add_column', 'alter_type')").select(*STMT, F.lower("relation").alias("relation"), F.lower("column_name").alias("column_name"), spec.alias("spec"), F.struct("action_no", F.lit(0).alias("at")).alias("nth"))
    born = actions.where(F.col("action_kind").isin(*CREATES)).select(*STMT, "relation", "action_no", F.posexplode(_array(actions, "columns", COLUMNS_TYPE)).alias("at", "c"))
    spec = F.struct(F.col("c.type_name").alias("type_name"), F.coalesce("c.mods", F.array().cast(MODS_TYPE)).alias("mods"))
    return said.unionByName(born.select(*STMT, F.lower("relation").alias("relation"), F.lower("c.name").alias("column_name"), spec.alias("spec"), F.struct("action_no", "at").alias("nth")))


def type_before(actions: DataFrame) -> DataFrame:
    """Type changes with prior (type_name, mods): the column's last known type strictly before, across files; null if unknown.

    An as-of lookup as one sort by (repo, relation, column): probes stand before the events of their own statement, of
    which the last counts for later ones. A column that a created table is born with is known from there on.
    """
    known = type_events(actions).withColumnsRenamed({"relation": "__r", "column_name": "__c", "spec": "__spec", "nth": "__nth"}).withColumn("__turn", F.lit(1))
    asked = actions.where("action_kind = 'alter_type'").withColumns({"__r": F.lower("relation"), "__c": F.lower("column_name"), "__turn": F.lit(0)})
    w = Window.partitionBy("repo", "__r", "__c").orderBy("migration_no", "step_no", "stmt_no", "__turn", "__nth").rowsBetween(Window.unboundedPreceding, 0)
    return asked.unionByName(known, allowMissingColumns=True).withColumn("prior", F.last("__spec", ignorenulls=True).over(w)).where("__turn = 0").drop("__r", "__c", "__spec", "__nth", "__turn")


def in_place_type_change(changes: DataFrame) -> DataFrame:
    """Type changes with in_place: the server rewrites nothing. An unknown prior type means a rewrite.

    In place are: the same type and modifiers; varchar to a limit that is no lower, to none, or to text; numeric to one
    without modifiers, or from two modifiers to two with the same scale and a precision that is no lower.
    """
    was, new = F.col("prior.type_name"), F.col("type_name")
    mods, to = F.coalesce("prior.mods", F.array().cast(MODS_TYPE)), _array(changes, "mods", MODS_TYPE)
    both = lambda name: (was == name) & (new == name)
    no_lower, unbound = F.get(to, F.lit(0)) >= F.get(mods, F.lit(0)), F.size(to) == 0
    wider = both("varchar") & (unbound | ((F.size(mods) == 1) & no_lower))
    precise = both("numeric") & (unbound | ((F.size(mods) == 2) & (F.size(to) == 2) & no_lower & (F.get(to, F.lit(1)) == F.get(mods, F.lit(1)))))
    same = (was == new) & (mods == to)
    return changes.withColumn("in_place", F.coalesce(same | wider | ((was == "varchar") & (new == "text")) | precise, F.lit(False)))


def column_added_in_file(probes: DataFrame, actions: DataFrame) -> DataFrame:
    """probes with column_added: earlier in the same file the column was created with its table, added or given a type; names in lower case."""
    key = ["repo", "migration_no", "__r", "__c"]
    first = type_events(actions).withColumnsRenamed({"relation": "__r", "column_name": "__c"}).groupBy(*key).agg(F.min(F.struct("step_no", "stmt_no")).alias("__first"))
    joined = probes.withColumns({"__r": F.lower("relation"), "__c": F.lower("column_name")}).join(first, key, "left")
    return joined.withColumn("column_added", F.coalesce(F.col("__first") < F.struct("step_no", "stmt_no"), F.lit(False))).drop("__first", "__r", "__c")


def lock_domains(actions: DataFrame, parents: DataFrame, view_bases: DataFrame, version: int = 16) -> DataFrame:
    """(step, n_domains, n_stmts): transactions whose access-exclusive locks stop two or more independent tables by two or more statements.

    A relation stands for its parent (the last in the lineage wins); one without a parent that is a view over something
    that the step locks adds no domain, though its statement counts. Parents, views and bases go by lower-case names,
    domains as written. The locks are computed once: what a step locks is gathered beside each of its rows.
    """
    last = parents.groupBy("repo", F.lower("relation").alias("__r")).agg(F.max_by(F.lower("parent"), F.struct("migration_no", "ord")).alias("__parent"))
    strongest = effects(actions.where("step_kind = 'ddl_tx'"), version).where("mode = 8")
    bases = view_bases.groupBy("repo", F.lower("relation").alias("__r")).agg(F.collect_set(F.lower("base")).alias("__bases"))
    locked = blockable(strongest, actions).where("blockable").groupBy(*STEP, "locked").agg(F.collect_set("stmt_no").alias("__stmts")).withColumn("__r", F.lower("locked"))
    beside = locked.withColumn("__all", F.collect_set("locked").over(Window.partitionBy(*STEP))).join(bases, ["repo", "__r"], "left").join(last, ["repo", "__r"], "left")
    covered = F.col("__parent").isNull() & F.coalesce(F.arrays_overlap("__bases", "__all"), F.lit(False))
    domain = F.when(~covered, F.coalesce("__parent", "locked"))
    counted = beside.groupBy(*STEP).agg(F.count_distinct(domain).alias("n_domains"), F.size(F.array_distinct(F.flatten(F.collect_list("__stmts")))).cast("long").alias("n_stmts"))
    return counted.where("n_domains >= 2 and n_stmts >= 2")


def long_work_with_company(actions: DataFrame, version: int = 16) -> DataFrame:
    """(step, stmt_no, locked, duration, others): the heaviest row work of a transaction and the other blocking statements with it."""
    e = blockable(effects(actions.where("step_kind = 'ddl_tx'"), version), actions).where("blockable")
    rank = F.struct(F.col("duration"), -F.col("stmt_no"), -F.col("action_no"), -F.col("ord"))
    heavy = e.where("not implicit and duration >= 2").groupBy(*STEP).agg(F.max_by(F.struct("stmt_no", "locked", "duration"), rank).alias("h"))
    blocking = e.where("mode >= 5").select(*STEP, F.col("stmt_no").alias("__s")).distinct()
    joined = heavy.join(blocking, STEP).where("__s <> h.stmt_no")
    return joined.groupBy(*STEP).agg(F.first("h").alias("h"), F.count("*").alias("others")).select(*STEP, "h.stmt_no", "h.locked", "h.duration", "others")


def before_backfill(actions: DataFrame) -> DataFrame:
    """(statement, rule_id): indexes (L022) and foreign keys (L023) added before the step that fills the table; bare names as written."""
    fill = actions.where("step_kind = 'backfill'").groupBy("repo", "migration_no", "relation").agg(F.max("step_no").alias("__fill"))
    rule = F.when(F.col("action_kind") == "create_index", "L022").when(F.col("action_kind") == "add_foreign_key", "L023")
    early = actions.withColumn("rule_id", rule).where("rule_id is not null").join(fill, ["repo", "migration_no", "relation"])
    return early.where("__fill > step_no").select(*STMT, "action_no", "rule_id")


def used_after_added_in_txn(actions: DataFrame) -> DataFrame:
    """(statement, label): statements of any kind with a literal that is an enum label added earlier in the same transaction; exact match.

    Literals are exploded and meet each step's first addition of a label by equality; a statement has a row for each
    such label, however many of its actions or literals say it.
    """
    tx = actions.where("step_kind = 'ddl_tx'")
    added = tx.where("action_kind = 'add_enum_value' AND label <> ''").groupBy(*STEP, "label").agg(F.min("stmt_no").alias("__added"))
    said = tx.select(*STMT, F.explode(_array(actions, "literals", LITERALS_TYPE)).alias("label"))
    return said.join(added, [*STEP, "label"]).where("stmt_no > __added").select(*STMT, "label").distinct()


def timeout_off(actions: DataFrame, version: int = 16) -> DataFrame:
    """(step, mode): steps that block and switch the wait limit off."""
    return effects(actions, version).groupBy(*STEP).agg(F.max("mode").alias("mode"), F.bool_or("no_lock_timeout").alias("off")).where("mode >= 5 and off").select(*STEP, "mode")


def never_granted(actions: DataFrame) -> DataFrame:
    """(statement, relation): tables that their own file neither drops, anywhere, nor grants access to, later on, in a lineage that does grant.

    A grant names the table or covers all that exist when it runs, so one above the create does not count. Names are as
    written and bare. Creates, drops and grants are short tables that meet by file.
    """
    file, place = ["repo", "migration_no"], F.struct("step_no", "stmt_no")
    made = actions.where(F.col("action_kind").isin(*CREATES)).select(*STMT, "relation").distinct()
    gone = actions.where("action_kind = 'drop_table'").select(*file, "relation").distinct()
    grants = actions.where("action_kind IN ('grant', 'grant_all')")
    named = grants.where("action_kind = 'grant'").groupBy(*file, "relation").agg(F.max(place).alias("__named"))
    everywhere = grants.where("action_kind = 'grant_all'").groupBy(*file).agg(F.max(place).alias("__all"))
    left = made.join(grants.select("repo").distinct(), "repo", "left_semi").join(gone, [*file, "relation"], "left_anti").join(named, [*file, "relation"], "left").join(everywhere, file, "left")
    later = F.coalesce(F.col("__named") > place, F.lit(False)) | F.coalesce(F.col("__all") > place, F.lit(False))
    return left.where(~later).select(*STMT, "relation")


def not_null_proof(probes: DataFrame, actions: DataFrame) -> DataFrame:
    """probes with proven: the file has a check on the relation that says exactly that the column is not null, and it holds.

    It holds if it is checked when it is added, or a constraint of its name is validated anywhere in the file. Names
    are as written, the column as the server reads it. A check on another column, or on more, proves nothing.
    """
    key = ["repo", "migration_no", "relation"]
    validated = actions.where("action_kind = 'validate_constraint'").select(*key, "constraint_name").distinct().withColumn("__v", F.lit(True))
    checks = actions.where("action_kind = 'add_check'").select(*key, "constraint_name", "not_valid", not_null_column(F.col("condition_text")).alias("column_name")).where("column_name IS NOT NULL")
    proof = checks.join(validated, [*key, "constraint_name"], "left").where("NOT not_valid OR __v").select(*key, "column_name").distinct().withColumn("__p", F.lit(True))
    return probes.join(proof, [*key, "column_name"], "left").withColumn("proven", F.coalesce("__p", F.lit(False))).drop("__p")


def _heaviest(spark: SparkSession, version: int) -> DataFrame:
    """(kind, its flags) with the longest duration of its explicit locks: the rule table, flags written out."""
    rules = [r for r in RULES if r[4] <= version <= r[5] and not r[9]]
    fills = sorted({r[3] for r in rules if r[3] is not None}) + [""]
    fits = lambda rule, own: rule is None or rule == own
    rows = []
    for kind in sorted({r[0] for r in rules}):
        for beside in (True, False):
            for unchecked in (True, False):
                for fill in fills:
                    found = [r[8] for r in rules if r[0] == kind and fits(r[1], beside) and fits(r[2], unchecked) and fits(r[3], fill)]
                    if found:
                        rows.append((kind, beside, unchecked, fill, max(found)))
    return spark.createDataFrame(rows, "action_kind string, __beside boolean, __unchecked boolean, __fill string, duration int")


def with_context(actions: DataFrame, stats: DataFrame, version: int = 16) -> DataFrame:
    """actions with what the rules look at: created, column_added, proven, in_place, duration, sized, large.

    The same columns as created_here, column_added_in_file, not_null_proof (of set_not_null actions) and
    in_place_type_change give, but as windows over one partitioning by file; only type changes are looked up across
    files, apart from the rest.
    """
    typed = in_place_type_change(type_before(actions)).drop("prior")
    rest = actions.where("action_kind is null or action_kind <> 'alter_type'").withColumn("in_place", F.lit(False))
    columns = {"__r": F.lower("relation"), "__c": F.lower("column_name")}
    said = type_events(actions).select(*STMT, F.col("relation").alias("__r"), F.col("column_name").alias("__c"), F.lit(True).alias("__said"))
    rows = rest.unionByName(typed).withColumns(columns).unionByName(said, allowMissingColumns=True).repartition("repo", "migration_no")
    kind, place, schema = F.col("action_kind"), F.struct("step_no", "stmt_no"), F.col("schema_name")
    file = ["repo", "migration_no"]
    over = lambda c, *more: c.over(Window.partitionBy(*file, *more))
    rows = rows.withColumn("column_added", F.coalesce(over(F.min(F.when(F.col("__said"), place)), "__r", "__c") < place, F.lit(False))).where("__said IS NULL").drop("__said", "__r", "__c")
    made = kind.isin(*CREATES)
    any_, bare, same = (over(F.min(F.when(made & w, place)), "relation", *more) for w, more in ((F.lit(True), ()), (schema == "", ()), (F.lit(True), ("schema_name",))))
    rows = rows.withColumn("__same", same).withColumns({"__any": any_, "__bare": bare})  # in this order one sort serves all three
    checked = F.when(kind == "add_check", not_null_column(F.col("condition_text")))
    holds = ~F.col("not_valid") | over(F.max(kind == "validate_constraint"), "relation", "constraint_name")
    rows = rows.withColumn("__holds", holds & checked.isNotNull()).withColumn("__column", F.coalesce(checked, "column_name"))
    rows = rows.withColumn("proven", F.coalesce(over(F.max("__holds"), "relation", "__column"), F.lit(False)) & (kind == "set_not_null"))
    created = F.when(schema == "", F.col("__any")).otherwise(F.least("__bare", "__same")) < place
    rows = rows.withColumn("created", F.coalesce(created, F.lit(False))).drop("__any", "__bare", "__same", "__holds", "__column")
    heaviest = _heaviest(actions.sparkSession, version)
    fills = [r[3] for r in RULES if r[3] is not None]
    flags = {"__beside": F.coalesce("concurrent", F.lit(False)), "__unchecked": F.coalesce("not_valid", F.lit(False)), "__fill": F.when(F.col("filled_by").isin(*fills), F.col("filled_by")).otherwise("")}
    rows = rows.withColumns(flags).join(F.broadcast(heaviest), ["action_kind", *flags], "left").drop(*flags)
    ctx = rows.join(stats.select("relation", "exists", "n_rows", "n_bytes"), "relation", "left")
    size = [F.col("exists"), F.col("n_rows"), F.col("n_bytes")]
    return ctx.withColumns({"sized": size_grade(*size), "large": is_large(*size), "duration": F.coalesce("duration", F.lit(0))}).drop("exists", "n_rows", "n_bytes")


def predicate_table(version: int = 16) -> list[tuple[str, Column, Column]]:
    """(rule, condition, severity) of the rules that look at one action; 1 info, 2 warn, 3 error."""
    kind, old = F.col("action_kind"), ~F.col("created")
    sized, fixed = F.col("sized"), lambda n: F.lit(n)
    is_ = lambda *k: kind.isin(*k)
    named_condition = F.lower("condition_text").contains("indisvalid")
    return [
        ("L001", is_("create_index") & ~F.col("concurrent") & old, sized),
        ("L002", outside_transaction(version) & (F.col("step_kind") == "ddl_tx"), fixed(3)),
        ("L003", is_("add_column") & (F.col("duration") == 3) & old, sized),
        ("L004", is_("alter_type") & ~F.col("in_place") & old, sized),
        ("L005", is_("set_not_null") & old & ~(F.col("proven") & F.lit(version >= 12)), sized),
        ("L006", is_("add_foreign_key") & ~F.col("not_valid") & old, sized),
        ("L007", is_("add_check") & ~F.col("not_valid") & old, sized),
        ("L008", is_("add_primary_key") & ~F.col("concurrent") & old, sized),
        ("L009", is_("add_column") & (F.col("filled_by") == "unique") & old, fixed(2)),
        ("L010", is_("vacuum_full", "cluster"), fixed(3)),
        ("L011", is_("refresh_view") & ~F.col("concurrent"), fixed(2)),
        ("L030", is_("drop_table", "drop_column") & old, fixed(2)),
        ("L031", is_("rename_table", "rename_column") & old & ~F.col("column_added"), fixed(3)),
        ("L033", is_("truncate") & old, fixed(3)),
        ("L040", is_("update", "delete") & ~F.col("has_where") & (F.col("step_kind") != "backfill") & old, sized),
        ("L041", is_("delete") & F.col("large") & (F.col("step_kind") != "backfill") & old, sized),
        ("L042", is_("create_index") & F.col("concurrent") & (F.col("condition_text") != "") & ~named_condition, fixed(1)),
    ]


#: Rules that speak once for a statement, of its first action that they flag; dropped columns are spoken of one by one.
ONCE = {"L030": "drop_table", "L033": "truncate"}


def single_action_rules(ctx: DataFrame, version: int = 16) -> DataFrame:
    """(statement, action_no, relation, rule_id, severity): every rule in one pass over the rows of with_context."""
    each = [F.when(c, F.struct(F.lit(r).alias("rule_id"), s.cast("int").alias("severity"))) for r, c, s in predicate_table(version)]
    found = ctx.select(*STMT, "action_no", "relation", "action_kind", F.explode(F.array_compact(F.array(*each))).alias("f")).select("*", "f.rule_id", "f.severity")
    once = F.lit(False)
    for rule, kind in ONCE.items():
        once = once | ((F.col("rule_id") == rule) & (F.col("action_kind") == kind))
    first = found.groupBy(*STMT, "rule_id", F.when(~once, F.col("action_no")).alias("__each"), "severity").agg(F.min(F.struct("action_no", "relation")).alias("a"))
    return first.select(*STMT, "a.action_no", "a.relation", "rule_id", "severity")


def order_findings(findings: DataFrame) -> DataFrame:
    """findings in their order. They are written out first: a global sort reads its input twice, for its ranges and for its rows."""
    spark = findings.sparkSession
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    findings.write.parquet(path)
    return spark.read.schema(findings.schema).parquet(path).orderBy("repo", "migration_no", "step_no", "stmt_no", "action_no", "rule_id")


def relations_touched(actions: DataFrame, version: int = 16) -> DataFrame:
    """The distinct relations that the actions lock, implicit ones included."""
    return effects(actions, version).select(F.col("locked").alias("relation")).distinct()
