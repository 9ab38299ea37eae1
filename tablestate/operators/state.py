"""B. State comparison: decide from facts whether tables and schemas are what they should be."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from .running import running

#: Sections of a schema's description, in order.
SECTIONS = ("columns", "indexes", "constraints", "sequences", "ownership", "grants")
BOOKKEEPING = "bookkeeping"


def _tf(c: str) -> Column:
    return F.when(F.col(c), "t").otherwise("f")


def catalog_lines(columns: DataFrame, indexes: DataFrame, constraints: DataFrame, sequences: DataFrame, relations: DataFrame, grants: DataFrame, own: str = BOOKKEEPING) -> DataFrame:
    """(db, section_no, section, line) of six catalog tables. System schemas and our own are left out.

    Three sections name the system schemas; the others leave out every schema that begins with pg_.
    """
    named = ~F.col("schema_name").isin("pg_catalog", "information_schema", own)
    begins = ~F.col("schema_name").startswith("pg_") & ~F.col("schema_name").isin("information_schema", own)
    owners = relations.select("db", "oid", "schema_name", "name")
    dot = lambda *c: F.concat_ws(".", *c)
    parts = [
        columns.where(named).select("db", F.concat(dot("schema_name", "relation", "name"), F.lit(" "), "data_type", F.lit(" null="), "nullable", F.lit(" default="), F.coalesce("default_text", F.lit("-"))).alias("line")),
        indexes.join(owners, ["db", "oid"]).where(begins).select("db", F.concat(dot("schema_name", "name"), F.lit(" valid="), _tf("valid"), F.lit(" ready="), _tf("ready"), F.lit(" live="), _tf("live"), F.lit(" "), "definition").alias("line")),
        constraints.where(begins).select("db", F.concat(dot("schema_name", "relation", "name"), F.lit(" type="), "kind", F.lit(" validated="), _tf("validated"), F.lit(" "), "definition").alias("line")),
        sequences.where(named).select("db", F.concat(dot("schema_name", "name"), F.lit(" start="), F.col("start_value").cast("string"), F.lit(" increment="), F.col("increment").cast("string")).alias("line")),
        relations.where(begins & F.col("kind").isin("r", "p", "S", "v", "m")).select("db", F.concat(dot("schema_name", "name"), F.lit(" owner="), "owner").alias("line")),
        grants.where(named).select("db", F.concat(dot("schema_name", "relation"), F.lit(" "), "grantor", F.lit(" -> "), "grantee", F.lit(": "), "privilege").alias("line")),
    ]
    out = None
    for no, (name, df) in enumerate(zip(SECTIONS, parts)):
        df = df.select(F.col("db").cast("long").alias("db"), F.lit(no).alias("section_no"), F.lit(name).alias("section"), "line")
        out = df if out is None else out.unionByName(df)
    return out


def schema_fingerprint(lines: DataFrame) -> DataFrame:
    """(db, sha256): equal exactly when the descriptions are. Lines sort by bytes; a section's header stands even when it is empty.

    A digest of a whole text reads it in order, so one task reads a database's lines; they are sorted there, by Spark,
    which spills, and digested as they pass: no database's text is ever held. Null lines do not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, digest, db, section = [], None, None, 0

        def close() -> None:
            digest.update("".join(f"[{name}]\n" for name in SECTIONS[section:]).encode())
            done.append((db, digest.hexdigest()))

        for batch in batches:
            for (d, no), rows in groupby(zip(*(c.to_pylist() for c in batch.columns)), lambda r: r[:2]):
                if digest is None or d != db:
                    if digest is not None:
                        close()
                    digest, db, section = sha256(), d, 0
                headers = "".join(f"[{name}]\n" for name in SECTIONS[section : no + 1])
                digest.update((headers + "".join(f"{line}\n" for *_, line in rows if line is not None)).encode())
                section = max(section, no + 1)
        if digest is not None:
            close()
        yield pa.RecordBatch.from_pydict({"db": [d for d, _ in done], "sha256": [x for _, x in done]}, pa.schema([("db", pa.int64()), ("sha256", pa.string())]))

    placed = lines.select(F.col("db").cast("long").alias("db"), F.col("section_no").cast("int").alias("section_no"), "line")
    return placed.repartition("db").sortWithinPartitions("db", "section_no", "line").mapInArrow(run, "db long, sha256 string")


def schema_describe(lines: DataFrame) -> DataFrame:
    """The lines with their place in the database's description.

    Distinct lines are dealt by range and written to the shared folder, so that each has a range for good; running
    counts within ranges place them, and repeats follow one another. So no task holds a database's catalog.
    """
    spark = lines.sparkSession
    folder = f"{shared_folder(spark)}/described-{uuid.uuid4().hex}"
    distinct = lines.groupBy(*lines.columns).agg(F.count("*").alias("n_"))
    distinct.repartitionByRange("db", "section_no", "line").withColumn("part_", F.spark_partition_id()).write.parquet(folder)
    kept = spark.read.parquet(folder)
    placed = running(kept, ["db"], F.col("part_"), ["section_no", "line"], before_=("sum", F.col("n_")))
    first = F.coalesce("before_", F.lit(0)) + 1
    return placed.select(*lines.columns, F.explode(F.sequence(first.cast("int"), (first + F.col("n_") - 1).cast("int"))).alias("position"))


def schema_diff(want: DataFrame, got: DataFrame) -> DataFrame:
    """(sign, line): '-' lines only in want, '+' lines only in got; repeats of a missing line stay, blank lines do not count."""
    want, got = (x.select("line").where(F.trim("line") != "") for x in (want, got))
    return want.join(got, "line", "left_anti").select(F.lit("-").alias("sign"), "line").unionByName(got.join(want, "line", "left_anti").select(F.lit("+").alias("sign"), "line"))


def neighbour_diffs(lines: DataFrame) -> DataFrame:
    """(db, sign, line): each database's description against that of the next number, where both have lines.

    As schema_diff, in one grouping: a line counts for its own database and for the one before.
    """
    lines = lines.where("trim(line) <> '' AND db IS NOT NULL")
    sides = lines.select("line", F.explode(F.array(F.struct("db", F.lit(1).alias("mine")), F.struct((F.col("db") - 1).alias("db"), F.lit(0).alias("mine")))).alias("x_")).select("x_.db", "x_.mine", "line")
    counts = sides.groupBy("db", "line").agg(F.sum("mine").alias("want"), F.sum(1 - F.col("mine")).alias("got"))
    both = counts.groupBy("db").agg(F.max("want").alias("w"), F.max("got").alias("g")).where("w > 0 AND g > 0")
    one = counts.where("want = 0 OR got = 0").join(both, "db", "left_semi")
    sign = F.when(F.col("want") > 0, "-").otherwise("+")
    return one.select("db", sign.alias("sign"), "line", F.explode(F.array_repeat(F.lit(0), (F.col("want") + F.col("got")).cast("int")))).drop("col")


def row_line(columns: list[str]) -> Column:
    """A row as one text: columns in order, null marked apart from any value."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns])


def table_checksum(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(rows, low, high): a content checksum that does not depend on row order, in one pass with partial sums.

    low and high are exact sums over rows of two 60-bit parts of each row's md5. An empty table has (0, 0, 0).
    """
    digest = F.md5(row_line(columns))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    aggs = [F.count("*").alias("rows"), F.coalesce(F.sum(part(1)), F.lit(0)).cast("string").alias("low"), F.coalesce(F.sum(part(16)), F.lit(0)).cast("string").alias("high")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def row_diff(want: DataFrame, got: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, kind, changed): rows missing from got, extra in it, or changed, with the changed columns' names."""
    w = want.select(*keys, *[F.col(c).alias(f"__w_{c}") for c in columns], F.lit(1).alias("__w"))
    g = got.select(*keys, *[F.col(c).alias(f"__g_{c}") for c in columns], F.lit(1).alias("__g"))
    both = w.join(g, keys, "full_outer")
    changed = F.concat_ws(",", *[F.when(~F.col(f"__w_{c}").eqNullSafe(F.col(f"__g_{c}")), F.lit(c)) for c in columns])
    kind = F.when(F.col("__g").isNull(), "missing").when(F.col("__w").isNull(), "extra").when(changed != "", "changed")
    return both.select(*keys, kind.alias("kind"), F.when(kind == "changed", changed).otherwise("").alias("changed")).where(F.col("kind").isNotNull())


def problem_report(objects: DataFrame, steps: DataFrame, ownership: DataFrame, sessions: DataFrame) -> DataFrame:
    """(check_name, detail): six checks that must be empty."""
    row = lambda df, name, detail: df.select(F.lit(name).alias("check_name"), detail.alias("detail"))
    name = F.concat(F.col("db").cast("string"), F.lit("."), F.col("name"))
    step = F.concat(F.col("migration_no").cast("string"), F.lit("/"), F.col("step_no").cast("string"))
    bad = steps.where("status <> 'succeeded'")
    return (
        row(objects.where("kind = 'index' and not (valid and ready)"), "invalid index", name)
        .unionByName(row(objects.where("kind = 'constraint' and not validated"), "unvalidated constraint", name))
        .unionByName(row(bad, "step not succeeded", step))
        .unionByName(row(bad.select("migration_no").distinct(), "migration not succeeded", F.col("migration_no").cast("string")))
        .unionByName(row(ownership.where("held"), "ownership held", F.col("resource").cast("string")))
        .unionByName(row(sessions.where("state = 'idle in transaction'"), "idle in transaction", F.col("pid").cast("string")))
    )


def object_satisfied(expected: DataFrame, catalog: DataFrame) -> DataFrame:
    """expected with satisfied: is each object in its finished state; null for kinds that cannot be inferred.

    An index is finished when it is there, valid and ready; a constraint when it is there, its validation being a kind
    of its own; `<kind>_absent` when the object is not there.
    """
    base = F.regexp_replace(F.when(F.col("kind") == "constraint_validated", "constraint").otherwise(F.col("kind")), "_absent$", "")
    facts = catalog.select("db", F.col("kind").alias("__kind"), "schema_name", "name", "member", "valid", "ready", "validated", F.lit(True).alias("__there"))
    joined = expected.withColumn("__kind", base).join(facts, ["db", "__kind", "schema_name", "name", "member"], "left")
    there = F.coalesce("__there", F.lit(False))
    known = F.col("__kind").isin("index", "column", "constraint", "relation", "enum")
    done = (
        F.when(~known, F.lit(None))
        .when(F.col("kind").endswith("_absent"), ~there)
        .when(F.col("kind") == "index", there & F.col("valid") & F.col("ready"))
        .when(F.col("kind") == "constraint_validated", there & F.col("validated"))
        .otherwise(there)
    )
    return joined.withColumn("satisfied", done.cast("boolean")).drop("__kind", "__there", "valid", "ready", "validated")


def step_satisfied(steps: DataFrame, objects: DataFrame, by: list[str]) -> DataFrame:
    """(by, step_kind, satisfied): a step is done when all its objects are; null when one is unknown or there is none."""
    n = F.count("satisfied")
    agg = objects.groupBy(*by).agg(F.count("*").alias("n"), n.alias("known"), F.bool_and("satisfied").alias("all"))
    return steps.join(agg, by, "left").select(*steps.columns, F.when(F.col("n") == F.col("known"), F.col("all")).alias("satisfied"))


def refused_steps(steps: DataFrame) -> DataFrame:
    """Steps outside transactions and backfills that have no condition: refused before any work."""
    return steps.where(F.col("step_kind").isin("ddl_notx", "backfill") & F.col("satisfied").isNull())


def pending_steps(steps: DataFrame, ledger: DataFrame | None, by: list[str], width: int = 1024) -> DataFrame:
    """steps with pending: the first unfinished step of a database and all after it, across migrations.

    Runs within ranges of width migrations.

    A transactional step without a condition of its own is done when the ledger says that it succeeded. No ledger: all
    is pending.
    """
    if ledger is None:
        return steps.withColumn("pending", F.lit(True))
    said = ledger.select(*by, (F.col("status") == "succeeded").alias("__ok"))
    fallback = (F.col("step_kind") == "ddl_tx") & F.coalesce("__ok", F.lit(False))
    done = F.coalesce(F.col("satisfied"), fallback)
    undone = steps.join(said, by, "left").withColumn("undone_", (~done).cast("int"))
    ahead = running(undone, ["db"], F.floor(F.col("migration_no") / width), ["migration_no", "step_no"], before_=("max", F.col("undone_")))
    return ahead.withColumn("pending", F.coalesce(F.greatest("undone_", "before_") == 1, F.lit(False))).drop("__ok", "undone_", "before_")


def checksum_drift(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """(migration_no, step_no, planned, recorded) of steps that succeeded and were edited since."""
    done = ledger.where("status = 'succeeded'").select("migration_no", "step_no", F.col("checksum").alias("recorded"))
    return plan.select("migration_no", "step_no", F.col("checksum").alias("planned")).join(done, ["migration_no", "step_no"]).where("planned <> recorded")


def normalized_checksum(text: Column) -> Column:
    """sha256 of a text without regard to case and white space; nothing of its grammar."""
    return F.sha2(F.regexp_replace(F.lower(F.regexp_replace(text, "^[ \t\r\n]+|[ \t\r\n]+$", "")), "[ \t\r\n]+", " "), 256)


def relation_stats(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """(relation, exists, n_rows, n_bytes) for each relation asked for; absent ones stay, unknown row counts are 0."""
    there = F.col("__there").isNotNull()
    facts = catalog.select("relation", "n_rows", "n_bytes", F.lit(True).alias("__there"))
    size = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c)
    return requested.select("relation").distinct().join(facts, "relation", "left").select("relation", there.alias("exists"), size("n_rows"), size("n_bytes"))


def table_stats(spark: SparkSession, names: list[str], analyze: bool = False) -> DataFrame:
    """(relation, n_rows, n_bytes) of Spark's own tables as its catalog has them, a source for relation_stats; what it does not know is null.

    analyze: count first, so that the figures are there and of now. Names that are no table have no row. Only the
    catalog's entries pass through the driver, one for each name.
    """
    rows = []
    for name in names:
        if not spark.catalog.tableExists(name):
            continue
        quoted = ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))
        if analyze:
            spark.sql(f"ANALYZE TABLE {quoted} COMPUTE STATISTICS")
        said = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {quoted} AS JSON").first()[0]).get("statistics") or {}
        rows.append((name, said.get("num_rows"), said.get("size_in_bytes")))
    return spark.createDataFrame(rows, "relation string, n_rows long, n_bytes long")


def primary_key_columns(keys: DataFrame, attributes: DataFrame) -> DataFrame:
    """(relation, columns, paging_key): key columns in key order; the paging key is the only column, or null.

    keys: relation, conkey (array of attribute numbers); attributes: relation, attnum, name.
    """
    each = keys.select("relation", F.posexplode("conkey").alias("ord", "attnum")).join(attributes, ["relation", "attnum"])
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"])
    return each.groupBy("relation").agg(names.alias("columns")).withColumn("paging_key", F.when(F.size("columns") == 1, F.col("columns")[0]))
