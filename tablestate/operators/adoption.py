"""D. Adopting a foreign history: what another tool applied, and what that says about the set at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import ledger_upsert


def latest_per_version(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, version) whose newest verdict is applied; version 0 is bootstrap. A hash aggregate, no sort."""
    by = by or []
    newest = log.where("version <> 0").groupBy(*by, "version").agg(F.max_by("is_applied", "id").alias("is_applied"))
    return newest.where("is_applied").select(*by, "version")


def high_water_mark(marks: DataFrame, databases: DataFrame) -> DataFrame:
    """(db, mark, dirty): versions up to mark are applied. Dirty: the version itself is not; no row: -1."""
    mark = F.when(F.col("version").isNull(), -1).when(F.col("dirty"), F.col("version") - 1).otherwise(F.col("version"))
    return databases.join(marks, "db", "left").select("db", mark.cast("long").alias("mark"), F.coalesce("dirty", F.lit(False)).alias("dirty"))


def adoption_report(files: DataFrame, applied: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, version, state) against an applied set: adopted, recheck, or no file."""
    keys = [*(by or []), "version"]
    both = files.select(*keys, F.lit(True).alias("__f")).join(applied.select(*keys, F.lit(True).alias("__a")), keys, "full_outer")
    state = F.when(F.col("__f").isNull(), "no file").when(F.col("__a").isNull(), "recheck").otherwise("adopted")
    return both.select(*keys, state.alias("state"))


def adoption_by_mark(files: DataFrame, marks: DataFrame) -> DataFrame:
    """(db, version, state) against a high-water mark for each database: adopted or recheck."""
    return files.join(marks.select("db", "mark"), "db").select("db", "version", F.when(F.col("version") <= F.col("mark"), "adopted").otherwise("recheck").alias("state"))


def adopt(ledger: DataFrame, plan: DataFrame, adopted: DataFrame) -> DataFrame:
    """The ledger with every step of the adopted migrations succeeded; doing it again changes nothing."""
    done = adopted.select(F.col("version").alias("migration_no"), F.lit(True).alias("__adopted")).distinct()
    steps = plan.join(done, "migration_no", "left_semi")
    merged = ledger_upsert(ledger, steps).join(done, "migration_no", "left")
    return merged.withColumn("status", F.when(F.col("__adopted"), "succeeded").otherwise(F.col("status"))).drop("__adopted")


def fleet_adoption(report: DataFrame) -> DataFrame:
    """Versions of each state by database."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s.replace(" ", "_"))
    return report.groupBy("db").agg(n("adopted"), n("recheck"), n("no file"))
