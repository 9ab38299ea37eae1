"""Where the queries are registered: a Spark callable and, as a rule, SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.hazards import COLUMNS_TYPE, LITERALS_TYPE, MODS_TYPE
from ..sources.tables import nested
from .views import view, with_views

#: Nested columns that the views hold as JSON text, which both engines can write.
NESTED = {"v_ddl_actions": {"mods": MODS_TYPE, "columns": COLUMNS_TYPE, "literals": LITERALS_TYPE}}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Views:
    """The derived views over one folder of tables, by name without the v_."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return nested(view(self.spark, self.sf_dir, f"v_{name}"), **NESTED.get(f"v_{name}", {}))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Views under its own name. sql may use the derived views."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return register
