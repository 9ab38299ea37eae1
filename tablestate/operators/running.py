"""Running figures within a key that may hold most of the rows.

A key's rows are cut into ranges of the ordering; windows run within ranges, and what a range must know of earlier ones
comes from a table with a row for each range. So no task holds a whole key, whatever its share of the rows. Null keys
are a key, as in windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], range_of: Column, order: list, **figures: tuple[str, Column]) -> DataFrame:
    """df with figures over the rows before each row, by key: name=("sum" or "max", column). None before it: null.

    range_of must not fall along the order, and order must tell the rows of a range apart or tie only where it does
    not matter.
    """
    how = {"sum": F.sum, "max": F.max}
    own = [*by, "range_"]
    rows = df.withColumn("range_", range_of).withColumns({f"{name}_v_": c for name, (_, c) in figures.items()})
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*own).agg(*[how[kind](f"{name}_v_").alias(f"{name}_t_") for name, (kind, _) in figures.items()])
    starts = whole.select(*[F.col(c).alias(f"{c}_k_") for c in own], *[how[kind](f"{name}_t_").over(earlier).alias(f"{name}_b_") for name, (kind, _) in figures.items()])
    rows = rows.withColumns({f"{name}_i_": how[kind](f"{name}_v_").over(inside) for name, (kind, _) in figures.items()})
    joined = rows.join(starts, [F.col(c).eqNullSafe(F.col(f"{c}_k_")) for c in own])
    both = {name: (F.coalesce(F.col(f"{name}_i_") + F.col(f"{name}_b_"), f"{name}_i_", f"{name}_b_") if kind == "sum" else F.greatest(f"{name}_i_", f"{name}_b_")) for name, (kind, _) in figures.items()}
    return joined.select(*df.columns, *[c.alias(name) for name, c in both.items()])
