"""Column functions: sizes and durations the way a reader says them, and what a check says of a column. All stay in generated code."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half_up(x: Column) -> Column:
    """The nearest whole number, halves up, as long: floor stays a machine operation where round goes through decimals."""
    return F.floor(x + 0.5).cast("long")


def _scaled(n: Column, steps: tuple[tuple[int, str], ...]) -> Column:
    """n over the largest step that it reaches, with one decimal and the step's unit. n reaches the last step.

    The number is named once, so that generated code stays small.
    """
    (size, unit), *rest = steps
    by, name = F.when(n >= size, size), F.when(n >= size, unit)
    for size, unit in rest[:-1]:
        by, name = by.when(n >= size, size), name.when(n >= size, unit)
    size, unit = rest[-1]
    tenths = _half_up(n / by.otherwise(size) * 10)
    return F.concat((tenths.cast("decimal(19,0)") * F.lit(Decimal("0.1"))).cast("string"), name.otherwise(unit))


def humanize_rows(n: Column) -> Column:
    """1234567 → 1.2M; steps of 1000."""
    return F.when(n >= 1000, _scaled(n, ((10**9, "B"), (10**6, "M"), (10**3, "k")))).otherwise(n.cast("string"))


def humanize_bytes(n: Column) -> Column:
    """365072220160 → 340.0 GB; steps of 1024."""
    return F.when(n >= 1024, _scaled(n, ((1 << 40, " TB"), (1 << 30, " GB"), (1 << 20, " MB"), (1 << 10, " kB")))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def humanize_duration(us: Column) -> Column:
    """Microseconds: 2280000000 → 38m0s; hours rounded to minutes, minutes to seconds, less to tenths."""
    minutes = _half_up(us / 6e7)
    seconds = _half_up(us / 1e6)
    tenths = _half_up(us / 1e5)
    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    s = lambda c: F.floor(c).cast("long").cast("string")
    part = F.when(tenths % 10 == 0, text(s(tenths / 10), "s")).otherwise(text(s(tenths / 10), ".", (tenths % 10).cast("string"), "s"))
    return (
        F.when(us >= 3_600_000_000, text(s(minutes / 60), "h", (minutes % 60).cast("string"), "m0s"))
        .when(us >= 60_000_000, F.when(seconds >= 3600, text(s(seconds / 3600), "h0m0s")).otherwise(text(s(seconds / 60), "m", (seconds % 60).cast("string"), "s")))
        .otherwise(F.when(tenths >= 600, F.lit("1m0s")).otherwise(part))
    )


#: A column, its qualifiers before it, quoted or not, then the test; parentheses around either.
NOT_NULL_TEST = r'''^[\s(]*(?:(?:"(?:[^"]|"")+"|[^\s().",'0-9][^\s().",']*)\s*\.\s*)*(?:"((?:[^"]|"")+)"|([^\s().",'0-9][^\s().",']*))(?:\s*\)[\s)]*|\s+)(?i:is\s+not\s+null)[\s)]*$'''


def not_null_column(condition: Column) -> Column:
    """The column of a condition that is exactly `column IS NOT NULL`, as the server reads the name; null for any other.

    Parentheses that match, qualifiers, quotes and the case of unquoted names don't matter.
    """
    test = F.lit(NOT_NULL_TEST)
    quoted, bare = F.regexp_extract(condition, NOT_NULL_TEST, 1), F.regexp_extract(condition, NOT_NULL_TEST, 2)
    matched = F.regexp_count(condition, F.lit(r"\(")) == F.regexp_count(condition, F.lit(r"\)"))
    return F.when(F.regexp_like(condition, test) & matched, F.when(quoted != "", F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(F.lower(bare)))
