"""I. Annotated text corpora: marked-up texts to lines, sections, directives and settings.

A marker line begins with MARK and a word: `@@ step: <name>`, `@@ ignore <rule> reason="..."`, `@@ settings: k=v ...`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK = "@@"
DEFAULT_BATCH = 1000
SETTINGS = ("table", "key", "batch", "max_lag_bytes")


def explode_lines(texts: DataFrame) -> DataFrame:
    """(doc_id, line_no, offset, line): lines, split at \\n only, with number from 1 and byte offset."""
    lines = F.split("text", "\n")
    at = F.posexplode(lines).alias("__at", "line")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    out = texts.select("doc_id", at).select("doc_id", (F.col("__at") + 1).alias("line_no"), "line")
    return out.withColumn("offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)))


def _marker(word: str, mark: str = MARK) -> Column:
    return F.col("line").startswith(f"{mark} {word}")


def section_of(lines: DataFrame, mark: str = MARK) -> DataFrame:
    """lines with section: the last `step:` header above, forward filled; '' before the first."""
    name = F.when(_marker("step:", mark), F.trim(F.expr(f"substr(line, {len(mark) + 8})")))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.when(name.isNotNull(), 1).otherwise(0)).over(w)
    return lines.withColumns({"section_no": number, "section": F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit(""))})


def section_text(sections: DataFrame, mark: str = MARK) -> DataFrame:
    """(doc_id, section_no, section, text, problem): a section's content without markers and leading blank lines; an empty one is a problem."""
    body = ~F.col("line").startswith(mark + " ")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    grouped = sections.where("section_no > 0").groupBy("doc_id", "section_no", "section").agg(text.alias("text"))
    grouped = grouped.withColumn("text", F.regexp_replace("text", "^[\n]+", ""))
    return grouped.withColumn("problem", F.when(F.trim("text") == "", "empty section").otherwise(""))


def directives(sections: DataFrame, known_rules: list[str], mark: str = MARK, own_rule: str = "L000") -> DataFrame:
    """(doc_id, line_no, section, rule_id, reason, problem) of ignore markers; a reason is mandatory, quoted and not blank, and own_rule, which tells of broken markers, cannot be silenced."""
    body = F.trim(F.regexp_replace(F.expr(f"substr(line, {len(mark) + 8})"), "[ \t]+", " "))
    rule = F.split_part(body, F.lit(" "), F.lit(1))
    rest = F.trim(F.expr("substr(__body, length(__rule) + 1)"))
    reason = F.trim(F.regexp_extract("__rest", '^reason="(.*)"$', 1))
    problem = (
        F.when(F.col("__rule") == "", "names no rule")
        .when(~F.col("__rule").isin(*known_rules), "names no known rule")
        .when(F.col("__rule") == own_rule, "names a rule that cannot be silenced")
        .when(~F.col("__rest").startswith("reason="), "gives no reason")
        .when(reason == "", "has no quoted reason")
        .otherwise("")
    )
    found = sections.where(_marker("ignore", mark)).withColumn("__body", body).withColumn("__rule", rule).withColumn("__rest", rest)
    return found.select("doc_id", "line_no", "section", F.col("__rule").alias("rule_id"), F.when(problem == "", reason).otherwise("").alias("reason"), problem.alias("problem"))


def settings(sections: DataFrame, mark: str = MARK) -> DataFrame:
    """(doc_id, section, table_name, key_name, batch, max_lag_bytes, problem) of settings markers."""
    fields = F.filter(F.split(F.trim(F.expr(f"substr(line, {len(mark) + 11})")), "[ \t]+"), lambda x: x != "")
    kv = F.map_from_entries(F.transform(F.filter(fields, lambda x: F.instr(x, "=") > 0), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.split_part(x, F.lit("="), F.lit(2)))))
    found = sections.where(_marker("settings:", mark)).select("doc_id", "section", fields.alias("f"), kv.alias("kv"))
    get = lambda k: F.try_element_at("kv", F.lit(k))
    number = lambda k: F.expr(f"try_cast(try_element_at(kv, '{k}') AS BIGINT)")
    there = lambda k: F.map_contains_key("kv", k)
    problem = (
        F.when(F.exists("f", lambda x: F.instr(x, "=") == 0), "a setting is not name=value")
        .when(F.exists(F.map_keys("kv"), lambda k: ~k.isin(*SETTINGS)), "unknown setting")
        .when(there("batch") & (F.coalesce(number("batch"), F.lit(0)) <= 0), "batch is not a positive number")
        .when(there("max_lag_bytes") & (F.coalesce(number("max_lag_bytes"), F.lit(-1)) < 0), "max_lag_bytes is not a number")
        .when((F.coalesce(get("table"), F.lit("")) == "") | (F.coalesce(get("key"), F.lit("")) == ""), "table and key are needed")
        .otherwise("")
    )
    return found.select("doc_id", "section", F.coalesce(get("table"), F.lit("")).alias("table_name"), F.coalesce(get("key"), F.lit("")).alias("key_name"), F.coalesce(number("batch"), F.lit(DEFAULT_BATCH)).alias("batch"), F.coalesce(number("max_lag_bytes"), F.lit(0)).alias("max_lag_bytes"), problem.alias("problem"))


def unknown_markers(lines: DataFrame, known: tuple[str, ...] = ("step:", "ignore", "settings:"), mark: str = MARK) -> DataFrame:
    """Marker lines that nobody recognises."""
    word = F.split_part(F.expr(f"substr(line, {len(mark) + 2})"), F.lit(" "), F.lit(1))
    return lines.where(F.col("line").startswith(mark + " ")).where(~word.isin(*known)).select("doc_id", "line_no", "line")


def version_and_name(paths: DataFrame) -> DataFrame:
    """(repo, path, version, name, problem) in numeric order; .down files are left out, .up is trimmed."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.sql$", ""), r"\.up$", "")
    out = paths.where(~F.col("path").endswith(".down.sql")).withColumn("__base", base)
    digits = F.regexp_extract("__base", r"^([0-9]+)_(.+)$", 1)
    out = out.withColumns({"version": F.when(digits != "", digits).cast("bigint"), "name": F.regexp_extract("__base", r"^([0-9]+)_(.+)$", 2)})
    return out.withColumn("problem", F.when(F.col("version").isNull(), "not <version>_<name>").otherwise("")).drop("__base")


def duplicates(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n) of keys that occur more than once."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
