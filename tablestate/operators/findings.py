"""H. Findings: policy by directory, suppression, audit, precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = {"off": 0, "info": 1, "warn": 2, "error": 3}


#: The rule that speaks of broken directives and settings: it can be neither graded nor silenced.
OWN_RULE = "L000"
LIMITS = ("big_rows", "big_bytes", "small_rows", "small_bytes")
_RULES_TYPE = "map<string,string>"
DOCUMENT_TYPE = f"struct<target_version:int,thresholds:struct<{','.join(f'{x}:bigint' for x in LIMITS)}>,rules:{_RULES_TYPE},overrides:array<struct<path:string,rules:{_RULES_TYPE}>>>"


def clean_path(c: Column) -> Column:
    """A path without empty and dot parts, and without what a following '..' takes back; '' stays '', and '.' is all that is left of a path of dots."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(up(acc, p), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    joined = F.concat(F.when(c.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    return F.when((joined == "") & (c != ""), ".").otherwise(joined)


def resolve_policy(scopes: DataFrame, directories: DataFrame) -> DataFrame:
    """(directory, rule_id, severity): the last scope that matches wins. Scope 0, with no path, matches everything.

    A directory's ancestors are exploded and joined by equality, so prefixes cost no theta join.
    """
    parts = F.split(clean_path(F.col("directory")), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = directories.select("directory", F.explode(ancestors).alias("__path"))
    joined = each.join(scopes.withColumn("__path", clean_path(F.col("path"))), "__path")
    return joined.groupBy("directory", "rule_id").agg(F.max_by("severity", "scope_no").alias("severity"))


def read_policies(documents: DataFrame, text_col: str = "document") -> DataFrame:
    """documents with policy, the nested settings of a JSON text: thresholds, a map of rules, an array of scopes with maps.

    A blank text is a policy that says nothing; one that is no such document has a null policy.
    """
    text = F.when(F.trim(F.coalesce(text_col, F.lit(""))) == "", "{}").otherwise(F.col(text_col))
    return documents.withColumn("policy", F.from_json(text, DOCUMENT_TYPE))


def policy_scopes(policies: DataFrame, by: str = "repo") -> DataFrame:
    """(by, scope_no, path, rule_id, severity) of nested policies: scope 0 is the document's own rules, then its overrides in order."""
    own = F.struct(F.lit("").alias("path"), F.col("policy.rules").alias("rules"))
    scopes = policies.select(by, F.posexplode(F.concat(F.array(own), F.coalesce("policy.overrides", F.array().cast(f"array<struct<path:string,rules:{_RULES_TYPE}>>")))).alias("scope_no", "s"))
    levels = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    return scopes.select(by, "scope_no", F.col("s.path").alias("path"), F.explode("s.rules").alias("rule_id", "level")).select(by, "scope_no", "path", "rule_id", levels[F.col("level")].cast("long").alias("severity"))


def resolve_documents(policies: DataFrame, directories: DataFrame, by: str = "repo") -> DataFrame:
    """(by, directory, rule_id, severity) from many repositories' documents: the last scope that holds the directory wins.

    As resolve_policy, with the repository in the key. Documents with problems should be left out first.
    """
    parts = F.split(clean_path(F.col("directory")), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = directories.select(by, "directory", F.explode(F.array_distinct(ancestors)).alias("path"))
    scopes = policy_scopes(policies, by).withColumn("path", clean_path(F.col("path")))
    return each.join(scopes, [by, "path"]).groupBy(by, "directory", "rule_id").agg(F.max_by("severity", "scope_no").alias("severity"))


def validate_documents(documents: DataFrame, known_rules: list[str], by: str = "repo", text_col: str = "document") -> DataFrame:
    """(by, scope_no, item, value, problem) of documents that no build would take; a document with any is refused whole.

    scope_no is null for what belongs to no scope. Unknown fields count as problems at every level: a misspelled
    setting would seem to be in force.
    """
    read = read_policies(documents, text_col).withColumn("raw_", F.col(text_col))
    row = lambda df, item, value, problem, scope=F.lit(None).cast("int"): df.select(by, scope.alias("scope_no"), F.lit(item).alias("item"), value.alias("value"), problem.alias("problem")).where("problem IS NOT NULL")
    keys = lambda text: F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    part = lambda name: F.get_json_object("raw_", f"$.{name}")
    unknown = lambda df, known: df.where(~F.col("k").isin(*known))
    fields = unknown(read.select(by, F.explode(keys(F.col("raw_"))).alias("k")), ("target_version", "thresholds", "rules", "overrides"))
    sizes = unknown(read.select(by, F.explode(keys(part("thresholds"))).alias("k")), LIMITS)
    each = read.select(by, F.posexplode(F.from_json(part("overrides"), "array<map<string,string>>")).alias("at", "m"))
    inner = unknown(each.select(by, "at", F.explode(F.map_keys("m")).alias("k")), ("path", "rules"))
    scopes = read.select(by, F.posexplode(F.concat(F.array(F.struct(F.lit("own").alias("path"), F.col("policy.rules").alias("rules"))), F.coalesce("policy.overrides", F.array().cast(f"array<struct<path:string,rules:{_RULES_TYPE}>>")))).alias("scope_no", "s"))
    graded = scopes.select(by, "scope_no", F.explode("s.rules").alias("rule", "level"))
    limits = read.select(by, F.explode(F.array(*[F.struct(F.lit(x).alias("k"), F.col(f"policy.thresholds.{x}").alias("v")) for x in LIMITS])).alias("l"))
    no, own = F.col("scope_no"), F.lit(OWN_RULE)
    found = [
        row(read.where("policy IS NULL OR NOT (trim(coalesce(raw_, '')) = '' OR raw_ LIKE '%{%')"), "document", F.substring("raw_", 1, 40), F.lit("not a policy document")),
        *[row(df, "field", F.col("k"), F.lit("unknown field")) for df in (fields, sizes)],
        row(inner, "field", F.col("k"), F.lit("unknown field"), (F.col("at") + 1).cast("int")),
        row(scopes.where("scope_no > 0"), "path", F.coalesce("s.path", F.lit("")), F.when(F.coalesce("s.path", F.lit("")) == "", "missing path"), no),
        row(graded, "rule", F.col("rule"), F.when(F.col("rule") == own, "cannot be graded").when(~F.col("rule").isin(*known_rules), "unknown rule"), no),
        row(graded, "level", F.coalesce("level", F.lit("")), F.when(~F.coalesce("level", F.lit("")).isin(*SEVERITIES), "unknown level"), no),
        row(limits, "threshold", F.concat_ws("=", "l.k", F.col("l.v").cast("string")), F.when(F.col("l.v") < 0, "a threshold cannot be negative")),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def validate_policy(policies: DataFrame, known_rules: list[str]) -> DataFrame:
    """(repo, item, value, problem) of policy settings that no build would take. policies: repo, item, value."""
    item, value = F.col("item"), F.col("value")
    number = F.expr("try_cast(value AS BIGINT)")
    problem = (
        F.when((item == "rule") & ~value.isin(*known_rules), "unknown rule")
        .when((item == "rule") & (value == OWN_RULE), "cannot be graded")
        .when((item == "level") & ~value.isin(*SEVERITIES), "unknown level")
        .when((item == "path") & (value == ""), "missing path")
        .when((item == "threshold") & (F.coalesce(number, F.lit(-1)) < 0), "not a threshold")
        .when(~item.isin("rule", "level", "path", "threshold"), "unknown field")
    )
    return policies.withColumn("problem", problem).where("problem is not null")


def apply_policy(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """findings re-graded by (directory = file, rule); rules that are off drop theirs."""
    level = policy.select(F.col("directory").alias("file"), "rule_id", F.col("severity").alias("__s"))
    graded = findings.join(level, ["file", "rule_id"], "left").withColumn("severity", F.coalesce("__s", "severity").cast("long")).drop("__s")
    return graded.where("severity > 0")


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """findings that no sound directive of their file, rule and step silences; a directive without step covers the file."""
    sound = directives.where("problem = ''")
    whole = sound.where("step = ''").select("file", "rule_id").distinct()
    own = sound.where("step <> ''").select("file", "rule_id", "step").distinct()
    return findings.join(whole, ["file", "rule_id"], "left_anti").join(own, ["file", "rule_id", "step"], "left_anti")


def mark_used(directives: DataFrame, findings: DataFrame) -> DataFrame:
    """directives with used: it matches some finding; all that match are used, broken ones never."""
    by_file = findings.select("file", "rule_id").distinct().withColumn("__f", F.lit(True))
    by_step = findings.select("file", "rule_id", "step").distinct().withColumn("__s", F.lit(True))
    joined = directives.join(by_file, ["file", "rule_id"], "left").join(by_step, ["file", "rule_id", "step"], "left")
    hit = F.when(F.col("step") == "", F.col("__f")).otherwise(F.col("__s"))
    return joined.withColumn("used", F.coalesce(hit, F.lit(False)) & (F.col("problem") == "")).drop("__f", "__s")


def broken_directives(findings: DataFrame, directives: DataFrame, own_rule: str = "L000") -> DataFrame:
    """findings with an error for each broken directive, which nothing can silence."""
    broken = directives.where("problem <> ''").select("file", "step", F.lit(own_rule).alias("rule_id"), F.lit(3).cast("long").alias("severity"), F.col("line").alias("span_start"))
    return findings.select("file", "step", "rule_id", F.col("severity").cast("long").alias("severity"), "span_start").unionByName(broken)


def suppression_audit(directives: DataFrame, now: str) -> DataFrame:
    """(file, line, rule_id, age_days, state, text): age in whole days of a version that is a timestamp, else null."""
    digits = F.col("version").rlike("^[0-9]{14}$")
    written = F.when(digits, F.try_to_timestamp("version", F.lit("yyyyMMddHHmmss")))
    days = F.floor(F.timestamp_diff("SECOND", written, F.to_timestamp(F.lit(now))) / 86400)
    state = F.when(F.col("problem") != "", "broken").when(F.col("used"), "used").otherwise("unused")
    return directives.select("file", "line", "rule_id", F.when(written.isNotNull(), F.greatest(days, F.lit(0))).cast("long").alias("age_days"), state.alias("state"), F.when(F.col("problem") != "", F.col("problem")).otherwise(F.col("reason")).alias("text"))


def finding_counts(findings: DataFrame, by: str) -> DataFrame:
    """(by, total, errors, warnings, fixable, failed); info counts in the total alone."""
    errors = F.count_if(F.col("severity") == 3)
    return findings.groupBy(by).agg(F.count("*").alias("total"), errors.alias("errors"), F.count_if(F.col("severity") == 2).alias("warnings"), F.count_if("fixable").alias("fixable"), (errors > 0).alias("failed"))


def precision_tally(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(corpus, findings, tp, fp, fp_rate) for each corpus and, as 'all', over all; arguable findings are neither."""
    judged = findings.join(verdicts.select("finding_id", "verdict"), "finding_id", "left")
    fp = F.count_if(F.col("verdict") == "FP")
    out = judged.rollup("corpus").agg(F.grouping("corpus").alias("__all"), F.count("*").alias("findings"), F.count_if(F.col("verdict") == "TP").alias("tp"), fp.alias("fp"), (fp / F.count("*")).alias("fp_rate"))
    return out.withColumn("corpus", F.when(F.col("__all") == 1, "all").otherwise(F.col("corpus"))).drop("__all")


def fp_by_cause(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    return findings.join(verdicts.where("verdict = 'FP'"), "finding_id").groupBy("cause").agg(F.count("*").alias("fp"))


def fp_by_rule(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(rule_id, findings, fp, rate_without): the false positive rate of everything but the rule. Totals are a second, short aggregate."""
    judged = findings.join(verdicts.select("finding_id", "verdict"), "finding_id", "left")
    each = judged.groupBy("rule_id").agg(F.count("*").alias("findings"), F.count_if(F.col("verdict") == "FP").alias("fp"))
    total = judged.agg(F.count("*").alias("__n"), F.count_if(F.col("verdict") == "FP").alias("__fp"))
    left = F.col("__n") - F.col("findings")
    return each.join(F.broadcast(total)).select("rule_id", "findings", "fp", F.when(left > 0, (F.col("__fp") - F.col("fp")) / left).alias("rate_without"))


def rerun_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(finding_id, change): killed, new, regraded or survived."""
    b, a = before.select("finding_id", F.col("severity").alias("__b")), after.select("finding_id", F.col("severity").alias("__a"))
    change = F.when(F.col("__a").isNull(), "killed").when(F.col("__b").isNull(), "new").when(F.col("__a") != F.col("__b"), "regraded").otherwise("survived")
    return b.join(a, "finding_id", "full_outer").select("finding_id", change.alias("change"))
