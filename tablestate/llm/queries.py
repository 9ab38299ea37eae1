"""The corpus operators' queries, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom_lm import scored
from .common import table
from .decontaminate import contamination
from .fill_middle import fill_middle, restore
from .filter_audit import filter_audit
from .html_extract import main_texts
from .kneser_ney import classified
from .language_id import identified
from .packing import packed_documents
from .quality_rules import quality_rules
from .shards import balanced_shards
from .simhash import near_duplicates
from .token_index import token_index
from .warc import archived


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slack=2)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archived(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


def op10_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_index(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    arranged = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return restore(arranged.drop("text"), with_text=False).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_kneser_ney_quality, op3_best_fit_packing, op4_quality_rules, op5_simhash_anchors, op6_decontamination, op7_language_id, op8_warc_bundles, op9_bloom_lm, op10_token_index, op11_filter_audit, op12_fill_in_middle, op13_balanced_shards)}


#: Words by op6: A-Z to a-z, then runs of what is no ASCII sign or space.
_OP6_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP6_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP6_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT array_to_string(w[i + 1 : i + 10], ' ') AS words, least(len(w), 10) AS n, list(DISTINCT item) AS items
          FROM (SELECT item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0) x GROUP BY ALL),
runs AS (SELECT r, i, array_to_string(w[i + 1 : i + n], ' ') AS words, n
         FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) l WHERE len(w) >= n) x),
found AS (SELECT runs.r, runs.i, runs.n, win.items FROM runs JOIN win ON win.words = runs.words AND win.n = runs.n),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) x GROUP BY r),
named AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, unnest(items) AS item FROM found) x GROUP BY r),
pos AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
term AS (SELECT words, n, items, unnest(string_split(words, ' ')) AS word, unnest(range(n)) AS j FROM win),
rare AS (SELECT words, arg_min(word, c) AS word, arg_min(j, c) AS j FROM (SELECT term.*, (SELECT count(*) FROM pos WHERE pos.word = term.word) AS c FROM term) x GROUP BY words),
begun AS (SELECT DISTINCT words, r, p - j + s AS s FROM rare JOIN pos USING (word), (SELECT unnest(range(-2, 3)) AS s) k),
close AS (SELECT begun.words, begun.r, begun.s FROM begun JOIN term ON term.words = begun.words
            JOIN pos ON pos.r = begun.r AND pos.word = term.word AND abs(pos.p - begun.s - term.j) <= 2
           GROUP BY ALL HAVING count(DISTINCT term.j) = max(term.n)),
near AS (SELECT r, count(DISTINCT item) AS n_near_items FROM (SELECT r, unnest(items) AS item FROM close JOIN win USING (words)) x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
  FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r) LEFT JOIN near USING (r)"""

#: base32 of a SHA-1: five hexadecimal digits are four letters.
_OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
x AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(hex, CAST(5 * g + 1 AS INTEGER), 5) AS INTEGER) // CAST(power(32, 3 - k) AS INTEGER) % 32 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
  FROM x"""


#: Cells by the five conditions, and every order's steps over them.
_OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(words) < 200 AS a, 100 * list_unique(words) < 50 * len(words) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > first, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
        FROM w LEFT JOIN said USING (doc_id)),
cell AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
                count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT concat(f1.x, f2.x, f3.x, f4.x, f5.x) AS filter_order FROM f f1, f f2, f f3, f f4, f f5 WHERE len(list_distinct([f1.x, f2.x, f3.x, f4.x, f5.x])) = 5),
steps AS (SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS f, substr(filter_order, 1, s.step - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
met AS (SELECT part, filter_order, step, f, fails, n, good, toxic, contains(fails, f) AS fail, regexp_matches(fails, concat('[', earlier, '_]')) AS gone FROM steps, cell),
x AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END) AS toxic_lost
        FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
  FROM x"""

_OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS hex FROM documents),
h AS (SELECT doc_id, t, w, len(w) AS n, list_transform(range(4), lambda i: CAST(concat('0x', substr(hex, CAST(8 * i + 1 AS INTEGER), 8)) AS BIGINT)) AS h FROM d),
c AS (SELECT doc_id, t, w, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 : n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
  FROM x"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": _OP6_SQL, "op8_warc_bundles": _OP8_SQL, "op11_filter_audit": _OP11_SQL, "op12_fill_in_middle": _OP12_SQL}
