"""Balanced shards: exact counts, gapless slots, links kept together, all against plain counting."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablestate.llm import shards as sh
from tablestate.llm.queries import op13_balanced_shards


def checked(docs, out, shards):
    """Laws and digests of every row; the shards of each text."""
    rows = out.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(Counter)
    for r in rows:
        where[r.text_crc32, r["size"]][r.shard] += 1
    return where


def test_odd_rows(spark, odd_docs, no_docs):
    where = checked(odd_docs, sh.balanced_shards(odd_docs, 5), 5)
    assert all(len(s) == 1 for s in where.values())
    assert sh.balanced_shards(no_docs).count() == 0
    few = odd_docs.limit(7)
    few = spark.createDataFrame(few.collect(), few.schema)
    checked(few, sh.balanced_shards(few), 40)


def test_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = checked(docs, op13_balanced_shards(spark, sf_dir), 40)
    most = -(-docs.count() // 40)
    assert all(len(s) == 1 for s in where.values() if sum(s.values()) <= most)


def test_hot_group_and_many_copies(spark):
    """A third of all rows have one text, most others two to nine copies: the first is cut as little as can be, the rest not at all."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'pair ' || (id DIV 6) WHEN id < 4000 THEN 'nine ' || (id DIV 27) ELSE 'alone ' || id END AS text")
    where = checked(docs, sh.balanced_shards(docs, 20), 20)
    assert sorted(len(s) for s in where.values())[-2:] == [1, 7]


@pytest.mark.parametrize("copies", [2, 5])
def test_no_free_room(spark, copies):
    """Every document is linked, so moves must be exchanges; few links are left cut."""
    docs = spark.range(2000).selectExpr("id AS doc_id", f"'text ' || (id DIV {copies}) AS text")
    where = checked(docs, sh.balanced_shards(docs, 4), 4)
    cut = sum(len(s) > 1 for s in where.values())
    assert cut < len(where) / 10


def test_links_of_the_callers_own(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "'text ' || id AS text", "if(id % 4 = 0, NULL, id DIV 10) AS host")
    out = sh.balanced_shards(docs, 8, link=F.col("host"))
    checked(docs, out, 8)
    hosts = out.where("doc_id % 4 <> 0").groupBy(F.expr("doc_id DIV 10")).agg(F.countDistinct("shard").alias("n"))
    assert hosts.where("n > 1").count() == 0


def test_dealt_keeps_within_rooms(spark):
    for rows, rooms in ((10, [0, 3, 7]), (9, [4, 4, 4]), (1, [0, 1]), (1000, [999, 0, 1])):
        got = Counter(r.s for r in spark.range(rows).select(sh.dealt(F.col("id"), rows, rooms).alias("s")).collect())
        assert sum(got.values()) == rows and all(got[s] <= room for s, room in enumerate(rooms))


def test_sizes_are_dealt_evenly(spark):
    """Documents without links are dealt by size: bytes of shards differ by little, though sizes grow with the number."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', CAST(id AS INT)) AS text")
    sizes = [r.b for r in sh.balanced_shards(docs, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) < 1.02 * min(sizes)
