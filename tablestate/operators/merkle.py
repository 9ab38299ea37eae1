"""B. Exact table comparison by a tree of digests: equal tables are told by one digest, unequal ones by few of their rows.

A row's line (its columns in order, nulls marked apart) has a sha256. Rows go to buckets by a hash of their keys; a
bucket's digest is the sha256 of its sorted line digests, each with its count, so repeated rows are counted before
they meet. A node's digest is that of its children's, up to one root. Two trees are compared from the root down, and
only rows of the buckets whose digests differ are read.

Keys should tell rows apart: a bucket holds all rows of its keys, one line for each distinct row. Nulls in keys and
columns are values. An empty table has a root without children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .state import row_diff, row_line

#: Children of a node.
FAN = 16
#: Folders of a digested table, at most; each holds a range of buckets in as many files as its rows need.
PARTS = 64
#: Buckets that a filter names one by one; beyond that rows and buckets are joined.
NAMED = 4096


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a row's keys: 32 bits of their line's md5."""
    return F.pmod(F.conv(F.substring(F.md5(row_line(keys)), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("long")


def depth(buckets: int, fan: int = FAN) -> int:
    """Levels above the leaves."""
    n = 0
    while buckets > 1:
        buckets, n = -(-buckets // fan), n + 1
    return n


def leaves(df: DataFrame, keys: list[str], columns: list[str], buckets: int) -> DataFrame:
    """(bucket, n_rows, digest) of the buckets that hold rows."""
    lines = df.select(bucket_of(keys, buckets).alias("bucket"), F.sha2(row_line([*keys, *columns]), 256).alias("line"))
    counted = lines.groupBy("bucket", "line").agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "line", F.col("n").cast("string")))), ",")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n_rows"), F.sha2(text, 256).alias("digest"))


def tree(of: DataFrame, buckets: int, fan: int = FAN) -> DataFrame:
    """(level, node, n_rows, digest) of leaves (level 0) and all levels above them; a node without rows is left out, but for the root."""
    level = of.select(F.lit(0).alias("level"), F.col("bucket").alias("node"), "n_rows", "digest")
    out = level
    for n in range(1, depth(buckets, fan) + 1):
        child = F.concat_ws("=", F.lpad(F.col("node").cast("string"), 20, "0"), "digest")
        text = F.array_join(F.array_sort(F.collect_list(child)), ",")  # at most fan of them
        level = level.groupBy(F.floor(F.col("node") / fan).cast("long").alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.sha2(text, 256).alias("digest")).select(F.lit(n).alias("level"), "node", "n_rows", "digest")
        out = out.unionByName(level)
    return out


def save_digested(df: DataFrame, path: str, keys: list[str], columns: list[str], buckets: int, fan: int = FAN) -> None:
    """Write rows by bucket under path/rows, and their tree under path/tree.

    Folders hold ranges of buckets and files are in bucket order, so a reader of some buckets opens their folders and
    reads the row groups that hold them.
    """
    parts, spark = min(buckets, PARTS), df.sparkSession
    plain = df.select(*keys, *columns)
    plain.limit(0).write.parquet(f"{path}/schema")
    rows = plain.withColumn("bucket", bucket_of(keys, buckets)).withColumn("part", F.floor(F.col("bucket") * parts / buckets).cast("int"))
    rows.repartitionByRange("part", "bucket").sortWithinPartitions("part", "bucket").write.partitionBy("part").parquet(f"{path}/rows")
    leaves(_rows(spark, path, plain.schema), keys, columns, buckets).write.parquet(f"{path}/leaves")
    tree(spark.read.parquet(f"{path}/leaves"), buckets, fan).write.parquet(f"{path}/tree")


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("bucket", LongType()), StructField("part", IntegerType())])).parquet(f"{path}/rows")


def unequal_buckets(want: DataFrame, got: DataFrame, buckets: int, fan: int = FAN) -> DataFrame:
    """(bucket) of leaves that differ, from two trees: each level looks only below the nodes that differ above it."""
    sides = lambda n: (x.where(F.col("level") == n).select("node", F.col("digest").alias(name)) for x, name in ((want, "w"), (got, "g")))
    found = None
    for n in range(depth(buckets, fan), -1, -1):
        w, g = sides(n)
        if found is not None:
            w, g = (x.join(found, F.floor(F.col("node") / fan) == F.col("above"), "left_semi") for x in (w, g))
        found = w.join(g, "node", "full_outer").where("NOT w <=> g").select(F.col("node").alias("above"))
    return found.select(F.col("above").alias("bucket"))


def merkle_diff(spark: SparkSession, want: str, got: str, keys: list[str], columns: list[str], buckets: int, fan: int = FAN) -> DataFrame:
    """row_diff of two digested tables, from the rows of unequal buckets alone. Equal tables: no row is read."""
    trees = [spark.read.schema("level int, node long, n_rows long, digest string").parquet(f"{p}/tree") for p in (want, got)]
    differ = unequal_buckets(*trees, buckets, fan)
    named = [r.bucket for r in differ.limit(NAMED + 1).collect()]  # at most NAMED + 1 numbers
    parts = min(buckets, PARTS)

    def rows(path: str) -> DataFrame:
        stored = _rows(spark, path, spark.read.parquet(f"{path}/schema").select(*keys, *columns).schema)
        if len(named) > NAMED:
            return stored.join(differ, "bucket", "left_semi").drop("bucket", "part")
        return stored.where(F.col("part").isin(sorted({b * parts // buckets for b in named})) & F.col("bucket").isin(named)).drop("bucket", "part")

    return row_diff(rows(want), rows(got), keys, columns)
