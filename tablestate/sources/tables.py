"""Where data comes from and goes to: tables, marked-up texts, live catalogs, and the folder that a cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tables(spark: SparkSession, folder: str, names: list[str], kind: str = "parquet", schemas: dict | None = None) -> dict[str, DataFrame]:
    """Tables of a folder by name; Parquet, JSON or CSV (the last two with schemas, so that nothing is inferred)."""
    out = {}
    for name in names:
        reader = spark.read.format(kind)
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        if kind == "csv":
            reader = reader.option("header", True)
        out[name] = reader.load(f"{folder}/{name}.{kind}")
    return out


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc_id, text) of whole text files: doc_id is the path."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def nested(df: DataFrame, **types: str) -> DataFrame:
    """df with columns of JSON text read as arrays and structs of the given types, as logs keep them that have no nested columns.

    Text that is no JSON of the type is refused, since a change whose details are lost would pass for one without.
    """
    read = {name: F.from_json(F.col(name), kind, {"mode": "FAILFAST"}) for name, kind in types.items() if name in df.columns}
    return df.withColumns(read)


def read_catalog(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query on a live server's catalog over JDBC."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_report(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Write rows as Parquet or JSON, overwriting only the partitions at hand where by is given."""
    writer = df.write.mode("overwrite").format(kind)
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; one of our own where it is unset (tests), which a cluster refuses."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tablestate-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
