"""What the corpus operators share: tables, the shared folder, marks and hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has been counted and stays below this many bytes.
BROADCAST_BYTES = 64 << 20

#: Arrow batches: (setting, Spark's own value, the operators'). What a worker holds follows the bytes of a batch.
_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"))

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Give Python workers this package and keep Arrow batches small; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(), "tablestate_package.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        spark.sparkContext.addPyFile(archive)
    for key, usual, ours in _BATCHES:  # DataFrames run after we return, so these stay; a session that has set its own keeps it
        if spark.conf.get(key) == usual:
            spark.conf.set(key, ours)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tablestate-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_in = path
    return out


def remove(spark: SparkSession, *what: DataFrame | str) -> None:
    """Delete tables that keep() wrote, or folders of our own, once nothing that is still to run reads them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for x in what:
        path = jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.kept_in)
        path.getFileSystem(conf).delete(path, True)


def crc32_text(c: Column) -> Column:
    """crc32 of an id's decimal text, as unsigned long."""
    return F.crc32(c.cast("string").cast("binary"))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, at row_bytes a row, stays below the broadcast limit. Counts at most one row beyond it."""
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most


def unused(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no column of the frames has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of a long in a broadcast hash relation: the row, its place in the page and in the table.
ID_BYTES = 64


def marked(docs: DataFrame, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    """docs with a boolean column: whether the id is among ids (distinct, not null).

    ids is broadcast when its counted size allows it, else both sides are shuffled by id; rows without an id are set
    apart first, so that they are no key, and a frequent id is a skewed side that adaptive execution may split.
    """
    key, found = unused("id_", docs), unused("found_", docs)
    other = ids.select(F.col(ids.columns[0]).alias(key), F.lit(True).alias(found))
    near = small(other, ID_BYTES)
    some = docs if near else docs.where(F.col(id_col).isNotNull())
    out = some.join(F.broadcast(other) if near else other, F.col(id_col) == F.col(key), "left").withColumn(flag, F.coalesce(found, F.lit(False))).drop(key, found)
    return out if near else out.unionByName(docs.where(F.col(id_col).isNull()).withColumn(flag, F.lit(False)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that at least one label row calls good (quality 1) and none calls bad or toxic."""
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 and t = 0")
        .select("doc_id")
    )


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder in the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """Write a file under a name of its own and move it into place, so that readers never see half a file."""
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)


def read_whole(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()
