"""Tables that are written once to the folder that all executors share, so that several plans read them."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new name in this application's folder under ``spark.checkpoint.dir``, with the scheme of its file system.

    A folder without a scheme is on Hadoop's default file system. Where the setting is missing, a local session, as in
    tests, gets a temporary folder; on a cluster that is an error, as its machines would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="argosieve-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{qualified(spark, base).rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that it lies on: Hadoop's default one if it names none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, least_bytes: int = 32 << 20) -> DataFrame:
    """The rows of a small table over all cores; a large one as it is.

    A small file may be one row group, which is one task however many cores there are. Tables that Spark estimates at more
    than ``least_bytes`` for each core have splits enough, so nothing that grows is moved. Column order and rows stay.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < least_bytes * cores else df


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lost executors lose nothing of it."""
    return stored(df, shared_dir(df.sparkSession, tag))


def write_each(texts: DataFrame, path: str) -> int:
    """Writes every distinct text of the column ``value`` as a file of its own, named by its hash, into a folder; returns the rows.

    Tasks write by Arrow's file systems, since Hadoop's local one starts processes for every file. A file gets its name once it
    is whole, and a task that runs twice replaces its files by equal ones.
    """
    uri = "file://" + path[5:] if path.startswith("file:") and not path.startswith("file://") else path

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for text in batch.column(0).drop_null().to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                part = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, f"{folder}/{hashlib.md5(data).hexdigest()}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return texts.select("value").mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``, read back."""
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
