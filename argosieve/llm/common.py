"""Helpers shared by the operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, with the scheme of the file system that it lies on.

    A folder without a scheme is on Hadoop's default file system. Where the setting is missing, a local session, as in
    tests, gets a temporary folder; on a cluster that is an error, as its machines would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="argosieve-")
        spark.conf.set("spark.checkpoint.dir", base)
    at = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{fs.makeQualified(at).toString().rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_base(spark)}/{tag}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file that nothing reads any more, such as an earlier round's table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard_all(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder; results that were not saved elsewhere go with it."""
    discard(spark, shared_base(spark))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder as Parquet and reads it back, so lost executors lose nothing."""
    return stored(df, shared_dir(df.sparkSession, tag))


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``, read back."""
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def row_order(df: DataFrame) -> F.Column:
    """A bigint that rises with the order of the rows of ``df``, over all its partitions; numbers are left out in between.

    Files are read in any order, by their sizes. So a table of files that Spark wrote takes the order in which they were
    written: the number of the part (up to 2^23), of the file in it and of the row in the file.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return F.monotonically_increasing_id()
    at = df.metadataColumn("_metadata")
    number = lambda pattern: F.coalesce(F.regexp_extract(at["file_name"], pattern, 1).try_cast("bigint"), F.lit(0))
    return F.shiftleft(number(r"^part-(\d+)"), 40) + F.shiftleft(number(r"[-.]c(\d+)\."), 30) + at["row_index"]


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows of about ``max_bytes`` of text; a longer text is a run of its own.

    After each batch the memory that it took goes back to the system.
    """
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // max_bytes
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))
    release()


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Gives free memory back to the system: Python workers live on from stage to stage, and their allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def text_column(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of SplitMix64) over uint64 arrays."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hash_sample(df: DataFrame, key: F.Column, limit: int) -> DataFrame:
    """The rows of the ``limit`` smallest values of ``key`` (a bigint), more where values are equal at the end.

    The driver sees that many numbers of each partition, never rows.
    """
    cut = df.select(key.alias("h")).orderBy("h").limit(limit).agg(F.max("h").alias("h")).first()["h"]
    return df.filter(F.lit(False)) if cut is None else df.filter(key <= F.lit(cut))
