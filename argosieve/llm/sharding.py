"""Shuffling a table into shards: scatter into memory-sized buckets, then shuffle each bucket and write it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosieve.llm.common import discard, read_table, shared_dir

SEED = 20240229
SHARD_BYTES = 32_000_000
#: Buckets of one shuffle; beyond that many, records are scattered over groups of buckets first.
MAX_BUCKETS = 8192


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """The order of n records of a bucket: numpy's in-place Fisher-Yates shuffle under a generator seeded by both numbers."""
    order = np.arange(n)
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def _bytes(docs: DataFrame) -> F.Column:
    """What a row weighs: the bytes of its strings and 16 for each other column."""
    parts = [F.coalesce(F.octet_length(docs[f.name]), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(16) for f in docs.schema]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total.cast("bigint")


def shard(docs: DataFrame, path: str, seed: int = SEED, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Writes the table as shards ``shard=K`` under ``path`` and returns them, read back: all columns, and shard, position.

    First pass: a record goes to a bucket by a seeded hash of its id and text; there are as many buckets as it takes for
    ``shard_bytes`` each (the whole rows are measured). Records that are equal in id and text get one bucket, unless
    together they weigh more than a hundredth of it: the number of the row, as the table gives it, then scatters them too,
    so equal records fill no bucket. Second pass: a bucket, put in the order of its records' hashes, is shuffled in one
    task's memory and written by it. Both depend on records and seed alone, so a task that runs again writes the same; equal
    records that are scattered by row number are alike, wherever they land. Above ``max_buckets`` buckets, the first pass
    has two levels: groups of buckets are written first, then each is scattered over its own, so that no shuffle has more
    than that many targets.

    Null ids and texts hash as such; empty and very long texts are records like others, and a record heavier than
    ``shard_bytes`` is in a bucket of its usual neighbours. Columns of the table named shard or position are replaced, others
    are kept whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "position")
    names, schema = docs.columns, docs.schema
    key = F.xxhash64(F.lit(seed), docs[id_col], docs[text_col])
    weighed = docs.select(key.alias("h"), _bytes(docs).alias("w")).groupBy("h").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    total = weighed.agg(F.sum("w").alias("w"), F.max(F.when(F.col("n") > 1, F.col("w"))).alias("most")).first()
    n = max(1, -(-(total["w"] or 0) // shard_bytes))
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], key.alias("h"))
    if (total["most"] or 0) > shard_bytes // 100:
        heavy = weighed.filter((F.col("n") > 1) & (F.col("w") > shard_bytes // 100)).select(F.col("h").alias("heavy"))
        numbered = src.withColumn("r", F.monotonically_increasing_id()).join(heavy, F.col("h") == F.col("heavy"), "left")
        src = numbered.withColumn("h", F.when(F.col("heavy").isNotNull(), F.xxhash64("h", "r")).otherwise(F.col("h"))).drop("heavy", "r")
    src = src.withColumn("b", F.pmod("h", F.lit(n)))
    kinds = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)]

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        del parts
        b, h = t.column("b").to_numpy(), t.column("h").to_numpy()
        ids = t.column(names.index(id_col)).to_pandas().to_numpy()
        tie = np.argsort(np.array([str(x) for x in ids]), kind="stable")
        order = tie[np.lexsort((h[tie], b[tie]))]
        for which in np.unique(b):
            own = order[b[order] == which]
            own = own[fisher_yates(len(own), seed, int(which))]
            at = 0
            while at < len(own):
                some = t.take(pa.array(own[at : at + 2000])).drop_columns(["h", "b"])
                some = some.append_column("b", pa.array(np.full(some.num_rows, which, np.int64))).append_column("p", pa.array(np.arange(at, at + some.num_rows), pa.int64()))
                yield from some.to_batches()
                at += 2000

    def write(rows: DataFrame, first: int, count: int, mode: str = "error") -> None:
        spread = rows.repartitionById(count, (F.col("b") - first).cast("int"))
        out = spread.mapInArrow(run, T.StructType([*kinds, T.StructField("b", T.LongType()), T.StructField("p", T.LongType())]))
        named = out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("b").cast("int").alias("shard"), F.col("p").alias("position"))
        named.write.mode(mode).partitionBy("shard").parquet(path)

    if n <= max_buckets:
        write(src, 0, n)
    else:
        groups, rough = -(-n // max_buckets), shared_dir(spark, "shard-groups")
        coarse = src.withColumn("g", F.floor(F.col("b") / max_buckets).cast("int"))
        coarse.repartition(F.col("g"), F.pmod("h", F.lit(1009))).write.partitionBy("g").parquet(rough)
        for g in range(groups):
            one = spark.read.schema(coarse.schema).parquet(rough).filter(F.col("g") == g).drop("g")
            write(one, g * max_buckets, min(max_buckets, n - g * max_buckets), "append" if g else "error")
        discard(spark, rough)
    back = T.StructType([*schema.fields, T.StructField("position", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(back).parquet(path).select(*names, "shard", "position")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"), shared_dir(spark, "shards"))
