"""Groups of equal byte strings: rows meet by a wide digest, then whole byte strings are compared inside equal digests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argosieve.llm import hashindex
from argosieve.llm.common import materialize, text_column, text_slices


def digest_rows(docs: DataFrame, id_col: str, text_col: str, body_of: Callable[[str], bytes], digest_of: Callable[[bytes], bytes], index: hashindex.HashIndex | None = None) -> DataFrame:
    """Rows (id, digest, n_bytes) of texts that aren't null; with an index, (id, digest, body) of those whose digest is in it."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).filter(F.col("t").isNotNull())
    kind = src.schema["id"].dataType

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "t", 8_000_000):
                bodies = [body_of(t) for t in text_column(part, "t")]
                digests = [digest_of(b) for b in bodies]
                if index is None:
                    sizes = pa.array([len(b) for b in bodies], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests, pa.binary()), sizes], ["id", "digest", "n_bytes"])
                    continue
                at = np.flatnonzero(index.probe(_hash_of(digests))[0])
                if at.size:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array([digests[k] for k in at], pa.binary()), pa.array([bodies[k] for k in at], pa.binary())], ["id", "digest", "body"])

    last = T.StructField("n_bytes", T.LongType()) if index is None else T.StructField("body", T.BinaryType())
    return src.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("digest", T.BinaryType()), last]))


def _hash_of(digests: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64)


def digest_index(digests: DataFrame, tag: str) -> hashindex.HashIndex:
    """An index of the digests in column ``digest``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hash_of(b.column(0).to_pylist()).view(np.int64))], ["h"])

    return hashindex.build(digests.select("digest").mapInArrow(run, "h bigint"), {}, tag)


def compare_bodies(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, body_of: Callable[[str], bytes], digest_of: Callable[[bytes], bytes], tag: str) -> tuple[DataFrame, DataFrame | None]:
    """Compares whole bodies inside the digests of ``repeated``.

    Only texts whose digest repeats leave their task, equal ones of a task once. Returns rows (digest, n_bodies), and,
    if some digest holds unequal bodies, rows (id, digest, body_id) of its texts.
    """
    index = digest_index(repeated, tag + "-index")
    bodies = digest_rows(docs, id_col, text_col, body_of, digest_of, index)
    classes = materialize(bodies.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_bodies")), tag + "-classes")
    clash = classes.filter("n_bodies > 1").select("digest")
    if clash.isEmpty():
        return classes, None
    split = bodies.join(clash, "digest", "left_semi")
    return classes, materialize(split.select("id", "digest", F.dense_rank().over(Window.partitionBy("digest").orderBy("body")).alias("body_id")), tag + "-split")


def exact_groups(docs: DataFrame, id_col: str, text_col: str, body_of: Callable[[str], bytes], digest_of: Callable[[bytes], bytes], tag: str) -> DataFrame:
    """Rows (id, digest, n_bytes, keeper, n): the smallest id and the number of the texts whose bodies are the same bytes."""
    fp = materialize(digest_rows(docs, id_col, text_col, body_of, digest_of), tag + "-digests")
    groups = materialize(fp.groupBy("digest").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1"), tag + "-groups")
    _, split = compare_bodies(docs, groups, id_col, text_col, body_of, digest_of, tag)
    if split is None:
        joined = fp.join(groups, "digest", "left")
    else:
        whole = fp.join(split.select("digest").distinct(), "digest", "left_anti").join(groups, "digest", "left")
        w = Window.partitionBy("digest", "body_id")
        apart = split.withColumn("keeper", F.min("id").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
        sizes = fp.select("digest", "id", "n_bytes").distinct()
        joined = whole.unionByName(apart.join(sizes, (apart["digest"] == sizes["digest"]) & apart["id"].eqNullSafe(sizes["id"])).select(apart["digest"], apart["id"], "n_bytes", "keeper", "n"))
    return joined.select("id", "digest", "n_bytes", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keeper")).alias("keeper"), F.coalesce("n", F.lit(1)).cast("bigint").alias("n"))
