"""Exact deduplication as a stream over a folder of Parquet files."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argosieve.llm.common import materialize, shared_dir
from argosieve.llm.exactgroups import compare_bodies

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_AT = "struct<came:timestamp,no_id:boolean,id:{},file:string,row:bigint>"


def _body(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _digest(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


def digest_of(text: F.Column) -> F.Column:
    """As ``_digest``, of a column of text."""
    return F.unhex(F.sha2(text, 256))


def _files(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and locator (when the file came, its path and the row's place in it); a column of that name doesn't matter."""
    m = df.metadataColumn("_metadata")
    return df.select(df[id_col].alias("id"), df[text_col].alias("text"), m["file_modification_time"].alias("came"), m["file_path"].alias("file"), m["row_index"].alias("row"))


def _located(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, digest and locator."""
    return _files(df, id_col, text_col).select("id", digest_of(F.col("text")).alias("digest"), "came", "file", "row")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stream_states(spark: SparkSession, path: str, id_col: str, text_col: str, bytes_per_batch: int, folder: str) -> DataFrame:
    """Runs the stream until it has read all files that are there; returns (digest, first, n).

    State is keyed by digest, lies in RocksDB on disk and never expires. It retains the stable identifier and locator of the
    first copy (that of the oldest file, then the smallest id, path and row) and the number of copies. ``folder`` has its
    checkpoint, and for every micro-batch the keys that it touched, under the batch's number. A run over the same folder
    goes on where the last one ended or was cut short: it reads the files that are new, against the state that was kept.
    The copy that came in the earliest batch stays the first, whatever the age of files that come later.
    """
    schema, out, before = spark.read.parquet(path).schema, f"{folder}/states", spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        source = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
            stream = source.option("pathGlobFilter", at.getName()).parquet(str(at.getParent().toString()))
        else:
            stream = source.parquet(path)
        first = F.min(F.struct("came", F.col("id").isNull().alias("no_id"), "id", "file", "row")).alias("first")
        states = _located(stream, id_col, text_col).filter(F.col("digest").isNotNull()).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))

        def save(touched: DataFrame, number: int) -> None:
            touched.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number={number}")

        run = states.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
        run.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    kind = f"digest binary, first {_AT.format(schema[id_col].dataType.simpleString())}, n bigint, batch int"
    if not _exists(spark, out):
        return spark.createDataFrame([], kind).drop("batch")
    saved = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(out)
    return saved.groupBy("digest").agg(F.min_by("first", "batch").alias("first"), F.max("n").alias("n"))


def stream_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", bytes_per_batch: int = 64 << 30, folder: str | None = None) -> DataFrame:
    """Rows (doc_id, keeper_id, is_duplicate) for every row of the files that were under ``path`` at this run or an earlier one.

    ``folder`` holds the stream's state and the rows that were judged; a run over the same folder reads and judges new files
    only, against all that came before, and rows once judged keep their result. Without one, a new folder is taken and no
    later run knows of this one. A run that is cut short leaves nothing half done: the next one goes on from its state.

    A digest that the state knows is a hit. The whole bytes of new hits and of the copies that their locators point to are
    compared; a text whose bytes differ from its digest's other texts is judged among its equals only. ``keeper_id`` is the id
    of the first copy; the rows that aren't it are duplicates, rows with the same id included, so ties are settled by path
    and place. A null text is never a duplicate and keeps its own id. Empty texts are equal to each other, texts of any
    length are read whole, an empty table gives no rows. Other columns are left out, whatever their names.
    """
    folder = folder or shared_dir(spark, "exactdedup")
    judged = f"{folder}/judged"
    docs = spark.read.parquet(path)
    known, done = set(), None
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, keeper {docs.schema[id_col].dataType.simpleString()}, dup boolean, file string"
    if _exists(spark, judged):
        done = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(judged)
        known = {r["file"] for r in spark.read.schema("file string").option("recursiveFileLookup", "true").parquet(f"{folder}/files").distinct().toLocalIterator()}
    listed = {re.sub(r"^([\w+.\-]+):///", r"\1:/", f) for f in docs.inputFiles()}
    new_files = sorted(listed - known)
    if new_files or done is None:
        states = materialize(stream_states(spark, path, id_col, text_col, bytes_per_batch, folder), "exactdedup-state")
        new = docs if not known else docs.filter(docs.metadataColumn("_metadata")["file_path"].isin(new_files))
        fresh = _judge(spark, docs, new, states, bool(known), id_col, text_col).select("id", "keeper", "dup", "file")
        run = f"run-{len(known):012d}"
        fresh.write.mode("overwrite").parquet(f"{judged}/{run}")
        spark.createDataFrame([(f,) for f in new_files], "file string").write.mode("overwrite").parquet(f"{folder}/files/{run}")
        done = spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(judged)
    return done.select(F.col("id").alias(id_col), F.col("keeper").alias("keeper_id"), F.col("dup").alias("is_duplicate"))


def _judge(spark: SparkSession, docs: DataFrame, new: DataFrame, states: DataFrame, later: bool, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, keeper, dup, file) of new rows against the states, with the bytes of hits compared."""
    rows = _located(new, id_col, text_col).join(states, "digest", "left")
    same = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    out = rows.select(
        F.col("id"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keeper"), F.coalesce(~same, F.lit(False)).alias("dup"), "digest", "came", "file", "row"
    )
    hits = states.filter("n > 1")
    asked = _files(new, id_col, text_col)
    if later:
        # the first copies that new hits point to, read from the files that their locators name
        place = _located(new, id_col, text_col).select("digest").distinct().join(hits, "digest").select(F.col("first.file").alias("f"), F.col("first.row").alias("r"))
        place = materialize(place.distinct(), "exactdedup-places")
        named = [r["f"] for r in place.select("f").distinct().toLocalIterator()]
        firsts = _files(docs.filter(docs.metadataColumn("_metadata")["file_path"].isin(named)), id_col, text_col)
        asked = asked.unionByName(firsts.join(place, (firsts["file"] == place["f"]) & (firsts["row"] == place["r"]), "left_semi"))
    _, split = compare_bodies(asked.select("id", "text"), hits.select("digest"), "id", "text", _body, _digest, "exactdedup")
    if split is not None:
        # texts of one digest with unequal bytes: all rows of such digests are told apart by their bodies
        clash = split.select("digest").distinct()
        whole = _files(docs, id_col, text_col).withColumn("digest", digest_of(F.col("text"))).join(clash, "digest", "left_semi")
        w = Window.partitionBy("digest", "text").orderBy("came", F.col("id").isNull(), "id", "file", "row")
        part = whole.withColumn("keeper", F.first("id").over(w)).withColumn("dup", F.row_number().over(w) > 1).select("id", "keeper", "dup", "digest", "came", "file", "row")
        mine = out.join(clash, "digest", "left_semi").select(F.col("file").alias("f"), F.col("row").alias("r"))
        part = part.join(mine, (part["file"] == mine["f"]) & (part["row"] == mine["r"]), "left_semi")
        out = out.join(clash, "digest", "left_anti").unionByName(part)
    return out


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup(spark, f"{sf_dir}/documents.parquet")


OP7_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keeper_id,
       text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate
FROM documents
"""
