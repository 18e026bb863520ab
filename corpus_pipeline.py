"""The corpus pipeline: documents in, token ids out, by five stages in turn.

An empty table gives an empty one at each stage. Further columns of documents are kept by all stages but the last, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosieve.llm import bpe, linededup, mixing, simhash, toxicity
from argosieve.llm.common import materialize, read_table, row_order


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, with all their columns. Null, empty and blank texts stay; texts of any length are read
    whole; rows with the same id, repeated ones too, are judged each by its text, so there are no ties."""
    kept = toxicity.detect(docs, read_table(spark, sf_dir, "labels")).filter(~F.col("is_toxic"))
    return kept.select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that earlier ones hold, short ones too; those that lost all they had go.

    Texts that were null, empty or blank before stay as they are; texts of any length are read whole. Rows that tie by id,
    repeated ones too, keep the same lines. ``n_chars`` is counted anew where lines went, and kept, null or not, elsewhere.
    """
    new = linededup.dedup_lines(docs, min_chars=1).filter((F.col("n_dropped") == 0) | (F.trim("text") != ""))
    lost = F.col("n_dropped") > 0
    return new.select(*[F.when(lost, F.length("text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    A document that lost lines is also compared by its text in the table of documents, since what is left of a copy isn't
    near what it copies. Those without words (null, empty and blank texts among them) or without an id stay, and so do all
    rows of an id that stays. Texts of any length are read whole.
    """
    copies = simhash.near_dedup(docs, before=read_table(spark, sf_dir, "documents")).filter("is_duplicate").select(F.col("doc_id").alias("copy")).distinct()
    return docs.join(copies, docs["doc_id"] == copies["copy"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in training order, whatever their sources' sizes, which are counted in the last stage's token ids.

    Null texts aren't taken, empty ones count as one token, very long ones by all their tokens; a null source is a source of
    its own. Rows that repeat are taken each; ties by id are settled by size and then by a hash of the row.
    """
    size = "n_ids"
    while size in docs.columns:
        size += "_"
    counted = bpe.with_counts(docs, size).withColumn(size, F.greatest(F.lit(1), F.col(size)) + F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.lit(0)))
    return mixing.mix(materialize(counted, "pipeline-counted"), size_col=size, whole=True).select(*docs.columns)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, whole texts of any length; null ones for null texts, none for empty ones; a row each, repeated ones too.

    ``position`` rises in training order, the order in which the mixing stage wrote the documents, whatever the order in
    which its files are read; no two rows have the same one, so there are no ties.
    """
    return bpe.encode(docs.select("doc_id", "text", row_order(docs).alias("position")), place_col="position")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_token_ids),
]

#: Viterbi decoding, fingerprint search and byte-pair encoding have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
