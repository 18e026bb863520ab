"""Canonical exact fingerprints of documents."""

from __future__ import annotations

import unicodedata

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosieve.llm.common import read_table
from argosieve.llm.exactgroups import exact_groups


def canonical(text: str) -> bytes:
    """The text in normal form C with case folded, and single spaces for runs of white space, none at the ends.

    Folding may leave letters apart from their marks, so the form is restored after it.
    """
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(body: bytes) -> bytes:
    return xxhash.xxh3_128_digest(body)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, digest, canonical_bytes, group_id, group_size) for every document.

    Documents group by a 128-bit xxhash of their canonical text; inside equal digests the canonical bytes themselves are
    compared, and unequal ones are put apart. ``group_id`` is the smallest id of the group (null if all are null), so ties
    don't matter. A null text has a null digest and is alone; empty and blank texts are equal; texts of any length are read
    whole. Repeated rows count each. An empty table gives no rows. Other columns, whatever their names, are left out.
    """
    groups = exact_groups(docs, id_col, text_col, canonical, digest, "fingerprint")
    out = groups.select(F.col("id").alias(id_col), F.lower(F.hex("digest")).alias("digest"), F.col("n_bytes").alias("canonical_bytes"), F.col("keeper").alias("group_id"), F.col("n").alias("group_size"))
    gone = docs.filter(docs[text_col].isNull()).select(docs[id_col].alias(id_col), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("canonical_bytes"), docs[id_col].alias("group_id"), F.lit(1).cast("bigint").alias("group_size"))
    return out.unionByName(gone)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of ``op9_document_fingerprints``, without the digest, which SQL has no function for."""
    return op9_document_fingerprints(spark, sf_dir).drop("digest")


GROUPS_SQL = r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')) AS body FROM documents)
SELECT doc_id, CAST(strlen(body) AS BIGINT) AS canonical_bytes,
       CASE WHEN body IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY body) END AS group_id,
       CASE WHEN body IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY body) END AS group_size
FROM c
"""
