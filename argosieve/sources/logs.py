"""Logs as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (source, text): trimmed lines that aren't blank. Files that end in .gz are unpacked; bytes that aren't UTF-8 become U+FFFD."""
    raw = spark.read.text(paths)
    lines = raw.select(F.input_file_name().alias("source"), F.regexp_replace("value", r"^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$", "").alias("text"))
    return lines.filter(F.length("text") > 0)


def log_lines_bytes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """As ``log_lines`` for small files in any encoding: every byte becomes the character of its number."""
    raw = spark.read.format("binaryFile").load(paths)
    lines = raw.select(F.col("path").alias("source"), F.explode(F.split(F.decode("content", "ISO-8859-1"), "\n")).alias("text"))
    return lines.select("source", F.regexp_replace("text", r"^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$", "").alias("text")).filter(F.length("text") > 0)
