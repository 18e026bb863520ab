"""Made-up indicators and queries for measurements, as many as asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosieve.functions.ip import long_to_ipv4

STYLES = ("prefix", "suffix", "mixed", "complex")


def synthetic(spark: SparkSession, kind: str, n: int, style: str = "mixed") -> DataFrame:
    """Entries (seq, key, data_json): addresses in a row, strings, patterns of a style, or addresses and patterns combined."""
    rows = spark.range(n).withColumnRenamed("id", "seq")
    i = F.col("seq")
    host = F.concat(F.lit("bench-"), i.cast("string"), F.lit(".example.com"))
    tail = F.concat(F.lit("*.domain-"), i.cast("string"), F.lit(".com"))
    head = F.concat(F.lit("prefix-"), i.cast("string"), F.lit("-*"))
    inner = F.concat(F.lit("*[0-9].a?c-"), i.cast("string"), F.lit(".*.org"))
    if style not in STYLES:
        raise ValueError(f"unknown pattern style: {style}")
    pattern = {"prefix": head, "suffix": tail, "mixed": F.when(i % 2 == 0, head).otherwise(tail), "complex": inner}[style]
    if kind == "combined":
        key = F.when(i % 2 == 0, long_to_ipv4(i)).otherwise(pattern)
    elif kind in ("ip", "literal", "pattern"):
        key = {"ip": long_to_ipv4(i), "literal": host, "pattern": pattern}[kind]
    else:
        raise ValueError(f"unknown kind: {kind}")
    return rows.select("seq", key.alias("key"), F.to_json(F.struct(i.alias("n"))).alias("data_json"))


def lookups(spark: SparkSession, kind: str, n: int, n_entries: int, hit_rate: float, style: str = "mixed") -> DataFrame:
    """Texts (q) to look up in ``synthetic``; as many in a hundred as ``hit_rate`` says are found."""
    i = F.col("id") % max(1, n_entries)
    hit = F.pmod(F.xxhash64("id"), F.lit(10_000)) < int(hit_rate * 10_000)
    p = F.concat(F.lit("prefix-"), i.cast("string"), F.lit("-x"))
    s = F.concat(F.lit("www.domain-"), i.cast("string"), F.lit(".com"))
    c = F.concat(F.lit("x7.abc-"), i.cast("string"), F.lit(".y.org"))
    pattern = {"prefix": p, "suffix": s, "mixed": F.when(i % 2 == 0, p).otherwise(s), "complex": c}[style]
    good = {"ip": long_to_ipv4(i), "literal": F.concat(F.lit("bench-"), i.cast("string"), F.lit(".example.com")), "pattern": pattern, "combined": F.when(i % 2 == 0, long_to_ipv4(i)).otherwise(pattern)}[kind]
    bad = F.when(F.lit(kind == "ip"), long_to_ipv4(F.lit(250 << 24) + F.col("id"))).otherwise(F.concat(F.lit("miss-"), F.col("id").cast("string")))
    return spark.range(n).select(F.when(hit, good).otherwise(bad).alias("q"))
