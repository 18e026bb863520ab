"""Feeds of indicators: rows (seq, key, data_json), where ``seq`` rises in the order of the feed.

``data_json`` is JSON with sorted names; what a feed says nothing about is absent from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = "seq bigint, key string, data_json string"


def quote(c: Column) -> Column:
    """A string as JSON writes it."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def coerce(c: Column) -> Column:
    """A cell as a JSON value: an integer (64 bits, signed or not), a number, a truth value or a string.

    ``nan`` and ``inf`` stay strings, as JSON has no such numbers.
    """
    whole = c.rlike(r"^[+-]?\d+$")
    signed, unsigned = c.try_cast("bigint"), F.when(whole, c.try_cast("decimal(20,0)"))
    number = F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))
    fits = (unsigned >= 0) & (unsigned <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return (
        F.when(whole & signed.isNotNull(), signed.cast("string"))
        .when(whole & fits, unsigned.cast("string"))
        .when(number.isNotNull(), F.to_json(F.array(number)).substr(F.lit(2), F.length(F.to_json(F.array(number))) - 2))
        .when(c.isin("true", "false"), c)
        .otherwise(quote(c))
    )


def json_object(fields: dict[str, Column]) -> Column:
    """JSON text from values that are JSON text; null ones are left out."""
    parts = [F.concat(quote(F.lit(k)), F.lit(":"), v) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("{}")


def canonical_json(c: Column) -> Column:
    """JSON text with sorted names and no spaces."""
    return F.to_json(F.parse_json(c))


def text_feed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One key a line; blank lines and those that begin with ``#`` are left out."""
    line = F.trim(F.col("value"))
    return spark.read.text(paths).select(line.alias("key")).filter((F.col("key") != "") & ~F.col("key").startswith("#")).select(F.monotonically_increasing_id().alias("seq"), "key", F.lit("{}").alias("data_json"))


def entries_from_table(df: DataFrame, seq: Column | None = None) -> DataFrame:
    """Rows of a table with a column ``entry`` or ``key`` (the first such one); the others, as strings, become the payload."""
    key = next((c for c in df.columns if c in ("entry", "key")), None)
    if key is None:
        raise ValueError("the table needs a column named entry or key")
    cell = lambda c: F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`") != ""), coerce(F.col(f"`{c}`").cast("string")))
    payload = json_object({c: cell(c) for c in df.columns if c != key})
    return df.select((F.monotonically_increasing_id() if seq is None else seq).alias("seq"), F.col(f"`{key}`").alias("key"), payload.alias("data_json"))


def csv_feed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV with a header. Empty cells are absent from the payload."""
    return entries_from_table(spark.read.csv(paths, header=True, inferSchema=False, escape='"', multiLine=True))


def json_feed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """An array of objects with ``key`` (or ``entry``) and ``data``. A row without a key is an error."""
    rows = spark.read.json(paths, schema="key string, entry string, data string", multiLine=True)
    key = F.coalesce("key", "entry")
    known = F.when(key.isNull(), F.raise_error(F.lit("an entry has no key"))).otherwise(key)
    data = F.when(F.col("data").isNull(), F.lit("{}")).otherwise(canonical_json(F.col("data")))
    return rows.select(F.monotonically_increasing_id().alias("seq"), known.alias("key"), data.alias("data_json"))


def rows_feed(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Entries from memory: (key, JSON text)."""
    df = spark.createDataFrame([(i, k, d) for i, (k, d) in enumerate(rows)], ENTRY_SCHEMA)
    return df.withColumn("data_json", canonical_json(F.col("data_json")))


def load_feed(spark: SparkSession, path: str, kind: str | None = None, mode: str = "full") -> DataFrame:
    """A feed by its kind, or by the file's ending: .json, .csv, and text for the rest."""
    kind = kind or ("json" if path.endswith(".json") else "csv" if path.endswith(".csv") else "text")
    readers = {"text": text_feed, "csv": csv_feed, "json": json_feed}
    if kind == "misp":
        from argosieve.sources.misp import misp_feed

        return misp_feed(spark, path, mode)
    if kind not in readers:
        raise ValueError(f"unknown feed format: {kind}")
    return readers[kind](spark, path)


def concat_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Feeds one after the other: later ones have higher ``seq``."""
    out = None
    for i, f in enumerate(feeds):
        part = f.withColumn("seq", F.col("seq") + F.lit(i) * F.lit(1 << 55))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no feeds")
    return out
