"""The whole way of a scan: extract items from text, look the distinct ones up, join back, and shape the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosieve.operators.extract import TYPES, extract
from argosieve.operators.lookup import lookup_many
from argosieve.plans.indicators import IndicatorSet
from argosieve.plans.shared import materialize, spread


def types_for(isets: list[IndicatorSet]) -> tuple[str, ...]:
    """The item types that some set can answer."""
    ip = any(s.meta["counts"].get("ip") for s in isets)
    text = any(s.meta["counts"].get(k) for s in isets for k in ("literal", "glob"))
    return tuple(t for t in TYPES if (t in ("IPv4", "IPv6") and ip) or (t not in ("IPv4", "IPv6") and text))


def match_items(items: DataFrame, isets: list[IndicatorSet]) -> DataFrame:
    """Items (item_type, raw, value and what else they have) with every set's match; each distinct one is looked up once."""
    hits = lookup_many(items, "value", isets)
    keep = [c for c in items.columns if c not in ("raw", "value")]
    return items.join(hits, items["value"] == hits["text"]).select(*[items[c] for c in keep], F.col("text").alias("matched_text"), "database_id", "match_type", "prefix_len", "cidr", "pattern_count", "data")


def scan(df: DataFrame, text_col: str, isets: list[IndicatorSet], types: tuple[str, ...] | None = None, min_labels: int = 2, keep: Callable[[DataFrame, str], DataFrame] = materialize, boundaries: bool = True, spans: bool = False) -> DataFrame:
    """A row for each item and set that match: the columns of ``df`` but the text, item_type, matched_text, database_id,
    match_type, prefix_len, cidr, pattern_count, data; with ``spans`` also start and end, the item's place in the text's bytes.

    The text is read once: its items, which are small beside it, are written by ``keep`` before they are looked up.
    """
    types = types_for(isets) if types is None else types
    src = df if df.isStreaming else spread(df)
    return match_items(keep(extract(src, text_col, types or ("IPv4",), min_labels, boundaries=boundaries, spans=spans), "items"), isets)


def to_ndjson(matches: DataFrame, source: str | None = None, timestamp: str = "0.000") -> DataFrame:
    """Matches as lines of JSON. A pattern's payloads are an array, left out if it is empty; an address has one object."""
    where = F.col(source) if source else F.lit("-")
    head = F.to_json(F.struct(F.lit(timestamp).alias("timestamp"), where.alias("source"), F.col("matched_text"), "match_type", "pattern_count", "prefix_len", "cidr"))
    body = F.when(F.col("match_type") == "ip", F.element_at("data", 1)).when(F.size("data") > 0, F.concat(F.lit("["), F.array_join("data", ","), F.lit("]")))
    return matches.select(F.when(body.isNull(), head).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"data":'), body, F.lit("}"))).alias("value"))


def items_json(items: DataFrame) -> DataFrame:
    return items.select(F.to_json(F.struct(F.lower("item_type").alias("type"), "value")).alias("value"))


def scan_stats(df: DataFrame, text_col: str, isets: list[IndicatorSet], id_col: str) -> DataFrame:
    """One row about a scan: lines, bytes, candidates, matches, lines_with_matches and match_rate."""
    items = materialize(extract(spread(df.select(id_col, text_col)), text_col, types_for(isets) or ("IPv4",)), "items")
    matches = match_items(items, isets)
    a = df.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length(text_col).cast("bigint")), F.lit(0)).alias("bytes"))
    b = items.agg(F.count(F.lit(1)).alias("candidates"))
    c = matches.agg(F.count(F.lit(1)).alias("matches"), F.countDistinct(id_col).alias("lines_with_matches"))
    return a.crossJoin(b).crossJoin(c).withColumn("match_rate", F.when(F.col("candidates") > 0, F.col("matches") / F.col("candidates")).otherwise(0.0))


def type_counts(df: DataFrame, text_col: str, types: tuple[str, ...] = TYPES) -> DataFrame:
    return extract(spread(df.select(text_col)), text_col, types).groupBy("item_type").agg(F.count(F.lit(1)).alias("n"))


