"""Checks of payloads and of whole indicator sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("critical", "high", "medium", "low", "unknown")
TLP = ("CLEAR", "GREEN", "AMBER", "AMBER+STRICT", "RED")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _at(v: Column, name: str) -> Column:
    return F.variant_get(v, f"$.{name}", "variant")


def threatdb_violations(data_json: Column) -> Column:
    """What a payload has against the threat schema: an array of (path, message), empty if it is sound.

    threat_level, category and source are required; levels and tlp come from fixed lists, confidence is a whole number from
    0 to 100, category, source and indicator_type aren't empty, tags are strings, and the other known fields are strings.
    Further fields are free.
    """
    whole = F.try_parse_json(F.coalesce(data_json, F.lit("{}")))
    known = ("threat_level", "category", "source", "first_seen", "last_seen", "description", "reference", "tlp", "indicator_type")
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    fields = lambda v: F.struct(_kind(v).alias("all"), *[_kind(_at(v, n)).alias(n) for n in (*known, "confidence", "tags")], *[F.try_variant_get(v, f"$.{n}", "string").alias(f"{n}_text") for n in ("threat_level", "tlp", "category", "source", "indicator_type")], F.try_variant_get(v, "$.confidence", "double").alias("number"))
    return once(whole, lambda v: once(fields(v), _broken_rules))


def _broken_rules(v: Column) -> Column:
    """The rules that a payload breaks, by the kinds and values of its fields, which were read once."""
    text, has, is_text = lambda n: v[f"{n}_text"], lambda n: v[n].isNotNull(), lambda n: v[n] == "STRING"
    rule = lambda bad, path, message: F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    rules = [rule(~has(n), n, "is required") for n in ("threat_level", "category", "source")]
    rules += [rule(has(n) & ~is_text(n), n, "must be a string") for n in ("threat_level", "category", "source", "first_seen", "last_seen", "description", "reference", "tlp", "indicator_type")]
    rules += [rule(is_text("threat_level") & ~text("threat_level").isin(*LEVELS), "threat_level", "is not a known level"), rule(is_text("tlp") & ~text("tlp").isin(*TLP), "tlp", "is not a known marking")]
    rules += [rule(is_text(n) & (F.length(text(n)) == 0), n, "must not be empty") for n in ("category", "source", "indicator_type")]
    number = v["number"]
    whole = v["confidence"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number))
    rules += [rule(has("confidence") & ~F.coalesce(whole, F.lit(False)), "confidence", "must be a whole number"), rule(whole & ((number < 0) | (number > 100)), "confidence", "must be from 0 to 100")]
    rules += [rule(has("tags") & ~v["tags"].rlike("^ARRAY<(STRING|VOID)>$"), "tags", "must be an array of strings")]
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("is not a JSON object").alias("message")))
    return F.when(v["all"].isNull() | ~v["all"].startswith("OBJECT"), broken).otherwise(F.filter(F.array(*rules), lambda r: r.isNotNull()))


def with_violations(entries: DataFrame, check: Callable[[Column], Column] = threatdb_violations) -> DataFrame:
    return entries.withColumn("violations", check(F.col("data_json")))


def require_sound(entries: DataFrame, check: Callable[[Column], Column] = threatdb_violations) -> DataFrame:
    """The entries, where the first unsound one that is met is an error."""
    bad = check(F.col("data_json"))
    text = F.concat(F.lit("entry "), F.col("key"), F.lit(" is not valid: "), F.concat_ws("; ", F.transform(bad, lambda r: F.concat_ws(" ", r["path"], r["message"]))))
    return entries.withColumn("data_json", F.when(F.size(bad) > 0, F.raise_error(text)).otherwise(F.col("data_json")))
