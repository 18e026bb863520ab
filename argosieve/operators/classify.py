"""What a key is: an address or prefix, a glob, or an exact string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosieve.functions.globs import has_wildcard, is_valid_glob
from argosieve.functions.ip import parse_prefix


def _error(text: str, key: Column) -> Column:
    return F.raise_error(F.concat(F.lit(text), key))


def classify(entries: DataFrame) -> DataFrame:
    """Adds kind (ip, glob or literal), name (the key without its mark) and prefix (hi, lo, plen, v6 of an ip).

    ``literal:``, ``glob:`` and ``ip:`` before a key decide, in lower case only; what they promise must hold. A row may bring
    its own ``kind`` instead. Without either, a key is an address or prefix if it reads as one, a glob if it has a wildcard
    and is sound, and else a literal.
    """
    key = F.col("key")
    given = F.col("kind") if "kind" in entries.columns else F.lit(None).cast("string")
    marked = F.when(given.isNotNull(), given)
    for mark in ("literal", "glob", "ip"):
        marked = marked.when(key.startswith(mark + ":"), F.lit(mark))
    name = F.when(given.isNotNull(), key)
    for mark in ("literal", "glob", "ip"):
        name = name.when(key.startswith(mark + ":"), F.substring(key, len(mark) + 2, 1 << 30))
    df = entries.withColumn("_marked", marked).withColumn("name", F.coalesce(name, key))
    prefix = parse_prefix(F.when(F.col("_marked").isNull() | (F.col("_marked") == "ip"), F.col("name")))
    # no prefix has a wildcard, so the two tests need nothing of each other and one Python worker makes both
    globby = (F.col("_marked") == "glob") | (F.col("_marked").isNull() & has_wildcard(F.col("name")))
    df = df.withColumns({"prefix": prefix, "_glob": is_valid_glob(F.when(globby, F.col("name")))})
    kind = (
        F.when((F.col("_marked") == "ip") & F.col("prefix").isNull(), _error("not an address or prefix: ", key))
        .when((F.col("_marked") == "glob") & ~F.col("_glob"), _error("not a glob: ", key))
        .when(F.col("_marked").isNotNull(), F.col("_marked"))
        .when(F.col("prefix").isNotNull(), F.lit("ip"))
        .when(F.col("_glob"), F.lit("glob"))
        .otherwise(F.lit("literal"))
    )
    return df.withColumn("kind", kind).drop("_marked", "_glob")
