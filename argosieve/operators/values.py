"""Nested payloads: paths into them, flat lists of them, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_get(data_json: Column, path: list[str | int]) -> Column:
    """The value at a path of names and array places, as text (strings without quotes); null if there is none."""
    return F.get_json_object(data_json, "$" + "".join(f"[{p}]" if isinstance(p, int) or p.isdigit() else f"['{p}']" for p in path))


def _walk(value, path: str, depth: int):
    kind = "map" if isinstance(value, dict) else "array" if isinstance(value, list) else "bool" if isinstance(value, bool) else "null" if value is None else "string" if isinstance(value, str) else "number"
    size = len(value) if kind in ("map", "array") else None
    import json

    yield {"path": path, "depth": depth, "value_type": kind, "value": None if size is not None else json.dumps(value) if kind != "string" else value, "size": size}
    if kind == "map":
        for k in sorted(value):
            yield from _walk(value[k], f"{path}.{k}", depth + 1)
    elif kind == "array":
        for i, x in enumerate(value):
            yield from _walk(x, f"{path}[{i}]", depth + 1)


FLAT = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("value_type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("size", T.IntegerType())]))


@F.pandas_udf(FLAT)
def _flat(s):
    import json

    import pandas as pd

    return pd.Series([None if x is None else list(_walk(json.loads(x), "$", 0)) for x in s], dtype=object)


def flatten(df: DataFrame, data_col: str = "data_json") -> DataFrame:
    """A row for each node of the payload, parents first: path, depth, value_type, value, size."""
    keep = [c for c in df.columns if c != data_col]
    return df.select(*keep, F.explode(_flat(F.col(data_col))).alias("node")).select(*keep, "node.*")


def format_number(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def format_bytes(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that they fill."""
    scaled = lambda p, u: F.concat(F.format_string("%.2f", n / float(1 << p)), F.lit(u))
    return F.when(n >= 1 << 30, scaled(30, " GB")).when(n >= 1 << 20, scaled(20, " MB")).when(n >= 1 << 10, scaled(10, " KB")).otherwise(F.concat(n.cast("bigint").cast("string"), F.lit(" bytes")))


def format_rate(n: Column) -> Column:
    """A rate a second, in thousands or millions where it has them."""
    return F.when(n >= 1e6, F.concat(F.format_string("%.2f", n / 1e6), F.lit("M"))).when(n >= 1e3, F.concat(F.format_string("%.2f", n / 1e3), F.lit("K"))).otherwise(F.format_string("%.2f", n.cast("double")))
