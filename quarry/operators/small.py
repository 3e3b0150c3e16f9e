"""Bounded collects of the small results of a plan.

Join sides carry no broadcast hint: Spark broadcasts a side itself when its
size at run time is under its own threshold, and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of a fitted model (centroids, Grams, histograms) that may reach the driver.
COLLECT_MAX_BYTES = 128 << 20
_ARRAY_ITEMS = 128  # items that an array is taken to hold


class TooLargeError(ValueError):
    """A result that must be small turned out not to be."""


def row_bytes(kind: T.DataType) -> int:
    """About how many bytes a value of a type takes."""
    if isinstance(kind, T.StructType):
        return 16 + sum(row_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 16 + _ARRAY_ITEMS * row_bytes(kind.elementType)
    return 40 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def collect_small(df: DataFrame, what: str = "table", max_bytes: int = COLLECT_MAX_BYTES) -> list:
    """Collect a small table (a fitted model) under a bound in bytes."""
    most = max(1, max_bytes // row_bytes(df.schema))
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooLargeError(f"{what} takes more than {max_bytes} bytes; refusing to collect it")
    return rows


def local_frame(spark, rows, schema) -> DataFrame:
    """A small driver-side table (a fitted model, a plan of targets) as a
    DataFrame built entirely in the JVM: one JSON literal, parsed once by
    constant folding and exploded. Unlike ``createDataFrame(list)`` this
    needs no Python RDD, so no Python worker starts for it."""
    import json

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema.fields]

    def clean(v):
        # NaN / +-Infinity stay non-numeric JSON tokens (parsed back as such)
        return v.item() if hasattr(v, "item") else v

    recs = [dict(zip(names, (clean(v) for v in r))) for r in rows]
    arr = F.from_json(F.lit(json.dumps(recs)), T.ArrayType(schema), {"allowNonNumericNumbers": "true"})
    return spark.range(1).select(F.explode(arr).alias("_r")).select(*[F.col(f"_r.{n}").alias(n) for n in names])
