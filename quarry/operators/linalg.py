"""Matrices in long form ``(row, col, value)``.

A product is an equi-join on the shared index followed by a grouped sum —
partial sums are combined map-side, so only the output cells cross the
final shuffle. When one operand is a small model it is better shipped as a
literal (see :mod:`quarry.functions.vec`), which avoids the join entirely.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matmul_long(a: DataFrame, b: DataFrame, a_row: str, inner: str, b_col: str,
                value: str = "v") -> DataFrame:
    """C = A B with A as (a_row, inner, value) and B as (inner, b_col, value)."""
    left = a.select(F.col(a_row), F.col(inner), F.col(value).alias("_va"))
    right = b.select(F.col(inner), F.col(b_col), F.col(value).alias("_vb"))
    return (left.join(right, inner)
            .groupBy(a_row, b_col).agg(F.sum(F.col("_va") * F.col("_vb")).alias("value")))


def transpose_long(a: DataFrame, row: str, col: str) -> DataFrame:
    return a.withColumnRenamed(row, "_t").withColumnRenamed(col, row).withColumnRenamed("_t", col)


def to_long(df: DataFrame, id_col: str, vec: str, row: str = "row", col: str = "col", value: str = "v") -> DataFrame:
    """Array column -> long matrix cells (0-based column index)."""
    return df.select(F.col(id_col).alias(row), F.posexplode(vec).alias(col, value)).withColumn(col, F.col(col).cast("long"))
