"""Shared pieces of the training-data operators.

Operators take a frame and the names of the columns they use, read only those
columns, and return either their own result columns or (for filters and
rewrites) the input's columns unchanged in name, order and type. Columns they
do not name may therefore have any name, also that of an internal column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import forget_at_exit, scratch_path, ship_package

#: The white space of the word rule ``[^\\x20\\x09-\\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names made from ``stems`` that no column of ``df`` has: longer than any."""
    fill = "_" * (max(map(len, df.columns), default=0) + 1)
    return [fill + s for s in stems]


def utf8(col: str | Column) -> Column:
    """Text as UTF-8 bytes; null counts as empty."""
    c = F.col(f"`{col}`") if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: cuts the
    lineage, survives lost executors, and lets several consumers share it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same_bytes(col: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in col.to_pylist()]


def flat_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and the n + 1 offsets."""
    values = same_bytes(col)
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return np.frombuffer(b"".join(values), np.uint8), offsets


def id_schema(rows: DataFrame, ddl: str) -> T.StructType:
    """The column ``id`` of ``rows``, and then those of ``ddl``."""
    return T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL(ddl).fields])
