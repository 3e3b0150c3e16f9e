"""Reading the driver tables and typed inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (vec_id, x array<double>, label): float arrays are cast
    to double once, before any arithmetic."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def read_csv_labelled(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Labelled CSV with an explicit schema (never inferred)."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First n rows in a stated order (``head()``)."""
    return df.orderBy(*order_by).limit(n)


def row_at(df: DataFrame, order_by: list[str], i: int) -> DataFrame:
    """Positional row i (0-based) in a stated order: a top-(i+1) per
    partition merge, not a global window."""
    return df.orderBy(*order_by).offset(i).limit(1)
