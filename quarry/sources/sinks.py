"""Sinks: vectors and fitted models written to (shared) storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_centroid_model(centroids: DataFrame, path: str) -> None:
    """A class-average model is a small table (label, centroid, n)."""
    centroids.coalesce(1).write.mode("overwrite").parquet(path)


def load_centroid_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_spark_model(model, path: str) -> None:
    """Spark ML models/pipelines: overwrite-save to a path."""
    model.write().overwrite().save(path)


def load_spark_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
