"""Shared inputs and SQL fragments of the registered plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import hash_unit, sql_hash_unit
from quarry.sources.tables import table, vectors

SEED = 42
TEST_FRACTION = 0.3


def emb(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings with a seeded hash split column (30 % test)."""
    return vectors(spark, sf).withColumn(
        "split", F.when(hash_unit(SEED, "vec_id") < TEST_FRACTION, "test").otherwise("train"))


SQL_EMB = f"""
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label,
             CASE WHEN {sql_hash_unit(SEED, 'vec_id')} < {TEST_FRACTION} THEN 'test' ELSE 'train' END AS split
      FROM embeddings)"""

# class means of the training split, as DuckDB lists
SQL_CENTROIDS = """
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (
        SELECT label, i, avg(v) AS m FROM (
          SELECT label, unnest(x) AS v, unnest(range(len(x))) AS i FROM e WHERE split = 'train')
        GROUP BY label, i) GROUP BY label)"""


def tbl(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)
