"""Seeded sampling: without replacement, shuffles and bootstrap draws, all
as pure functions of (seed, key) so they are partition-independent."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import hash_u60, hash_unit
from quarry.operators.ordering import with_global_index


def sample_k(df: DataFrame, key: str, k: int, seed=42) -> DataFrame:
    """k rows without replacement: the k smallest seeded hashes (a top-k
    per partition merged at the end; k is the feature's own limit)."""
    return df.withColumn("_h", hash_u60(seed, key)).orderBy("_h", key).limit(k).drop("_h")


def shuffle_order(df: DataFrame, key: str, seed=42, out: str = "pos") -> DataFrame:
    """A seeded permutation: position = rank of the salted hash."""
    return with_global_index(df.withColumn("_h", hash_u60(seed, key)), ["_h", key], out).drop("_h")


def poisson1_thresholds(kmax: int = 12) -> list[float]:
    """Cumulative probabilities of Poisson(1) for 0..kmax (by its formula)."""
    out, acc = [], 0.0
    for k in range(kmax + 1):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def poisson1_draw(u: Column, kmax: int = 12) -> Column:
    """Inverse-CDF Poisson(1) count from a uniform in [0, 1)."""
    th = poisson1_thresholds(kmax)
    expr = F.when(u < th[0], 0)
    for k in range(1, kmax + 1):
        expr = expr.when(u < th[k], k)
    return expr.otherwise(kmax + 1)


def bootstrap_counts(df: DataFrame, key: str, n_bags: int, seed=42) -> DataFrame:
    """(key, bag, draws): how often each row is drawn into each bag (Poisson
    bootstrap, the large-n limit of n draws with replacement). draws = 0
    marks the bag's out-of-bag rows."""
    bags = F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1))).alias("bag")
    b = df.select(key, bags)
    return b.withColumn("draws", poisson1_draw(hash_unit(seed, key, "bag")))
