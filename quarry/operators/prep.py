"""Preparation: seeded splits and folds, scaling, encoding, binning,
polynomial features."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import hash_u60, hash_unit
from quarry.operators.ordering import select_ranks, with_global_index
from quarry.operators.small import collect_small


def poly2(x: str | Column) -> Column:
    """[x_1..x_d, x_i x_j for i <= j] (degree-2, no bias)."""
    x = F.col(x) if isinstance(x, str) else x
    d = F.size(x)
    cross = F.flatten(F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.transform(
        F.sequence(i, d - 1), lambda j: F.element_at(x, i + 1) * F.element_at(x, j + 1))))
    return F.concat(x, cross)


def poly2_names(x: str | Column, stem: str = "x") -> Column:
    """Names of the terms of :func:`poly2`: x0.., then x0^2, x0 x1, ..."""
    d = F.size(F.col(x) if isinstance(x, str) else x)
    name = lambda i: F.concat(F.lit(stem), i.cast("string"))
    every = F.sequence(F.lit(0), d - 1)
    cross = F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, d - 1), lambda j: F.when(
        i == j, F.concat(name(i), F.lit("^2"))).otherwise(F.concat_ws(" ", name(i), name(j))))))
    return F.concat(F.transform(every, name), cross)


def hash_split(df: DataFrame, key: str, fractions: dict[str, float], seed=42, out: str = "split") -> DataFrame:
    """Assign named splits by a seeded uniform hash (cumulative thresholds).
    Partition-independent and exact under retries; sizes are approximate."""
    u = hash_unit(seed, key)
    expr, acc = None, 0.0
    items = list(fractions.items())
    for name, frac in items[:-1]:
        acc += frac
        expr = (F.when(u < acc, name) if expr is None else expr.when(u < acc, name))
    last = items[-1][0]
    expr = F.lit(last) if expr is None else expr.otherwise(last)
    return df.withColumn(out, expr)


def exact_split(df: DataFrame, key: str, test_fraction: float, seed=42, by: str | None = None,
                out: str = "split") -> DataFrame:
    """Hold-out with an exact test size ceil(n * p) (per class when ``by``):
    the test rows are the ones with the smallest (hash, key). The threshold
    row is found by distributed rank selection, never by a global sort."""
    h = df.withColumn("_h", hash_u60(seed, key))
    gcols = [by] if by else []
    if by:
        counts = collect_small(h.groupBy(by).count(), "class counts")
        targets = [(r[by], math.ceil(r["count"] * test_fraction) - 1) for r in counts]
    else:
        n = h.count()
        targets = [(math.ceil(n * test_fraction) - 1,)]
    targets = [t for t in targets if t[-1] >= 0]
    thr = select_ranks(h, "_h", targets, gcols, tiebreak=[key]).select(
        *gcols, F.col("_h").alias("_th"), F.col(key).alias("_tk"))
    if gcols:
        j = h.join(thr, gcols, "left")
        is_test = (F.col("_h") < F.col("_th")) | ((F.col("_h") == F.col("_th")) & (F.col(key) <= F.col("_tk")))
        return j.withColumn(out, F.when(F.coalesce(is_test, F.lit(False)), "test").otherwise("train")).drop("_h", "_th", "_tk")
    rows = thr.collect()
    if not rows:
        return h.withColumn(out, F.lit("train")).drop("_h")
    th, tk = rows[0]["_th"], rows[0]["_tk"]
    is_test = (F.col("_h") < F.lit(th)) | ((F.col("_h") == F.lit(th)) & (F.col(key) <= F.lit(tk)))
    return h.withColumn(out, F.when(is_test, "test").otherwise("train")).drop("_h")


def kfold(df: DataFrame, key: str, k: int, seed=42, out: str = "fold") -> DataFrame:
    """fold = hash mod k (each row held out exactly once)."""
    return df.withColumn(out, F.pmod(hash_u60(seed, key), F.lit(k)).cast("int"))


def standardize_fit(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and population std per column (one aggregate); std 0 -> 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mu"), F.stddev_pop(c).alias(f"{c}__sd")]
    r = df.agg(*aggs).first()
    return {c: (r[f"{c}__mu"], r[f"{c}__sd"] if r[f"{c}__sd"] else 1.0) for c in cols}


def standardize_apply(df: DataFrame, stats: dict, suffix: str = "_z") -> DataFrame:
    for c, (mu, sd) in stats.items():
        df = df.withColumn(c + suffix, (F.col(c) - F.lit(mu)) / F.lit(sd))
    return df


def standardize_vectors_fit(df: DataFrame, vec: str = "x") -> tuple[list, list]:
    """Per-coordinate mean / population std of an array column (d values)."""
    s = sorted(collect_small(df.select(F.posexplode(vec).alias("i", "v")).groupBy("i")
                             .agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")), "coordinate stats"),
               key=lambda r: r["i"])
    return [r["mu"] for r in s], [r["sd"] if r["sd"] else 1.0 for r in s]


def standardize_vectors_apply(df: DataFrame, mu: list, sd: list, vec: str = "x", out: str = "xz") -> DataFrame:
    from quarry.functions.vec import lit_vector
    m, s = lit_vector(mu), lit_vector(sd)
    return df.withColumn(out, F.zip_with(F.zip_with(F.col(vec), m, lambda a, b: a - b), s, lambda a, b: a / b))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Distinct strings -> 0-based integer in ascending (binary) order. The
    distinct value table is indexed without a single-task window and joined
    back."""
    out = out or f"{col}_idx"
    d = df.select(col).distinct().filter(F.col(col).isNotNull())
    idx = with_global_index(d, [col], out)
    return df.join(idx, col, "left")


def bin_floor(col: str, width: float) -> Column:
    return F.floor(F.col(col) / F.lit(width)).cast("long")
