"""Descriptive statistics: one aggregate pass per family, exact quantiles
by distributed rank selection (no single task buffers a whole column)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordering import exact_quantiles


def stack_columns(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "v") -> DataFrame:
    """Wide numeric columns -> long (column, value)."""
    arr = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(F.explode(arr).alias("_s")).select(f"_s.{name}", f"_s.{value}")


def describe(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample std, min, quantiles (exact, linear), max per column.

    One aggregate job gives the per-column moments and the bounds the exact
    quantile selection starts from; its few rows come back as a literal table."""
    from quarry.operators.small import collect_small, local_frame
    long = stack_columns(df, cols)
    rows = collect_small(long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max")), "column moments")
    base = local_frame(df.sparkSession, [(r["column"], r["count"], r["mean"], r["std"], r["min"], r["max"]) for r in rows],
                       "column string, count long, mean double, std double, min double, max double")
    bounds = {(r["column"],): {"lo": r["min"], "hi": r["max"], "n": r["count"]} for r in rows if r["count"]}
    q = exact_quantiles(long, "v", probs, ["column"], bounds=bounds)
    piv = q.groupBy("column").pivot("prob", [float(p) for p in probs]).agg(F.first("quantile"))
    for p in probs:
        piv = piv.withColumnRenamed(str(float(p)), f"p{int(round(p * 100))}")
    return base.join(piv, "column", "left")


def basic_stats(df: DataFrame, col: str) -> DataFrame:
    """mean, population std, exact median."""
    m = df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    med = exact_quantiles(df, col, [0.5]).select(F.col("quantile").alias("median"))
    return _one_row_concat(m, med)


def _one_row_concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two single-row frames side by side without a join: pad each with
    the other's columns as nulls, union the two rows and keep the first
    non-null value of every column."""
    ca, cb = a.columns, b.columns
    pa = a.select(*ca, *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in cb])
    pb = b.select(*[F.lit(None).cast(a.schema[c].dataType).alias(c) for c in ca], *cb)
    return pa.unionByName(pb).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ca + cb])


def mode(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value; ties -> smallest value. Counting is a partial
    aggregate, so a value holding a third of the rows is no hot spot."""
    c = df.groupBy(col).agg(F.count("*").alias("n")).filter(F.col(col).isNotNull())
    return c.agg(F.max_by(col, F.struct(F.col("n"), -F.col(col))).alias("mode"))


def sparsity(df: DataFrame, vec: str) -> DataFrame:
    """Share of exactly-zero entries of an array column."""
    return df.agg((F.sum(F.size(F.filter(vec, lambda v: v == 0))) / F.sum(F.size(vec))).alias("sparsity"))
