"""Sufficient statistics of linear models: the augmented Gram matrix.

For Z = [1, x_1..x_d, y] the matrix ZᵀZ holds n, the feature sums, XᵀX,
Xᵀy and yᵀy. Each partition reduces its rows to one (d+2)² block with numpy
(``mapInPandas``, Arrow batches), so the shuffle carries (d+2)² cells per
partition and group — independent of n — and the final sum is a tiny
grouped aggregate. Everything a least-squares family model needs (OLS,
ridge, lasso via coordinate descent, PCA, covariance, fold-wise CV) is then
a d x d problem.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.small import collect_small


class Gram(np.ndarray):
    """A Gram matrix of Z - shift. ``shift`` (0 for the constant) is near the
    means, so sums of squares lose no digits when means are large beside the
    deviations; covariances don't depend on it, means add it back."""

    shift: np.ndarray | None = None

    def __array_finalize__(self, obj):
        self.shift = getattr(obj, "shift", None)


def centred_gram(df: DataFrame, features: str, target: str | None = None) -> "Gram":
    """The Gram of [1, x, (y)] about the means of a few rows."""
    shift = _near_means(df, features, target)
    return _shifted(gram_matrix(gram(df, features, target, shift=shift)), shift)


def centred_grams(df: DataFrame, features: str, target: str | None, by: str) -> dict:
    """One Gram for each value of ``by``, all about the same shift."""
    shift = _near_means(df, features, target)
    return {k: _shifted(m, shift) for k, m in gram_matrices(gram(df, features, target, by=[by], shift=shift), by).items()}


def _shifted(m: np.ndarray, shift: np.ndarray) -> "Gram":
    out = m.view(Gram)
    out.shift = shift
    return out


def _near_means(df: DataFrame, features: str, target: str | None, rows: int = 200) -> np.ndarray:
    """[0, x, (y)] averaged over some rows: any point near the means will do."""
    some = df.select(F.col(features).cast("array<double>"), *([F.col(target).cast("double")] if target else [])).limit(rows).collect()
    z = np.array([[0.0, *r[0], *r[1:]] for r in some], float)
    return z.mean(axis=0) if len(z) else np.zeros(1)


def gram(df: DataFrame, features: str, target: str | None = None, by: Sequence[str] = (),
         shift: np.ndarray | None = None) -> DataFrame:
    """Long Gram cells ``(by..., i, j, value)`` of Z = [1, x, (y)], or of Z -
    shift; index 0 is the constant, 1..d the features, d+1 the target (when
    given)."""
    by = list(by)
    cols = by + [features] + ([target] if target else [])
    multi = bool(target) and df.schema[target].dataType.typeName() == "array"
    ycol = F.col(target).cast("array<double>" if multi else "double").alias("_y") if target else None
    src = df.select(*by, F.col(features).cast("array<double>").alias("_x"), *([ycol] if target else []))
    schema = T.StructType([src.schema[c] for c in by] + [
        T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def block(batches):
        acc: dict = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack(g["_x"].to_numpy())
                parts = [np.ones((len(g), 1)), x]
                if target and multi:
                    parts.append(np.stack(g["_y"].to_numpy()))
                elif target:
                    parts.append(g["_y"].to_numpy(dtype=float).reshape(-1, 1))
                z = np.hstack(parts)
                if shift is not None:
                    z = z - shift
                m = z.T @ z
                acc[key] = acc[key] + m if key in acc else m
        for key, m in acc.items():
            k = m.shape[0]
            ii, jj = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
            out = pd.DataFrame({"i": ii.ravel().astype("int32"), "j": jj.ravel().astype("int32"), "value": m.ravel()})
            for c, v in zip(by, key):
                out[c] = v
            yield out[by + ["i", "j", "value"]]

    partial = src.mapInPandas(block, schema)
    return partial.groupBy(*by, "i", "j").agg(F.sum("value").alias("value"))


def gram_matrix(g: DataFrame, by_value: tuple = (), by: Sequence[str] = ()) -> np.ndarray:
    """Collect one (d+2)² Gram (size-checked) into a numpy matrix."""
    sel = g
    for c, v in zip(by, by_value):
        sel = sel.filter(F.col(c) == v)
    rows = collect_small(sel.select("i", "j", "value"), "Gram matrix")
    k = max(max(r["i"], r["j"]) for r in rows) + 1
    m = np.zeros((k, k))
    for r in rows:
        m[r["i"], r["j"]] = r["value"]
    return m


def gram_matrices(g: DataFrame, by: str) -> dict:
    """All Grams of a grouped result, keyed by group value."""
    rows = collect_small(g.select(by, "i", "j", "value"), "Gram matrices")
    out: dict = {}
    k = max(max(r["i"], r["j"]) for r in rows) + 1
    for r in rows:
        out.setdefault(r[by], np.zeros((k, k)))[r["i"], r["j"]] = r["value"]
    return out


def covariance_long(g: DataFrame) -> DataFrame:
    """Sample covariance cells (i, j) of the features from Gram cells (no
    target): (Σ x_i x_j - n μ_i μ_j) / (n - 1), as a join of d² rows."""
    n = g.filter("i = 0 AND j = 0").first()["value"]  # the row count, one scalar
    s = g.filter("i = 0 AND j > 0").select(F.col("j").alias("k"), F.col("value").alias("s"))
    cells = g.filter("i > 0 AND j > 0")
    t = (cells.join(s.withColumnRenamed("k", "i").withColumnRenamed("s", "si"), "i")
         .join(s.withColumnRenamed("k", "j").withColumnRenamed("s", "sj"), "j"))
    cov = (F.col("value") - F.col("si") * F.col("sj") / F.lit(n)) / F.lit(n - 1)
    return t.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), cov.alias("cov"))
