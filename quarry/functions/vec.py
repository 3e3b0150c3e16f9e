"""Vector expressions over ``array<double>`` columns.

All of these are built from Spark's higher-order functions (transform,
zip_with, aggregate) so they stay JVM-side inside whole-stage codegen; no
Python runs per row.
"""

from __future__ import annotations

import json
import math
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double_array(x: ColumnOrName) -> Column:
    """float arrays (the parquet ``embedding`` column) -> array<double>."""
    return _c(x).cast("array<double>")


def _num(v: float) -> str:
    v = float(v)
    if math.isnan(v):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"{v!r}D"


def _vec_sql(values: Sequence[float]) -> str:
    return "array(" + ", ".join(_num(v) for v in values) + ")" if len(values) else "CAST(array() AS array<double>)"


def lit_vector(values: Sequence[float]) -> Column:
    """A small vector (model coefficients) as one constant: a JSON string
    literal that constant folding turns into a single array literal, so
    neither the driver nor the analyzer handles one node per element."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def lit_matrix(rows: Sequence[Sequence[float]]) -> Column:
    """Small matrix (a fitted model) as an array<array<double>> constant."""
    return F.from_json(F.lit(json.dumps([[float(v) for v in r] for r in rows])), "array<array<double>>")


def lit_ints(values: Sequence[int]) -> Column:
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), "array<bigint>")


def let(value: Column, fn) -> Column:
    """Bind a row-level scalar once and use it inside ``fn`` (Spark does not
    share sub-expressions across lambda invocations, so a statistic written
    inside ``transform`` would be recomputed for every element)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def vsum(x: ColumnOrName) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def add(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p + q)


def sub(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p - q)


def mul(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p * q)


def scale(a: ColumnOrName, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda v: v * s)


def add_scalar(a: ColumnOrName, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda v: v + s)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(x: ColumnOrName, p: float = 2.0) -> Column:
    """p-norm; p=1 and p=2 get exact forms, p=inf the max-abs."""
    x = _c(x)
    if p == 1:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v))
    if p == 2:
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    if math.isinf(p):
        return F.aggregate(x, F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))
    return F.pow(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(F.abs(v), F.lit(float(p)))), F.lit(1.0 / p))


def l2_normalize(x: ColumnOrName, eps: float = 1e-12) -> Column:
    return let(F.greatest(norm(x, 2), F.lit(eps)), lambda n: F.transform(_c(x), lambda v: v / n))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine similarity; a zero vector gives 0 (norms floored at 1e-12,
    as torch's normalize does)."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def sq_euclid(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def euclid(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.sqrt(sq_euclid(a, b))


def softmax(x: ColumnOrName) -> Column:
    """Max-shifted softmax of an array."""
    x = _c(x)
    return let(F.array_max(x), lambda m: let(
        F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m)),
        lambda z: F.transform(x, lambda v: F.exp(v - m) / z)))


def log_softmax(x: ColumnOrName) -> Column:
    x = _c(x)
    return let(F.array_max(x), lambda m: let(
        m + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m))),
        lambda lse: F.transform(x, lambda v: v - lse)))


# -- activations (scalar Column -> Column); use with F.transform for arrays --

def relu(v: Column) -> Column:
    return F.greatest(F.lit(0.0), v)


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def tanh(v: Column) -> Column:
    return F.tanh(v)


def silu(v: Column) -> Column:
    return v * sigmoid(v)


def gelu(v: Column) -> Column:
    """GELU, tanh approximation."""
    c = math.sqrt(2.0 / math.pi)
    return F.lit(0.5) * v * (F.lit(1.0) + F.tanh(F.lit(c) * (v + F.lit(0.044715) * v * v * v)))


ACTIVATIONS = {"relu": relu, "sigmoid": sigmoid, "tanh": tanh, "silu": silu, "gelu": gelu}


def activation(x: ColumnOrName, name: str) -> Column:
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}")
    f = ACTIVATIONS[name]
    return F.transform(_c(x), f)


def layernorm(x: ColumnOrName, eps: float = 1e-5) -> Column:
    """Per-row normalisation with population variance (no affine part)."""
    x = _c(x)
    n = F.size(x).cast("double")
    return let(vsum(x) / n, lambda mu: let(
        F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mu) * (v - mu)) / n,
        lambda var: F.transform(x, lambda v: (v - mu) / F.sqrt(var + F.lit(eps)))))


def linear(x: ColumnOrName, weights: Column, bias: Column | None = None) -> Column:
    """y = W x + b where W is array<array<double>> (one row per output)."""
    x = _c(x)
    if bias is None:
        return F.transform(weights, lambda w: dot(w, x))
    return F.transform(weights, lambda w, i: dot(w, x) + F.element_at(bias, i + 1))


def onehot(idx: ColumnOrName, k: int) -> Column:
    """0-based index -> length-k 0/1 double vector (null/out of range -> zeros)."""
    idx = _c(idx)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(j == idx, 1.0).otherwise(0.0))


def sinusoid_position(pos: ColumnOrName, d: int, base: float = 10000.0) -> Column:
    """Sinusoidal position vector: sin on even dims, cos on odd dims, the
    frequency of dim j being base^(-(j - j%2)/d)."""
    p = _c(pos).cast("double")
    return F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.when(j % 2 == 0, F.sin(p / F.pow(F.lit(base), (j - j % 2).cast("double") / d)))
        .otherwise(F.cos(p / F.pow(F.lit(base), (j - j % 2).cast("double") / d))),
    )


def linspace(start: ColumnOrName, stop: ColumnOrName, n: int) -> Column:
    """n evenly spaced points from start to stop inclusive."""
    a, b = _c(start).cast("double"), _c(stop).cast("double")
    if n == 1:
        return F.array(a)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + (b - a) * i / F.lit(float(n - 1)))


def logspace(start: float, stop: float, n: int) -> list[float]:
    """Grid of 10**linspace(start, stop, n) (a parameter list, not data)."""
    if n == 1:
        return [10.0 ** start]
    return [10.0 ** (start + (stop - start) * i / (n - 1)) for i in range(n)]


def clip(x: ColumnOrName, lo: float, hi: float) -> Column:
    return F.transform(_c(x), lambda v: F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def round_array(x: ColumnOrName, digits: int = 6) -> Column:
    return F.transform(_c(x), lambda v: F.round(v, digits))


def check_same_size(df, a: str, b: str) -> None:
    """Raise ValueError when two vector columns differ in length anywhere."""
    bad = df.filter(F.size(a) != F.size(b)).limit(1).count()
    if bad:
        raise ValueError(f"vector columns {a!r} and {b!r} differ in size")
