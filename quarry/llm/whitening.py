"""Embedding whitening by shifted CholeskyQR.

The distinct vectors, centred, are the rows of a tall matrix that only Spark
holds. Each pass takes the rows through the triangular solves so far, sums the
Gram matrix of what comes out in the tasks, and factors the sum on the driver:
the first factor is of the Gram matrix with a small shift, so that it exists
however ill-conditioned the rows are, and every further one makes the rows more
nearly orthonormal (Fukaya, Kannan, Nakatsukasa, Yamamoto and Yanagisawa, SIAM J.
Sci. Comput. 42, 2020). The product of the factors is the R of the centred
rows, whose singular values and vectors are those of the covariance; its
condition number is never squared, as it would be in the covariance itself.

Vectors of different lengths have nothing to do with each other: each length has
a fit of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_schema, written
from quarry.operators.small import collect_small

# Parameters.
SCALE, COMPONENTS = 256, 4
MOST_PASSES = 8
CLOSE = 1e-13      # of the Gram matrix to the identity, for each column
DEAD = 1e-10       # a pivot this small, of orthonormal rows: the column depends on those before it
BATCH = 2048       # rows that a task works on at once
_HALF = 1 << 31    # sums are taken of high and low halves, so that none overflows


@dataclass
class Fit:
    """What a length of vectors has: the rows, their sums, the factors, and what
    follows from them."""

    n: int
    sums: list[int]                                        # exact
    factors: list[np.ndarray] = field(default_factory=list)
    components: np.ndarray | None = None                   # unit columns, by falling eigenvalue
    values: np.ndarray | None = None                       # the eigenvalues
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _lists(batch: pa.RecordBatch, col: int):
    """The vectors of a batch by length: (length, row numbers, matrix of longs)."""
    column = batch.column(col)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        for a in range(0, len(rows), BATCH):
            some = rows[a:a + BATCH]
            yield d, some, flat[starts[some][:, None] + np.arange(d)]


def _vectors(rows: DataFrame, vec_col: str) -> DataFrame:
    """Usable vectors as longs, in column ``x``, beside ``id`` if it is there."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return rows.where(v.isNotNull() & F.coalesce(good, F.lit(False))).withColumn("x", F.transform(v, lambda c: F.floor(SCALE * c) + F.lit(0)))


def solve(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x R^-1 for an upper triangular R, column by column; dead columns give zeros."""
    out = np.zeros_like(x)
    for j in range(len(r)):
        if r[j, j]:
            out[:, j] = (x[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def cholesky(gram: np.ndarray, dead: float) -> np.ndarray:
    """Upper triangular R with R'R = ``gram``; columns whose pivot is ``dead`` or
    less have a row of zeros."""
    d = len(gram)
    r = np.zeros((d, d))
    for j in range(d):
        row = gram[j, j:] - r[:j, j] @ r[:j, j:]
        if row[0] > dead:
            r[j, j:] = row / np.sqrt(row[0])
    return r


def _shift(n: int, d: int, gram: np.ndarray) -> float:
    return 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * float(np.linalg.eigvalsh(gram)[-1])


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Add up the (width, i, j, value) cells of symmetric matrices."""
    cells = collect_small(parts.groupBy("width", "i", "j").agg(F.sum("value").alias("value")), "Gram matrices")
    out: dict[int, np.ndarray] = {}
    for w, i, j, v in cells:
        m = out.setdefault(w, np.zeros((0, 0)))
        if len(m) <= max(i, j):
            m = out[w] = np.pad(m, (0, max(i, j) + 1 - len(m)))
        m[i, j] = m[j, i] = v
    return out


def _grams(fit_list: DataFrame, fits: dict[int, Fit], image) -> dict[int, np.ndarray]:
    """Gram matrix of ``image(fit, centred rows)`` for each length: one pass."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _lists(batch, 0):
                y = image(fits[d], x - fits[d].mean)
                total[d] = total.get(d, 0) + y.T @ y
        for d, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(m[i, j])], names=["width", "i", "j", "value"])

    return _summed(fit_list.select("x").mapInArrow(run, "width int, i int, j int, value double"))


def _sums(fit_list: DataFrame) -> dict[int, Fit]:
    """Rows and exact sums of each length."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _lists(batch, 0):
                own = np.stack([np.full(d, len(x)), (x // _HALF).sum(axis=0), (x % _HALF).sum(axis=0)])
                total[d] = total.get(d, 0) + own
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(n), pa.array(high), pa.array(low)],
                                             names=["width", "i", "n", "high", "low"])

    parts = fit_list.select("x").mapInArrow(run, "width int, i int, n long, high long, low long")
    total = parts.groupBy("width", "i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])
    out: dict[int, Fit] = {}
    for w, _, n, high, low in sorted(map(tuple, collect_small(total, "sums"))):
        out.setdefault(w, Fit(int(n), [])).sums.append(int(high) * _HALF + int(low))
    return out


def _solved(fit: Fit, y: np.ndarray) -> np.ndarray:
    for r in fit.factors:
        y = solve(y, r)
    return y


def _project(fit: Fit, y: np.ndarray) -> np.ndarray:
    """Whitened centred rows."""
    return y @ fit.components / np.sqrt(fit.values)


def fit_whitening(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fits of the distinct vectors ``x``, by length."""
    fits = _sums(fit_list)
    open_ = dict(fits)
    for k in range(MOST_PASSES):
        if not open_:
            break
        some = fit_list.where(F.size("x").isin(list(open_))) if len(open_) < len(fits) else fit_list
        for d, gram in _grams(some, fits, _solved).items():
            fit = fits[d]
            alive = np.diag(gram) > DEAD if k else np.ones(d, bool)
            if k and np.abs(gram - np.diag(alive.astype(float))).max() <= CLOSE * d:
                del open_[d]
            elif k == 0:
                if not gram.any():  # one vector alone, or none but equal ones
                    del open_[d]
                    fit.components, fit.values, fit.explained = np.zeros((d, 0)), np.zeros(0), np.zeros(0)
                    continue
                fit.factors.append(cholesky(gram + _shift(fit.n, d, gram) * np.eye(d), 0.0))
            else:
                fit.factors.append(cholesky(gram, DEAD))
    for d, fit in fits.items():
        if fit.components is not None:
            continue
        whole = fit.factors[0]
        for r in fit.factors[1:]:
            whole = r @ whole
        _, sigma, turn = np.linalg.svd(whole)
        values = sigma**2 / fit.n
        m = min(components, int((values > values[0] * (d * np.finfo(float).eps) ** 2).sum()))
        fit.components, fit.values, fit.explained = turn[:m].T, values[:m], values[:m] / values.sum()
    for d, gram in _grams(fit_list, fits, _project).items():  # as measured over all rows
        m = fits[d].components.shape[1]
        fits[d].identity_error = float(np.abs(gram[:m, :m] / fits[d].n - np.eye(m)).max()) if m else 0.0
    return fits


def _deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    far = fit.n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, fit.sums))
    kind = np.int64 if far < 2**31 and len(fit.sums) * far * far < 2**63 else object
    y = x.astype(kind) * fit.n - np.array(fit.sums, kind)
    return [v if v < 2**63 else None for v in (y * y).sum(axis=1).tolist()]


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for
    each usable row and component up to ``components``.

    Rows whose vector is null or holds a null, NaN or infinite entry are
    dropped, as are empty vectors. Each entry becomes floor(256 c), a long (at the ends of that range where it
    is beyond). The fit is over the distinct vectors of a length; rows that
    repeat one, in id or not, each have their own result. Components are numbered by
    falling eigenvalue; equal eigenvalues share their space in any way. There are
    no more components than the vectors' length, and none without variance: a
    length with one distinct vector gives no rows, as an empty table gives none.
    ``deviation`` is null where it is beyond a long. A null id stays null.
    """
    usable = _vectors(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v")), "v").select("id", "x")
    fit_list = written(usable.where(F.size("x") > 0).select("x").distinct(), "whitening-fit")
    fits = fit_whitening(fit_list, components)

    def run(batches):
        for batch in batches:
            for d, at, x in _lists(batch, 1):
                fit = fits[d]
                m = fit.components.shape[1]
                if not m:
                    continue
                z = _project(fit, x - fit.mean)
                each = lambda v: pa.array(np.tile(v, len(x)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(at, m))), each(np.arange(1, m + 1, dtype=np.int32)), each(np.full(m, fit.n)),
                     pa.array([v for v in _deviations(x, fit) for _ in range(m)], pa.int64()), pa.array(z.ravel()), each(fit.explained),
                     each(np.full(m, fit.identity_error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = id_schema(usable, "component int, n long, deviation long, whitened double, explained double, identity_error double")
    return usable.mapInArrow(run, schema).withColumnRenamed("id", id_col)
