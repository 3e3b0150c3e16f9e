"""Kernel support-vector machine on landmarks.

The kernel matrix is replaced by its partial Cholesky factor on a set of
landmarks: rounds of the rows that the landmarks so far represent worst, thinned
out by a pivoted Cholesky of their own, until no row's residual is over the
tolerance. In the features of that factor the dual problem is solved by pairs of
coordinates (the most violating ones, as SMO takes them), in groups of rows side
by side that are dealt anew each round, until the optimality conditions hold over
all rows. The driver has the landmarks, the weights and a few candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import hash_u60
from quarry.operators.small import collect_small
from quarry.session import drop_scratch, scratch_table

RESIDUAL, MOST_LANDMARKS, BLOCK = 1e-3, 2048, 64
GROUP_ROWS, MOST_ROUNDS, VIOLATION = 1000, 30, 1e-3
_STEPS = 100   # of a group and round, for each of its rows


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d2 = a @ b.T
    d2 *= -2.0
    d2 += (a * a).sum(1)[:, None]
    d2 += (b * b).sum(1)[None, :]
    np.maximum(d2, 0.0, out=d2)
    d2 *= -gamma
    return np.exp(d2, out=d2)


class Landmarks:
    """Features z with z(a) z(b)' near the kernel of a and b."""

    def __init__(self, points: np.ndarray, gamma: float) -> None:
        self.points, self.gamma = points, gamma
        m = len(points)  # the pivots are over the tolerance, so the factor is well-conditioned and its inverse exact enough
        self.root = np.linalg.inv(np.linalg.cholesky(rbf(points, points, gamma) + 1e-10 * np.eye(m))).T if m else np.zeros((0, 0))

    def features(self, x: np.ndarray) -> np.ndarray:
        return rbf(x, self.points, self.gamma) @ self.root if len(self.points) else np.zeros((len(x), 0))

    def scorer(self, weights: np.ndarray):
        """What :meth:`features` times the weights is, of a vector for each landmark and not a matrix of them."""
        points, gamma, of_points = self.points, self.gamma, self.root @ weights
        return lambda x: rbf(x, points, gamma) @ of_points if len(points) else np.zeros(len(x))


def pick_landmarks(rows: DataFrame, gamma: float, tolerance: float = RESIDUAL, most: int = MOST_LANDMARKS, block: int = BLOCK,
                   seed: int = 42) -> Landmarks:
    """Landmarks among ``rows`` (id, x) until every row's residual is ``tolerance`` or less."""
    first = rows.select("x").limit(1).collect()
    out = Landmarks(np.zeros((0, len(first[0]["x"]) if first else 0)), gamma)
    while len(out.points) < most:
        now = out

        def residual(batches):
            for pdf in batches:
                for a in range(0, len(pdf), 1024):
                    part = pdf.iloc[a:a + 1024]
                    z = now.features(np.stack(part["x"].to_numpy()))
                    yield pd.DataFrame({"id": part["id"], "x": part["x"], "r": 1.0 - (z * z).sum(1)})

        worst = (rows.select("id", "x").mapInPandas(residual, "id long, x array<double>, r double").where(F.col("r") > tolerance)
                 .orderBy(F.desc("r"), hash_u60(seed, "id"), "id").limit(4 * block).collect())
        if not worst:
            break
        x = np.array([r["x"] for r in worst], float)
        z = now.features(x)
        left = rbf(x, x, gamma) - z @ z.T
        taken = []
        while len(taken) < min(block, most - len(out.points)):
            i = int(np.argmax(np.diag(left)))
            if left[i, i] <= tolerance:
                break
            taken.append(i)
            column = left[:, i] / np.sqrt(left[i, i])
            left = left - np.outer(column, column)
            left[i, i] = -1.0
        if not taken:
            break
        out = Landmarks(np.vstack([out.points, x[taken]]), gamma)
    return out


def solve_pairs(kernel: np.ndarray, y: np.ndarray, alpha: np.ndarray, f: np.ndarray, C: float, tolerance: float = VIOLATION / 10,
                most: int | None = None) -> np.ndarray:
    """The dual variables after steps on the most violating pair, until none
    violates by more than ``tolerance``; ``f`` are the scores at the start."""
    alpha, g, edge = alpha.copy(), y - f, 1e-9 * C  # what is this near a bound counts as on it

    def bounds(i):  # 0 where the score may go up, or down, else infinite
        above, below = alpha[i] > edge, alpha[i] < C - edge
        return np.where(np.where(y[i] > 0, below, above), 0.0, -np.inf), np.where(np.where(y[i] > 0, above, below), 0.0, np.inf)

    up, low = bounds(slice(None))
    for _ in range(most or _STEPS * len(y)):
        i, j = int((g + up).argmax()), int((g + low).argmin())
        gap = (g[i] + up[i]) - (g[j] + low[j])
        if gap <= tolerance:
            break
        step = gap / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min(step, C - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else C - alpha[j])
        alpha[i] = min(max(alpha[i] + y[i] * step, 0.0), C)
        alpha[j] = min(max(alpha[j] - y[j] * step, 0.0), C)
        for changed in (i, j):
            up[changed], low[changed] = bounds(changed)
        g -= step * (kernel[i] - kernel[j])
    return alpha


class KernelMachine:
    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float, rounds: int, violation: float) -> None:
        self.landmarks, self.weights, self.bias, self.rounds, self.violation = landmarks, weights, bias, rounds, violation

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.landmarks.scorer(self.weights)(x) + self.bias

    def predict(self, df: DataFrame, id_col: str, label_col: str = "label", features: str = "x") -> DataFrame:
        """(id, label, pred): 1 for a positive score."""
        rows = df.where(F.col(features).isNotNull()).select(F.col(id_col), F.col(label_col).cast("double").alias(label_col),
                                                            F.col(features).cast("array<double>").alias("_x"))

        score, bias = self.landmarks.scorer(self.weights), self.bias

        def run(batches):
            for pdf in batches:
                for a in range(0, len(pdf), 1024):
                    part = pdf.iloc[a:a + 1024]
                    yield part[[id_col, label_col]].assign(pred=(score(np.stack(part["_x"].to_numpy())) + bias > 0).astype("int32"))

        return rows.mapInPandas(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {label_col} double, pred int")


def fit_rbf_svm(df: DataFrame, id_col: str, label_col: str = "label", features: str = "x", C: float = 1.0, gamma: float = 1.0,
                tolerance: float = VIOLATION, group_rows: int = GROUP_ROWS, seed: int = 42) -> KernelMachine:
    """Soft-margin classifier of the labels 0 and 1 with kernel
    exp(-gamma |a - b|²), hinge loss and a free bias, as the exact dual problem on
    the landmarks' features."""
    rows = df.where(F.col(features).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(features).cast("array<double>").alias("x"),
        F.when(F.col(label_col) == 1, 1.0).otherwise(-1.0).alias("y"), F.lit(0.0).alias("alpha"))
    n, cores = rows.count(), df.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n // group_rows))
    table = scratch_table(rows.repartition(max(1, min(max(cores, groups), n // 128)), "id"), "svm-rows")
    marks = pick_landmarks(table, gamma, seed=seed)
    m = len(marks.points)
    w, bias, violation, rounds = np.zeros(m), 0.0, np.inf, 0
    edge = C * (1e-9 if groups == 1 else 1e-3)  # with several groups what should be at a bound halves its way there

    def bounds(g, y, alpha):
        return (g[((y > 0) & (alpha < C - edge)) | ((y < 0) & (alpha > edge))].max(initial=-np.inf),
                g[((y > 0) & (alpha > edge)) | ((y < 0) & (alpha < C - edge))].min(initial=np.inf))

    def optimum(rows):
        """The bias and by how much the optimality conditions are violated."""
        r = rows.agg(F.max("up").alias("up"), F.min("low").alias("low")).first()
        if not np.isfinite([r["up"], r["low"]]).all():  # one class alone
            return (r["up"] if np.isfinite(r["up"]) else r["low"]), 0.0
        return (r["up"] + r["low"]) / 2, r["up"] - r["low"]

    def weights(batches):
        total = np.zeros(m)
        for pdf in batches:
            total += sum(np.frombuffer(v) for v in pdf["v"])
        yield pd.DataFrame({"i": np.arange(m), "v": total})

    while n and m and rounds < MOST_ROUNDS:
        start = w

        def local(pdf: pd.DataFrame) -> pd.DataFrame:
            k, y, alpha = rbf(np.stack(pdf["x"].to_numpy()), marks.points, gamma), pdf["y"].to_numpy(), pdf["alpha"].to_numpy()
            z = k @ marks.root
            f = z @ start
            up, low = bounds(y - f, y, alpha)
            new = solve_pairs(z @ z.T, y, alpha, f, C, tolerance / 10, _STEPS * len(y))
            alpha = alpha + (new - alpha) / groups  # a mean of the groups' answers is feasible too
            first = np.arange(len(y)) == 0  # has what the group adds up to: its bounds at the start, its part of the new weights
            return pdf.assign(alpha=alpha, v=np.where(first, np.array([((alpha * y) @ k).tobytes()], object), None),
                              up=np.where(first, up, np.nan), low=np.where(first, low, np.nan))[["id", "x", "y", "alpha", "v", "up", "low"]]

        part = F.pmod(F.xxhash64("id", F.lit(rounds)), F.lit(groups))
        new = scratch_table(table.select("id", "x", "y", "alpha", part.alias("part")).repartition(groups, "part").groupBy("part").applyInPandas(
            local, "id long, x array<double>, y double, alpha double, v binary, up double, low double"), "svm-rows")
        sums = new.where(F.col("v").isNotNull())
        bias, violation = optimum(sums)
        if violation <= tolerance:  # at the start of the round
            drop_scratch(new)
            break
        drop_scratch(table)
        table, rounds = new, rounds + 1
        w = np.zeros(m)
        for r in collect_small(sums.select("v").mapInPandas(weights, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")), "weights"):
            w[r["i"]] = r["v"]
        w = marks.root.T @ w
    else:
        if n and m:
            score = marks.scorer(w)

            def ends(batches):
                up, low = -np.inf, np.inf
                for pdf in batches:
                    for a in range(0, len(pdf), 1024):
                        part = pdf.iloc[a:a + 1024]
                        y = part["y"].to_numpy()
                        u, v = bounds(y - score(np.stack(part["x"].to_numpy())), y, part["alpha"].to_numpy())
                        up, low = max(up, u), min(low, v)
                yield pd.DataFrame({"up": [up], "low": [low]})

            bias, violation = optimum(table.select("x", "y", "alpha").mapInPandas(ends, "up double, low double"))
    drop_scratch(table)
    return KernelMachine(marks, w, float(bias), rounds, float(violation))
