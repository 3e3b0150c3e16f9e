"""Linear models solved from the augmented Gram matrix.

The n-sized work is one Spark aggregation (:func:`quarry.operators.gram.gram`);
what reaches the driver is a (d+2)² matrix, and every solve below is a d x d
problem. Conventions follow the usual library definitions:

* OLS with intercept = least squares on centred data;
* ridge: ||y - Xw - b||² + α||w||², intercept not penalised;
* lasso / elastic net: 1/(2n)||y - Xw - b||² + α·l1·||w||₁ + α(1-l1)/2·||w||²,
  by cyclic coordinate descent on the centred Gram;
* k-fold CV: Grams per fold in the same single pass; training Gram = total
  minus fold; held-out MSE from the fold's own Gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Moments:
    n: float
    mx: np.ndarray      # feature means (d)
    my: float
    sxx: np.ndarray     # centred XᵀX (d x d)
    sxy: np.ndarray     # centred Xᵀy (d)
    syy: float


def moments(G: np.ndarray) -> Moments:
    """Centred moments from the Gram of Z = [1, x_1..x_d, y], or of Z - shift."""
    shift = getattr(G, "shift", None)
    G = np.asarray(G)
    n = G[0, 0]
    d = G.shape[0] - 2
    sx, sy = G[0, 1:d + 1], G[0, d + 1]
    mx, my = sx / n, sy / n
    sxx = G[1:d + 1, 1:d + 1] - n * np.outer(mx, mx)
    sxy = G[1:d + 1, d + 1] - n * mx * my
    syy = G[d + 1, d + 1] - n * my * my
    if shift is not None:
        mx, my = mx + shift[1:d + 1], my + shift[d + 1]
    return Moments(n, mx, my, sxx, sxy, syy)


def ols(G: np.ndarray, fit_intercept: bool = True) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) by least squares (minimum-norm if singular)."""
    d = G.shape[0] - 2
    if not fit_intercept:
        w = np.linalg.lstsq(G[1:d + 1, 1:d + 1], G[1:d + 1, d + 1], rcond=None)[0]
        return 0.0, w
    m = moments(G)
    w = np.linalg.lstsq(m.sxx, m.sxy, rcond=None)[0]
    return float(m.my - m.mx @ w), w


def ols_multi(G: np.ndarray, d: int) -> np.ndarray:
    """No-intercept multi-output least squares: pinv(XᵀX) XᵀY, (d x m).
    ``G`` is the Gram of [1, x (d), Y (m)]."""
    G = np.asarray(G)
    xtx = G[1:d + 1, 1:d + 1]
    xty = G[1:d + 1, d + 1:]
    return np.linalg.pinv(xtx) @ xty


def ridge(G: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    m = moments(G)
    d = m.sxx.shape[0]
    w = np.linalg.solve(m.sxx + alpha * np.eye(d), m.sxy)
    return float(m.my - m.mx @ w), w


def elastic_net(G: np.ndarray, alpha: float, l1_ratio: float = 1.0, max_iter: int = 5000,
                tol: float = 1e-10, w0: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Coordinate descent on the centred Gram (l1_ratio=1 is the lasso);
    ``w0`` warm-starts it (the minimiser is unique for alpha > 0)."""
    m = moments(G)
    n, d = m.n, m.sxx.shape[0]
    A, c = m.sxx / n, m.sxy / n
    w = np.zeros(d) if w0 is None else np.array(w0, dtype=float)
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    for _ in range(max_iter):
        delta = 0.0
        for j in range(d):
            if A[j, j] == 0:
                continue
            rho = c[j] - A[j] @ w + A[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (A[j, j] + l2)
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        if delta < tol:
            break
    return float(m.my - m.mx @ w), w


def heldout_mse(G_fold: np.ndarray, b: float, w: np.ndarray) -> float:
    """Mean squared error of (b, w) on the rows summarised by a Gram."""
    d = G_fold.shape[0] - 2
    shift = getattr(G_fold, "shift", None)
    G_fold = np.asarray(G_fold)
    if shift is not None:  # the same residuals, seen from the shifted origin
        b = b + w @ shift[1:d + 1] - shift[d + 1]
    beta = np.concatenate([[b], w])
    zz = G_fold[:d + 1, :d + 1]
    zy = G_fold[:d + 1, d + 1]
    yy = G_fold[d + 1, d + 1]
    rss = yy - 2.0 * beta @ zy + beta @ zz @ beta
    return float(rss / G_fold[0, 0])


def cv_path(fold_grams: dict, alphas, fit) -> list[tuple[float, float]]:
    """(alpha, mean held-out MSE over folds) for every alpha; ``fit(G, a)``
    returns (b, w). Training Gram of fold f = Σ Grams - Gram_f."""
    total = sum(fold_grams.values())
    out = []
    for a in alphas:
        errs = []
        for f, Gf in sorted(fold_grams.items()):
            b, w = fit(total - Gf, a)
            errs.append(heldout_mse(Gf, b, w))
        out.append((float(a), float(np.mean(errs))))
    return out


def cv_path_enet(fold_grams: dict, alphas, l1_ratio: float = 1.0, max_iter: int = 5000) -> list[tuple[float, float]]:
    """Like :func:`cv_path` for lasso / elastic net, walking the alphas from
    large to small with warm starts in every fold."""
    total = sum(fold_grams.values())
    errs: dict = {float(a): [] for a in alphas}
    for f, Gf in sorted(fold_grams.items()):
        w = None
        for a in sorted(alphas, reverse=True):
            b, w = elastic_net(total - Gf, a, l1_ratio, max_iter, w0=w)
            errs[float(a)].append(heldout_mse(Gf, b, w))
    return [(float(a), float(np.mean(errs[float(a)]))) for a in alphas]


def best_alpha(path: list[tuple[float, float]]) -> tuple[float, float]:
    """Smallest CV error; ties -> smallest alpha."""
    return min(path, key=lambda t: (t[1], t[0]))


def pca_from_cov(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top-k eigenpairs (descending) of a covariance; each component's sign
    fixed so its largest-magnitude loading is positive."""
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    for j in range(vecs.shape[1]):
        i = np.argmax(np.abs(vecs[:, j]))
        if vecs[i, j] < 0:
            vecs[:, j] = -vecs[:, j]
    return vals[:k], vecs[:, :k]
