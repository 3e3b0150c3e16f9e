"""Linear-model plans: OLS, multi-output OLS, ridge, lasso, elastic net,
fold-wise CV, polynomial regression, PCA, and the regularisation study."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import vec as V
from quarry.functions.hashing import sql_hash_u60
from quarry.operators import gram as G
from quarry.operators import linear as L
from quarry.operators import prep as P
from quarry.operators.ordering import with_global_index  # noqa: F401
from quarry.plans.common import SEED, emb, tbl
from quarry.plans.prep import _synth_sql
from quarry.operators.small import local_frame
from quarry.plans.registry import register

R = 6
LI_X = ["l_quantity", "l_discount", "l_tax"]
RIDGE_ALPHAS = V.logspace(-3, 3, 13)
LASSO_ALPHAS = V.logspace(-3, 1, 9)


def _coef_frame(spark, names, b, w, digits=R):
    rows = [("intercept", float(b))] + [(n, float(c)) for n, c in zip(names, w)]
    return local_frame(spark, rows, "term string, coef double").select("term", F.round("coef", digits).alias("coef"))


@register("mdl_ols", f"""SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), {R}) AS coef FROM lineitem
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), {R}) FROM lineitem""")
def q_mdl_ols(spark, sf):
    """Least squares with intercept from the Gram (one Spark pass, 3x3 solve)."""
    li = tbl(spark, sf, "lineitem").select(F.array("l_quantity").alias("x"), "l_extendedprice")
    b, w = L.ols(G.centred_gram(li, "x", "l_extendedprice"))
    return _coef_frame(spark, ["l_quantity"], b, w)


@register("mdl_ols_multi")
def q_mdl_ols_multi(spark, sf):
    """One-hot targets, no intercept, pseudo-inverse; argmax class on the
    test split: (vec_id, label, pred)."""
    from quarry.operators.centroid import argmax_label
    e = emb(spark, sf)
    tr = e.filter("split = 'train'").withColumn("y", V.onehot("label", 10))
    Gm = G.gram_matrix(G.gram(tr, "x", "y"))
    theta = L.ols_multi(Gm, 64)  # (64 x 10)
    scores = V.linear(F.col("x"), V.lit_matrix(theta.T.tolist()))
    return e.filter("split = 'test'").select("vec_id", "label", argmax_label(scores, list(range(10))).alias("pred"))


def _li_fit(spark, sf, fit):
    li = tbl(spark, sf, "lineitem").select(F.array(*LI_X).alias("x"), "l_extendedprice")
    b, w = fit(G.centred_gram(li, "x", "l_extendedprice"))
    return _coef_frame(spark, LI_X, b, w, 4)


# -- twins: the same three-feature problems, solved in SQL ------------------------

_V = {"p": "l_quantity", "q": "l_discount", "r": "l_tax", "t": "l_extendedprice"}
_PAIRS = ("pp", "pq", "pr", "qq", "qr", "rr", "pt", "qt", "rt", "tt")
_FOLD = f"({sql_hash_u60(SEED, 'l_orderkey')}) % 5"
# means (m*), and centred sums of products per row (two letters), with n rows
_SQL_MOMENTS = "count(*)::DOUBLE AS n, " + ", ".join(f"avg({c}) AS m{v}" for v, c in _V.items()) + ", " + ", ".join(
    f"covar_pop({_V[p[0]]}, {_V[p[1]]}) AS {p}" for p in _PAIRS)


def _sql_ridge(alpha: str) -> str:
    """wp, wq, wr from moments in scope: Cramer's rule on S + alpha / n I."""
    pp, qq, rr = (f"({p} + {alpha} / n)" for p in ("pp", "qq", "rr"))
    det = f"({pp} * ({qq} * {rr} - qr * qr) - pq * (pq * {rr} - qr * pr) + pr * (pq * qr - {qq} * pr))"
    return f"""(pt * ({qq} * {rr} - qr * qr) - pq * (qt * {rr} - qr * rt) + pr * (qt * qr - {qq} * rt)) / {det} AS wp,
       ({pp} * (qt * {rr} - qr * rt) - pt * (pq * {rr} - qr * pr) + pr * (pq * rt - qt * pr)) / {det} AS wq,
       ({pp} * ({qq} * rt - qt * qr) - pq * (pq * rt - qt * pr) + pt * (pq * qr - {qq} * pr)) / {det} AS wr"""


def _sql_descent(source: str, l1: str, l2: str, rounds: int = 60) -> str:
    """Rounds of coordinate descent over the rows of ``source`` (key columns k,
    and moments), as a recursive query ``cd`` with wp, wq, wr."""
    soft = lambda rho, d: f"(sign({rho}) * greatest(abs({rho}) - {l1}, 0.0) / ({d} + {l2}))"
    one = soft("(pt - pq * wq - pr * wr)", "pp")
    two = soft("(qt - pq * np - qr * wr)", "qq")
    three = soft("(rt - pr * np - qr * nq)", "rr")
    return f"""cd AS (SELECT *, 0 AS step, 0.0::DOUBLE AS wp, 0.0::DOUBLE AS wq, 0.0::DOUBLE AS wr FROM {source}
  UNION ALL SELECT * EXCLUDE (np, nq) REPLACE (step + 1 AS step, np AS wp, nq AS wq, {three} AS wr) FROM (
    SELECT *, {two} AS nq FROM (SELECT *, {one} AS np FROM cd WHERE step < {rounds}))),
fit AS (SELECT * FROM cd WHERE step = {rounds})"""


_SQL_COEFS = """SELECT t.term, round(t.coef, 4) + 0.0 AS coef FROM fit, LATERAL (VALUES
  ('intercept', mt - wp * mp - wq * mq - wr * mr), ('l_quantity', wp), ('l_discount', wq), ('l_tax', wr)) t(term, coef)"""


def _sql_enet(alpha: float, l1_ratio: float) -> str:
    return f"""WITH RECURSIVE mo AS (SELECT {_SQL_MOMENTS} FROM lineitem),
{_sql_descent("mo", repr(alpha * l1_ratio), repr(alpha * (1 - l1_ratio)))}
{_SQL_COEFS}"""


# moments of the rows outside each fold (tr) and inside it (te)
_SQL_FOLDS = f"""li AS (SELECT *, {_FOLD} AS fold FROM lineitem),
tr AS (SELECT f.fold AS f, {_SQL_MOMENTS} FROM li, (SELECT DISTINCT fold FROM li) f WHERE li.fold <> f.fold GROUP BY f.fold),
te AS (SELECT fold AS f, {_SQL_MOMENTS} FROM li GROUP BY fold)"""
# held-out error of (wp, wq, wr) and its intercept, from the fold's own moments
_SQL_HELD_OUT = """err AS (SELECT alpha, te.tt + wp * wp * te.pp + wq * wq * te.qq + wr * wr * te.rr
  + 2 * (wp * wq * te.pq + wp * wr * te.pr + wq * wr * te.qr - wp * te.pt - wq * te.qt - wr * te.rt)
  + ((te.mt - fit.mt) - wp * (te.mp - fit.mp) - wq * (te.mq - fit.mq) - wr * (te.mr - fit.mr)) ^ 2 AS mse FROM fit JOIN te USING (f))
SELECT round(alpha, 6) AS alpha, round(avg(mse), 2) AS cv_mse FROM err GROUP BY alpha"""


def _sql_alphas(alphas) -> str:
    return f"al AS (SELECT unnest([{', '.join(map(repr, alphas))}]::DOUBLE[]) AS alpha)"


@register("mdl_ridge", f"""WITH mo AS (SELECT {_SQL_MOMENTS} FROM lineitem), fit AS (SELECT *, {_sql_ridge("1.0")} FROM mo)
{_SQL_COEFS}""")
def q_mdl_ridge(spark, sf):
    """Ridge, alpha = 1 (closed form on the centred Gram)."""
    return _li_fit(spark, sf, lambda g: L.ridge(g, 1.0))


@register("mdl_lasso", _sql_enet(0.1, 1.0))
def q_mdl_lasso(spark, sf):
    """Lasso, alpha = 0.1 (coordinate descent on the centred Gram)."""
    return _li_fit(spark, sf, lambda g: L.elastic_net(g, 0.1, 1.0))


@register("mdl_elastic_net", _sql_enet(0.1, 0.5))
def q_mdl_elastic_net(spark, sf):
    """Elastic net, alpha = 0.1, l1_ratio = 0.5."""
    return _li_fit(spark, sf, lambda g: L.elastic_net(g, 0.1, 0.5))


def _fold_grams(spark, sf):
    li = P.kfold(tbl(spark, sf, "lineitem").select(
        F.array(*LI_X).alias("x"), "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "l_orderkey", 5, SEED)
    return G.centred_grams(li, "x", "l_extendedprice", "fold")


def _path_frame(spark, path):
    return local_frame(spark, path, "alpha double, cv_mse double").select(
        F.round("alpha", R).alias("alpha"), F.round("cv_mse", 2).alias("cv_mse"))


@register("mdl_ridge_cv", f"""WITH {_SQL_FOLDS}, {_sql_alphas(RIDGE_ALPHAS)},
fit AS (SELECT *, {_sql_ridge("alpha")} FROM tr, al),
{_SQL_HELD_OUT}""")
def q_mdl_ridge_cv(spark, sf):
    """Ridge over 13 alphas in 1e-3..1e3 with 5 folds: all fold Grams in one
    pass, 65 small solves; (alpha, mean held-out MSE)."""
    return _path_frame(spark, L.cv_path(_fold_grams(spark, sf), RIDGE_ALPHAS, L.ridge))


@register("mdl_lasso_cv", f"""WITH RECURSIVE {_SQL_FOLDS}, {_sql_alphas(LASSO_ALPHAS)},
paths AS (SELECT * FROM tr, al),
{_sql_descent("paths", "alpha", "0.0")},
{_SQL_HELD_OUT}""")
def q_mdl_lasso_cv(spark, sf):
    """Lasso over 9 alphas in 1e-3..1e1 with 5 folds (coordinate descent)."""
    return _path_frame(spark, L.cv_path_enet(_fold_grams(spark, sf), LASSO_ALPHAS, 1.0, max_iter=5000))


_ALPHA_SQL = ", ".join(repr(a) for a in RIDGE_ALPHAS)


@register("top_best_alpha", f"""WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, ({sql_hash_u60(SEED, 'p_partkey')}) % 5 AS fold FROM part),
fs AS (SELECT fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM p GROUP BY fold),
tot AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM fs),
a AS (SELECT unnest([{_ALPHA_SQL}]::DOUBLE[]) AS alpha),
tr AS (SELECT fs.*, a.alpha, tot.n - fs.n AS tn, tot.sx - fs.sx AS tsx, tot.sy - fs.sy AS tsy,
              tot.sxx - fs.sxx AS tsxx, tot.sxy - fs.sxy AS tsxy FROM fs, tot, a),
fit AS (SELECT *, ((tsxy - tsx * tsy / tn) / ((tsxx - tsx * tsx / tn) + alpha)) AS w FROM tr),
fit2 AS (SELECT *, tsy / tn - w * tsx / tn AS b FROM fit),
m AS (SELECT alpha, fold, (syy - 2 * b * sy - 2 * w * sxy + n * b * b + 2 * b * w * sx + w * w * sxx) / n AS mse FROM fit2),
cv AS (SELECT alpha, avg(mse) AS cv_mse FROM m GROUP BY alpha)
SELECT round(alpha, {R}) AS alpha, round(cv_mse, 2) AS cv_mse FROM (SELECT * FROM cv ORDER BY cv_mse, alpha LIMIT 1)""")
def q_top_best_alpha(spark, sf):
    """Best ridge alpha for price ~ size by 5-fold CV (one-pass fold sums)."""
    p = P.kfold(tbl(spark, sf, "part").select(F.array(F.col("p_size").cast("double")).alias("x"), "p_retailprice", "p_partkey"),
                "p_partkey", 5, SEED)
    grams = G.centred_grams(p, "x", "p_retailprice", "fold")
    a, mse = L.best_alpha(L.cv_path(grams, RIDGE_ALPHAS, L.ridge))
    return local_frame(spark, [(a, mse)], "alpha double, cv_mse double").select(
        F.round("alpha", R).alias("alpha"), F.round("cv_mse", 2).alias("cv_mse"))


_QX, _QN = _synth_sql("o_orderkey")
_QXX = f"({_QX} * 2.0 - 2.0)"


@register("mdl_poly_regression", f"""WITH d AS (SELECT {_QXX} AS x, 0.5 * {_QXX} * {_QXX} + 0.3 * {_QXX} + 0.1 * ({_QN}) AS y FROM orders),
lin AS (SELECT regr_intercept(y, x) AS b, regr_slope(y, x) AS w FROM d),
mo AS (SELECT avg(x) AS m1, avg(x * x) AS m2, avg(y) AS my,
              covar_pop(x, x) AS s11, covar_pop(x, x * x) AS s12, covar_pop(x * x, x * x) AS s22,
              covar_pop(x, y) AS c1, covar_pop(x * x, y) AS c2 FROM d),
q AS (SELECT (s22 * c1 - s12 * c2) / (s11 * s22 - s12 * s12) AS w1, (s11 * c2 - s12 * c1) / (s11 * s22 - s12 * s12) AS w2, m1, m2, my FROM mo),
q2 AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS b FROM q)
SELECT 'linear' AS model, round(avg((y - b - w * x) ^ 2), {R}) AS mse FROM d, lin
UNION ALL SELECT 'poly2', round(avg((y - b - w1 * x - w2 * x * x) ^ 2), {R}) FROM d, q2""")
def q_mdl_poly_regression(spark, sf):
    """Quadratic data y = 0.5x² + 0.3x + N(0, 0.1²), x uniform in [-2, 2)
    (one seeded row per order): linear fit vs degree-2 fit, in-sample MSE."""
    from quarry.plans.prep import _synth_cols
    x01, noise = _synth_cols("o_orderkey")
    x = x01 * 2.0 - 2.0
    d = tbl(spark, sf, "orders").select(x.alias("x"), (0.5 * x * x + 0.3 * x + 0.1 * noise).alias("y"))
    out = []
    for name, feats in (("linear", F.array("x")), ("poly2", P.poly2(F.array("x")))):
        df = d.select(feats.alias("f"), "y")
        b, w = L.ols(G.centred_gram(df, "f", "y"))
        pred = F.lit(float(b)) + V.dot("f", V.lit_vector(w))
        out.append(df.agg(F.avg(F.pow(F.col("y") - pred, 2)).alias("mse")).select(F.lit(name).alias("model"), "mse"))
    return out[0].unionByName(out[1]).select("model", F.round("mse", R).alias("mse"))


def _pca(spark, sf, k=2):
    e = emb(spark, sf)
    Gm = G.centred_gram(e, "x")
    shift, Gm = Gm.shift[1:], np.asarray(Gm)
    n = Gm[0, 0]
    mu = Gm[0, 1:] / n
    cov = (Gm[1:, 1:] - n * np.outer(mu, mu)) / (n - 1)
    mu = mu + shift
    vals, vecs = L.pca_from_cov(cov, k)
    return e, mu, cov, vals, vecs


@register("mdl_pca")
def q_mdl_pca(spark, sf):
    """2 principal components of the centred vectors (eigh of the Gram-based
    covariance, signs fixed): (vec_id, pc1, pc2)."""
    e, mu, cov, vals, vecs = _pca(spark, sf)
    c = V.sub("x", V.lit_vector(mu))
    z = V.linear(c, V.lit_matrix(vecs.T.tolist()))
    return e.select("vec_id", F.round(F.element_at(z, 1), R).alias("pc1"), F.round(F.element_at(z, 2), R).alias("pc2"))


@register("agg_explained_var")
def q_agg_explained_var(spark, sf):
    """Share of variance of each of the first 10 components."""
    e, mu, cov, vals, vecs = _pca(spark, sf, 10)
    tot = float(np.trace(cov))
    return local_frame(spark, [(i + 1, float(v), float(v / tot)) for i, v in enumerate(vals)],
                                 "component int, variance double, ratio double")


@register("mdl_pca_inverse")
def q_mdl_pca_inverse(spark, sf):
    """Back-projection of the 2-D scores, x̂ = z Pᵀ + μ, and the
    reconstruction error of every vector."""
    e, mu, cov, vals, vecs = _pca(spark, sf)
    c = V.sub("x", V.lit_vector(mu))
    z = V.linear(c, V.lit_matrix(vecs.T.tolist()))
    xhat = V.add(V.linear(z, V.lit_matrix(vecs.tolist())), V.lit_vector(mu))
    return e.select("vec_id", V.round_array(xhat, R).alias("xhat"), F.round(V.euclid("x", xhat), R).alias("error"))


@register("mdl_regularisation_study")
def q_mdl_regularisation_study(spark, sf):
    """Classes 0/1 as a regression target: stratified 30 % split, scaling
    fitted on train, OLS vs RidgeCV vs LassoCV (5 folds, Grams in one pass),
    predictions clipped to [0, 1] for RMSE, thresholded at 0.5 for accuracy,
    coefficient sparsity and the chosen alpha."""
    from quarry.plans.prep import SEED as S
    e = emb(spark, sf).filter(F.col("label").isin(0, 1)).drop("split")
    e = P.exact_split(e, "vec_id", 0.3, S, by="label")
    tr = e.filter("split = 'train'")
    mu, sd = P.standardize_vectors_fit(tr)
    z = P.standardize_vectors_apply(e, mu, sd).withColumn("y", F.col("label").cast("double"))
    z = P.kfold(z, "vec_id", 5, S)
    grams = G.centred_grams(z.filter("split = 'train'"), "xz", "y", "fold")
    total = sum(grams.values())
    ra, _ = L.best_alpha(L.cv_path(grams, RIDGE_ALPHAS, L.ridge))
    la, _ = L.best_alpha(L.cv_path_enet(grams, LASSO_ALPHAS, 1.0))
    fits = {"OLS": (L.ols(total), None), "RidgeCV": (L.ridge(total, ra), ra),
            "LassoCV": (L.elastic_net(total, la, 1.0), la)}
    test = z.filter("split = 'test'")
    parts = []
    for name, ((b, w), alpha) in fits.items():
        pred = F.lit(float(b)) + V.dot("xz", V.lit_vector(w))
        t = test.select("y", pred.alias("p"))
        parts.append(t.agg(F.avg(((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("double")).alias("accuracy"),
                           F.sqrt(F.avg(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p"))) - F.col("y"), 2))).alias("rmse"))
                     .select(F.lit(name).alias("model"), "accuracy", "rmse",
                             F.lit(float(np.mean(np.asarray(w) == 0))).alias("sparsity"),
                             F.lit(alpha).cast("double").alias("alpha")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("agg_mse_rmse", """WITH f AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS b, regr_slope(l_extendedprice, l_quantity) AS w FROM lineitem),
p AS (SELECT l_extendedprice AS y, b + w * l_quantity AS pred FROM lineitem, f)
SELECT round(avg((pred - y) ^ 2), 2) AS mse, round(sqrt(avg((pred - y) ^ 2)), 6) AS rmse,
       round(sqrt(avg((greatest(0.0, least(50000.0, pred)) - y) ^ 2)), 6) AS rmse_clipped FROM p""")
def q_agg_mse_rmse(spark, sf):
    """MSE and RMSE of the one-feature OLS fit, plus RMSE of predictions
    clipped to a range ([0, 50000] here)."""
    from quarry.operators import metrics as M
    li = tbl(spark, sf, "lineitem").select(F.array("l_quantity").alias("x"), "l_quantity", F.col("l_extendedprice").alias("y"))
    b, w = L.ols(G.centred_gram(li, "x", "y"))
    p = li.select("y", (F.lit(float(b)) + F.lit(float(w[0])) * F.col("l_quantity")).alias("pred"))
    p = p.withColumn("pc", F.greatest(F.lit(0.0), F.least(F.lit(50000.0), F.col("pred"))))
    m = M.mse_rmse(p, "y", "pred")
    mc = M.mse_rmse(p, "y", "pc").select(F.col("rmse").alias("rmse_clipped"))
    from quarry.operators.stats import _one_row_concat
    return _one_row_concat(m, mc).select(F.round("mse", 2).alias("mse"), F.round("rmse", R).alias("rmse"),
                                         F.round("rmse_clipped", R).alias("rmse_clipped"))
