"""Properties of the fitted models and the metric tables."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import gram as G
from quarry.operators import linear as L
from quarry.operators import metrics as M


def _data(spark, n=400, d=4, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    w = np.array([1.5, 0.0, -2.0, 0.5])[:d]
    y = 3.0 + X @ w + rng.normal(scale=0.1, size=n)
    df = spark.createDataFrame([(X[i].tolist(), float(y[i])) for i in range(n)], "x array<double>, y double")
    return X, y, G.gram_matrix(G.gram(df, "x", "y"))


def test_ols_matches_lstsq(spark):
    X, y, Gm = _data(spark)
    b, w = L.ols(Gm)
    ref = np.linalg.lstsq(np.hstack([np.ones((len(X), 1)), X]), y, rcond=None)[0]
    assert np.allclose([b, *w], ref, atol=1e-9)


def test_ridge_limits_and_shrinkage(spark):
    _, _, Gm = _data(spark)
    b0, w0 = L.ols(Gm)
    assert np.allclose(L.ridge(Gm, 1e-10)[1], w0, atol=1e-8)
    norms = [np.linalg.norm(L.ridge(Gm, a)[1]) for a in (0.1, 10, 1000)]
    assert norms[0] > norms[1] > norms[2]


def test_lasso_sparsity_grows(spark):
    _, _, Gm = _data(spark)
    zeros = [int(np.sum(L.elastic_net(Gm, a, 1.0)[1] == 0)) for a in (1e-3, 0.3, 5.0)]
    assert zeros[0] <= zeros[1] <= zeros[2] and zeros[2] == 4


def test_lasso_matches_subgradient_conditions(spark):
    X, y, Gm = _data(spark)
    a = 0.1
    b, w = L.elastic_net(Gm, a, 1.0)
    r = y - b - X @ w
    g = X.T @ r / len(y)
    for j in range(len(w)):
        if w[j] != 0:
            assert abs(g[j] - a * np.sign(w[j])) < 1e-6
        else:
            assert abs(g[j]) <= a + 1e-6


def test_cv_uses_fold_grams(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 3))
    y = X @ np.array([1.0, -1.0, 0.5]) + rng.normal(size=300)
    folds = rng.integers(0, 5, 300)
    df = spark.createDataFrame([(X[i].tolist(), float(y[i]), int(folds[i])) for i in range(300)],
                               "x array<double>, y double, fold int")
    grams = G.gram_matrices(G.gram(df, "x", "y", by=["fold"]), "fold")
    path = dict(L.cv_path(grams, [0.5], L.ridge))
    errs = []
    for f in range(5):
        tr, te = folds != f, folds == f
        Xc = X[tr] - X[tr].mean(0)
        w = np.linalg.solve(Xc.T @ Xc + 0.5 * np.eye(3), Xc.T @ (y[tr] - y[tr].mean()))
        b = y[tr].mean() - X[tr].mean(0) @ w
        errs.append(np.mean((y[te] - b - X[te] @ w) ** 2))
    assert abs(path[0.5] - np.mean(errs)) < 1e-9


def test_confusion_keeps_zero_cells_and_unpredicted_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, pred int")
    conf = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion(df).collect()}
    assert len(conf) == 9 and conf[(2, 2)] == 0 and conf[(2, 1)] == 1
    rep = {r["cls"]: r for r in M.class_report(M.confusion(df)).collect()}
    assert rep["2"]["precision"] == 0.0 and rep["2"]["f1"] == 0.0
    assert abs(rep["accuracy"]["f1"] - 0.5) < 1e-12


def test_mcc_known_values(spark):
    perfect = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "label int, pred int")
    assert abs(M.mcc(M.confusion(perfect)).first()[0] - 1.0) < 1e-12
    one_class = spark.createDataFrame([(1, 1), (1, 1)], "label int, pred int")
    assert M.mcc(M.confusion(one_class)).first()[0] == 0.0


def test_votes_break_ties_to_smallest(spark):
    p = spark.createDataFrame([(1, 2), (1, 0), (2, 1), (2, 1), (2, 0)], "vec_id long, pred int")
    v = {r["vec_id"]: r["pred"] for r in M.hard_vote(p).collect()}
    assert v == {1: 0, 2: 1}


def test_early_stopping_history(spark):
    from quarry.operators.history import best_so_far
    vals = [0.5, 0.6, 0.6, 0.55, 0.61, 0.6, 0.6, 0.6, 0.7]
    h = spark.createDataFrame([(0, i + 1, v) for i, v in enumerate(vals)], "run int, epoch int, f1 double")
    rows = sorted(best_so_far(h, "run", "epoch", "f1").collect(), key=lambda r: r["epoch"])
    assert [r["stale"] for r in rows] == [0, 0, 1, 2, 0, 1, 2, 3, 0]
    assert [r["epoch"] for r in rows if r["stop"]] == [8]


def test_standardize_constant_column(spark):
    from quarry.operators.prep import standardize_apply, standardize_fit
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    st = standardize_fit(df, ["a", "b"])
    r = standardize_apply(df, st).collect()
    assert [x["a_z"] for x in r] == [0.0, 0.0] and [x["b_z"] for x in r] == [-1.0, 1.0]


def test_kmeans_inertia_falls_with_k(spark):
    from quarry.operators.cluster import lloyd_sweep
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(c, 0.3, (40, 2)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "vec_id long, x array<double>")
    starts = {k: [X[i].tolist() for i in (0, 40, 80, 20)[:k]] for k in (2, 3, 4)}
    res = {r["k"]: r for r in lloyd_sweep(df, "vec_id", starts).collect()}
    assert res[2]["inertia"] > res[3]["inertia"] > res[4]["inertia"]
    assert res[3]["silhouette"] > res[4]["silhouette"]


def test_empty_input(spark):
    e = spark.createDataFrame([], "label int, pred int")
    assert M.accuracy(e).first()["n"] == 0
    assert M.confusion(e).count() == 0


def test_segmented_history_equals_window_version(spark):
    from quarry.operators.history import best_so_far, best_so_far_segmented
    rng = np.random.default_rng(11)
    runs = np.concatenate([np.zeros(300, int), rng.integers(1, 6, 100)])  # run 0 holds 3/4 of the rows
    vals = np.round(rng.normal(size=len(runs)), 2)
    pdf = [(int(r), int(i), float(v)) for i, (r, v) in enumerate(zip(runs, vals))]
    h = spark.createDataFrame(pdf, "run int, t long, f1 double")
    seg = best_so_far_segmented(h, "run", ["t"], "f1", segment_rows=37)  # many segments per run
    from pyspark.sql import Window
    ref = best_so_far(h.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("t"))), "run", "epoch", "f1")
    cols = ["run", "epoch", "improved", "best_so_far", "stale", "stop"]
    a = sorted(tuple(r) for r in seg.select(*cols).collect())
    b = sorted(tuple(r) for r in ref.select(*cols).collect())
    assert a == b


def test_poly_beats_linear_on_quadratic_data(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    r = {x["model"]: x["mse"] for x in E.queries()["mdl_poly_regression"](spark, SF_SMALL).collect()}
    assert r["poly2"] < r["linear"]
    assert abs(r["poly2"] - 0.01) < 0.005  # noise variance 0.1^2


def test_gram_ols_equals_spark_normal_solver(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    X, y, Gm = _data(spark, n=300, d=3, seed=9)
    b, w = L.ols(Gm)
    df = spark.createDataFrame([(X[i].tolist(), float(y[i])) for i in range(len(y))], "x array<double>, y double")
    m = LinearRegression(featuresCol="f", labelCol="y", solver="normal", regParam=0.0).fit(
        df.withColumn("f", array_to_vector("x")))
    assert np.allclose([b, *w], [m.intercept, *m.coefficients.toArray()], atol=1e-8)


def test_pca_matches_numpy_up_to_sign(spark):
    rng = np.random.default_rng(12)
    X = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(x.tolist(),) for x in X], "x array<double>")
    Gm = G.gram_matrix(G.gram(df, "x"))
    n = Gm[0, 0]
    mu = Gm[0, 1:] / n
    cov = (Gm[1:, 1:] - n * np.outer(mu, mu)) / (n - 1)
    vals, vecs = L.pca_from_cov(cov, 2)
    ev, evec = np.linalg.eigh(np.cov(X.T))
    order = np.argsort(ev)[::-1][:2]
    assert np.allclose(vals, ev[order])
    for j in range(2):
        assert np.allclose(np.abs(vecs[:, j]), np.abs(evec[:, order[j]]), atol=1e-8)
        assert vecs[np.argmax(np.abs(vecs[:, j])), j] > 0


def test_knn_ties_break_on_id(spark):
    from quarry.operators.neighbors import knn
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, x array<double>")
    r = spark.createDataFrame([(5, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [-1.0, 0.0]), (1, [0.0, -1.0]), (7, [2.0, 0.0])],
                              "rid long, x array<double>")
    got = [x["rid"] for x in sorted(knn(q, r, 3, "qid", "rid").collect(), key=lambda x: x["rank"])]
    assert got == [1, 3, 5]


def test_warm_started_lasso_path_equals_cold_fits(spark):
    rng = np.random.default_rng(13)
    X = rng.normal(size=(300, 6))
    y = X @ np.array([2.0, 0.0, 0.0, -1.0, 0.5, 0.0]) + rng.normal(size=300)
    folds = rng.integers(0, 4, 300)
    df = spark.createDataFrame([(X[i].tolist(), float(y[i]), int(folds[i])) for i in range(300)],
                               "x array<double>, y double, fold int")
    grams = G.gram_matrices(G.gram(df, "x", "y", by=["fold"]), "fold")
    alphas = [1e-3, 1e-2, 0.1, 1.0]
    warm = dict(L.cv_path_enet(grams, alphas, 1.0))
    cold = dict(L.cv_path(grams, alphas, lambda g, a: L.elastic_net(g, a, 1.0)))
    for a in alphas:
        assert abs(warm[a] - cold[a]) < 1e-8


def test_large_means_lose_no_digits(spark):
    rng = np.random.default_rng(21)
    x = 1e7 + rng.normal(size=400)
    y = 3.0 * (x - 1e7) + 1e8 + 0.01 * rng.normal(size=400)
    folds = rng.integers(0, 4, 400)
    df = spark.createDataFrame([([float(a)], float(b), int(f)) for a, b, f in zip(x, y, folds)], "x array<double>, y double, fold int")
    _, w = L.ols(G.centred_gram(df, "x", "y"))
    want = np.polyfit(x - 1e7, y - 1e8, 1)[0]
    assert abs(w[0] - want) < 1e-8
    grams = G.centred_grams(df, "x", "y", "fold")
    path = dict(L.cv_path(grams, [1e-9], L.ridge))
    errs = []
    for f in range(4):
        a, b = np.polyfit(x[folds != f] - 1e7, y[folds != f] - 1e8, 1)
        errs.append(np.mean((y[folds == f] - 1e8 - a * (x[folds == f] - 1e7) - b) ** 2))
    assert abs(path[1e-9] - np.mean(errs)) < 1e-9


def test_ensembles_fit_in_full(spark, monkeypatch):
    import __spark_entry__ as E
    from quarry.plans import ensemble
    from tests.conftest import SF_SMALL
    seen = {}

    def one_vs_rest(estimator, train, parallelism=8):
        seen["voting"] = estimator.getMaxIter()
        raise InterruptedError

    def boosting(train, id_col, **options):
        seen["boosting"] = options
        raise InterruptedError

    monkeypatch.setattr(ensemble.MD, "one_vs_rest", one_vs_rest)
    monkeypatch.setattr(ensemble.TR, "fit_boosting", boosting)
    for name in ("mdl_boosting", "mdl_voting"):
        try:
            E.queries()[name](spark, SF_SMALL)
        except InterruptedError:
            pass
    assert seen == {"boosting": {"rounds": 20, "max_depth": 5}, "voting": 100}
