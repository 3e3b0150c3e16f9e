"""The landmark machine against an exact kernel solve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import kernel as K
from quarry.operators import models as MD


def _exact(x, y, gamma, C=1.0):
    k = K.rbf(x, x, gamma)
    a = K.solve_pairs(k, y, np.zeros(len(y)), np.zeros(len(y)), C, 1e-5)
    g = y - k @ (a * y)
    up = g[((y > 0) & (a < C - 1e-9)) | ((y < 0) & (a > 1e-9))].max()
    low = g[((y > 0) & (a > 1e-9)) | ((y < 0) & (a < C - 1e-9))].min()
    assert up - low < 1e-4 and abs((a * y).sum()) < 1e-9
    return lambda z: K.rbf(z, x, gamma) @ (a * y) + (up + low) / 2


def _frame(spark, x, y):
    return spark.createDataFrame([(i, float(c), v) for i, (c, v) in enumerate(zip(y, x.tolist()))], "id long, label double, x array<double>")


def test_pairs_solve_the_dual():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = np.where((x**2).sum(1) > 1.2, 1.0, -1.0)
    f = _exact(x, y, 1.0, C=10.0)
    assert ((f(x) > 0) == (y > 0)).mean() > 0.95


@pytest.mark.parametrize("group_rows", [1000, 130])
def test_landmarks_agree_with_the_exact_kernel(spark, monkeypatch, group_rows):
    if group_rows < 1000:  # several groups: fewer rounds, near the optimum
        monkeypatch.setattr(K, "MOST_ROUNDS", 12)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = ((x**2).sum(1) + 0.5 * rng.normal(size=400) > 2.5).astype(int)
    machine = K.fit_rbf_svm(_frame(spark, x[:250], y[:250]), "id", gamma=0.4, group_rows=group_rows)
    exact = _exact(x[:250], 2.0 * y[:250] - 1, 0.4)
    assert machine.violation <= K.VIOLATION or group_rows < 1000
    pred = {r["id"]: r["pred"] for r in machine.predict(_frame(spark, x, y), "id").collect()}
    assert np.mean([pred[i] == (v > 0) for i, v in enumerate(exact(x))]) >= 0.98


def test_agreement_on_the_embeddings(spark):
    """Classes 0 and 1 of sf0.1."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("label < 2")
    e = e.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    train, test = e.where("id % 10 < 7"), e.where("id % 10 >= 7")
    gamma = MD.rbf_gamma_scale(train, "x")
    machine = K.fit_rbf_svm(train, "id", gamma=gamma)
    rows, asked = train.orderBy("id").collect(), test.collect()
    f = _exact(np.array([r["x"] for r in rows]), np.array([2 * r["label"] - 1 for r in rows]), gamma)
    pred = {r["id"]: r["pred"] for r in machine.predict(test, "id").collect()}
    assert np.mean([pred[r["id"]] == (v > 0) for r, v in zip(asked, f(np.array([r["x"] for r in asked])))]) >= 0.98


def test_edge_cases(spark):
    x = np.ones((6, 2))
    assert {r["pred"] for r in K.fit_rbf_svm(_frame(spark, x, np.ones(6)), "id").predict(_frame(spark, x, np.ones(6)), "id").collect()} == {1}
    assert {r["pred"] for r in K.fit_rbf_svm(_frame(spark, x, np.zeros(6)), "id").predict(_frame(spark, x, np.ones(6)), "id").collect()} == {0}
    assert K.fit_rbf_svm(_frame(spark, x[:0], []), "id").predict(_frame(spark, x, np.ones(6)), "id").count() == 6


def test_scorer_is_the_features_times_the_weights():
    rng = np.random.default_rng(3)
    marks, w = K.Landmarks(rng.normal(size=(40, 3)), 0.7), rng.normal(size=40)
    x = rng.normal(size=(25, 3))
    assert np.allclose(marks.scorer(w)(x), marks.features(x) @ w)
    assert K.Landmarks(np.zeros((0, 3)), 0.7).scorer(np.zeros(0))(x).tolist() == [0.0] * 25


def test_rounds_are_spread_over_tasks_and_conditions_hold(spark, monkeypatch):
    files, plain = [], K.scratch_table

    def seen(df, name):
        out = plain(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(K, "scratch_table", seen)
    monkeypatch.setattr(K, "MOST_ROUNDS", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    y = ((x**2).sum(1) > 2.5).astype(int)
    machine = K.fit_rbf_svm(_frame(spark, x, y).coalesce(1), "id", gamma=0.4, group_rows=100)
    assert machine.rounds == 3 and min(files) >= 3  # neither the rows nor the groups of a round meet in a task or two
    monkeypatch.undo()
    alone = K.fit_rbf_svm(_frame(spark, x, y), "id", gamma=0.4)  # one group: the conditions are looked at at the start of the next round
    assert alone.violation <= K.VIOLATION and alone.rounds >= 1
    a = _exact(x, 2.0 * y - 1, 0.4)(x)
    assert np.mean((alone.scores(x) > 0) == (a > 0)) > 0.98
