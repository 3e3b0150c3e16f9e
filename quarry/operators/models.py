"""Spark ML estimators with the reference's settings, plus the ensemble
pieces Spark lacks (hard/soft voting, out-of-fold stacking); bagged and boosted trees are in
:mod:`quarry.operators.trees`.

Library parameter mappings (regularisation written per-sample in Spark):
* logistic, C = 1: regParam = 1 / (C n), no standardisation;
* linear SVM, C = 1: regParam = 1 / (C n); the RBF one is in
  :mod:`quarry.operators.kernel`, with gamma = 1 / (d var(X)).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import trees as TR
from quarry.session import cut_lineage, scratch_table

SPARK_TREE_ROWS = 1 << 14  # beyond these a tree isn't Spark's, which passes over all rows for every so many nodes


def with_vector(df: DataFrame, arr: str = "x", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(arr).cast("array<double>")))


def logistic(train: DataFrame, C: float = 1.0, max_iter: int = 200, label: str = "label"):
    n = train.count()
    return LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=1.0 / (C * n),
                              elasticNetParam=0.0, standardization=False, family="multinomial").fit(train)


def linear_svm(train: DataFrame, C: float = 1.0, label: str = "label", max_iter: int = 100):
    n = train.count()
    return LinearSVC(featuresCol="features", labelCol=label, regParam=1.0 / (C * n), maxIter=max_iter).fit(train)


def svm_estimator(train: DataFrame, C: float = 1.0, max_iter: int = 100):
    return LinearSVC(featuresCol="features", labelCol="label", regParam=1.0 / (C * train.count()), maxIter=max_iter)


def fit_rows(train: DataFrame) -> DataFrame:
    """The columns that a fit reads, kept for its many passes; unpersist after."""
    return train.select("features", "label").persist()


def one_vs_rest(estimator, train: DataFrame, parallelism: int = 8):
    """A two-class estimator for any number of classes, the fits side by side."""
    return OneVsRest(classifier=estimator, featuresCol="features", labelCol="label", parallelism=parallelism).fit(train)


def rbf_gamma_scale(df: DataFrame, x: str) -> float:
    """gamma = 1 / (d * var(X)) over all coordinates."""
    r = df.select(F.explode(x).alias("v")).agg(F.var_pop("v").alias("v"), F.count("*").alias("n")).first()
    d = len(df.select(x).first()[0])
    return 1.0 / (d * r["v"]) if r["v"] else 1.0


def tree(train: DataFrame, label: str = "label", max_depth: int = 30, seed: int = 42):
    return DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=max_depth, seed=seed).fit(train)


def tree_predictions(train: DataFrame, test: DataFrame, id_col: str, label: str = "label", x: str = "x", seed: int = 42) -> DataFrame:
    """(id, label, pred) by one tree of depth 30 on every row (``features``, and ``x``: the array)."""
    if train.count() <= SPARK_TREE_ROWS:
        return predict(tree(train, label=label, seed=seed), test, id_col, label)
    return TR.fit_tree(train, id_col, label, x, seed=seed).predict(test, id_col, label, x)


def forest(train: DataFrame, n_trees: int = 100, label: str = "label", seed: int = 42, max_depth: int = 30):
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=n_trees,
                                  featureSubsetStrategy="sqrt", maxDepth=max_depth, seed=seed).fit(train)


def forest_regressor(train: DataFrame, n_trees: int = 100, label: str = "y", seed: int = 42):
    return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=n_trees, maxDepth=20,
                                 seed=seed).fit(train)


def forest_values(train: DataFrame, test: DataFrame, id_col: str, label: str = "y", seed: int = 42) -> DataFrame:
    """(id, label, prediction) by 100 regression trees of depth 20 (``features``). Many
    rows with few features are summed into the cells of the bins, where the trees grow."""
    if train.count() > SPARK_TREE_ROWS:
        checked = F.when(F.col(label).isNull() | F.isnan(label), F.raise_error(F.lit("Labels MUST NOT be Null or NaN"))).otherwise(F.col(label))
        rows = scratch_table(train.select(id_col, checked.cast("double").alias(label), vector_to_array("features").alias("x")), "forest-rows")
        fitted = TR.fit_grid_forest(rows, id_col, 100, label, seed=seed)
        if fitted is not None:
            return fitted.predict(test.withColumn("x", vector_to_array("features")), id_col, label)
    return forest_regressor(train, label=label, seed=seed).transform(test).select(id_col, label, "prediction")


def mlp(train: DataFrame, layers: Sequence[int], label: str = "label", max_iter: int = 100, seed: int = 42):
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=list(layers),
                                          maxIter=max_iter, seed=seed).fit(train)


def predict(model, df: DataFrame, id_col: str, label: str = "label", name: str | None = None) -> DataFrame:
    p = model.transform(df).select(id_col, label, F.col("prediction").cast("int").alias("pred"))
    return p.withColumn("model", F.lit(name)) if name else p


def stacking(train: DataFrame, test: DataFrame, id_col: str, k: int = 5, label: str = "label", seed: int = 42,
             meta_trees: int = 50) -> DataFrame:
    """Base logistic + tree; the meta forest learns from out-of-fold class
    probabilities (fold = seeded hash mod k); test rows use base models
    refitted on all training rows. With over ``SPARK_TREE_ROWS`` the trees of all
    folds and of all rows grow together: what a tree leaves out is a draw of 0."""
    from quarry.operators.prep import kfold
    tr = kfold(train, id_col, k, seed)
    if tr.count() <= SPARK_TREE_ROWS:
        return _stacking_by_spark(train, test, tr, id_col, k, label, seed, meta_trees)
    tr = cut_lineage(tr.select(id_col, label, "features", "fold"))
    arrays = lambda df: df.withColumn("_x", vector_to_array("features"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda t: (t != F.col("fold")).cast("int"))
    dt = TR.fit_forest(arrays(tr), id_col, k + 1, label, "_x", seed=seed, per_split=1 << 30, draws=draws, early=True)

    def by_logistic(fit_df, apply_df):
        rows = fit_df.select(label, "features").persist()
        try:
            return logistic(rows, label=label).transform(apply_df).select(id_col, vector_to_array("probability").alias("p_lr"))
        finally:
            rows.unpersist()

    oof = None
    for f in range(k):
        part = by_logistic(tr.filter(F.col("fold") != f), tr.filter(F.col("fold") == f))
        oof = part if oof is None else oof.unionByName(part)
    oof = oof.join(dt.out_of_bag_shares().select(F.col("id").alias(id_col), F.col("shares").alias("p_dt")), id_col)
    meta_train = cut_lineage(tr.select(id_col, label).join(oof, id_col).select(id_col, label, F.concat("p_lr", "p_dt").alias("z")))
    meta = TR.fit_forest(meta_train, id_col, meta_trees, label, "z", seed=seed, early=True)
    p_dt = dt.class_shares(arrays(test), id_col, label, "_x", [k]).withColumnRenamed("shares", "p_dt")
    tz = test.select(id_col, label).join(by_logistic(tr, test).join(p_dt, id_col), id_col)
    return meta.predict(tz.select(id_col, label, F.concat("p_lr", "p_dt").alias("z")), id_col, label, "z")


def _stacking_by_spark(train: DataFrame, test: DataFrame, tr: DataFrame, id_col: str, k: int, label: str, seed: int, meta_trees: int) -> DataFrame:
    """:func:`stacking` with Spark's trees."""
    def base_probs(fit_df, apply_df):
        lr = logistic(fit_df, label=label)
        dt = tree(fit_df, label=label, seed=seed)
        a = lr.transform(apply_df).select(id_col, vector_to_array("probability").alias("p_lr"))
        b = dt.transform(apply_df).select(id_col, vector_to_array("probability").alias("p_dt"))
        return a.join(b, id_col)

    oof = None
    for f in range(k):
        part = base_probs(tr.filter(F.col("fold") != f), tr.filter(F.col("fold") == f))
        oof = part if oof is None else oof.unionByName(part)
    meta_train = with_vector(tr.select(id_col, label).join(oof, id_col).withColumn("z", F.concat("p_lr", "p_dt")), "z")
    meta = forest(meta_train, meta_trees, label, seed)
    tz = test.select(id_col, label).join(base_probs(train, test), id_col).withColumn("z", F.concat("p_lr", "p_dt"))
    return predict(meta, with_vector(tz, "z"), id_col, label)


def pipeline_regression(train: DataFrame, cols: Sequence[str], label: str):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    p = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="raw"),
                         StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
                         LinearRegression(featuresCol="features", labelCol=label, solver="normal")])
    return p.fit(train)
