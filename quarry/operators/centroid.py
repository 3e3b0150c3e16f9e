"""Class averages and nearest-centroid scoring.

Class means are one partial+final aggregation over exploded coordinates
(only K*d partial rows per partition cross the shuffle). The fitted model
(K centroid vectors, bounded in bytes where collected) is then shipped to the
executors as a literal, so scoring is a narrow projection: no join, no
cross product, no shuffle of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import vec as V
from quarry.operators.small import collect_small

SIMILARITIES = ("cosine", "euc", "dot")


def class_average_long(df: DataFrame, features: str = "x", label: str = "label") -> DataFrame:
    """(label, i, mean) — per-class mean of every coordinate, 0-based i."""
    return (df.select(label, F.posexplode(features).alias("i", "v"))
            .groupBy(label, "i").agg(F.avg("v").alias("mean")))


def class_average(df: DataFrame, features: str = "x", label: str = "label") -> DataFrame:
    """(label, centroid array<double>, n) — sum/count per class."""
    long = class_average_long(df, features, label)
    arr = (long.groupBy(label)
           .agg(F.array_sort(F.collect_list(F.struct("i", "mean"))).alias("_s"))
           .select(label, F.transform("_s", lambda s: s["mean"]).alias("centroid")))
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return arr.join(counts, label)


def class_average_model(df: DataFrame, features: str = "x", label: str = "label"):
    """Fit and collect in one job: (labels, centroid vectors, counts), K*d
    long cells collected under a size check (one shuffle, no regroup)."""
    long = (df.select(label, F.posexplode(features).alias("i", "v"))
            .groupBy(label, "i").agg(F.avg("v").alias("mean"), F.count("*").alias("n")))
    rows = collect_small(long, "class-average cells")
    by: dict = {}
    for r in rows:
        by.setdefault(r[label], {})[r["i"]] = (r["mean"], r["n"])
    labels = sorted(by)
    vectors = [[by[l][i][0] for i in sorted(by[l])] for l in labels]
    counts = [next(iter(by[l].values()))[1] for l in labels]
    return labels, vectors, counts


def scores_long(df: DataFrame, labels: list, vectors: list, sim: str = "cosine", id_col: str = "vec_id",
                features: str = "x") -> DataFrame:
    """(id, cls, score) against an already-collected model."""
    scored = df.select(id_col, score_columns(F.col(features), labels, vectors, sim).alias("_s"))
    lab = F.array(*[F.lit(l) for l in labels])
    return scored.select(id_col, F.explode(F.arrays_zip(lab.alias("cls"), F.col("_s").alias("score"))).alias("z")) \
        .select(id_col, F.col("z.cls").alias("cls"), F.col("z.score").alias("score"))


def fetch_centroids(centroids: DataFrame, label: str = "label", vector: str = "centroid"):
    """Collect a small centroid table (size-checked), ordered by label."""
    rows = collect_small(centroids.select(label, vector), "centroid table")
    rows = sorted(rows, key=lambda r: r[label])
    return [r[label] for r in rows], [list(r[vector]) for r in rows]


def similarity(x: Column, c: Column, sim: str) -> Column:
    if sim == "cosine":
        return V.cosine(x, c)
    if sim == "euc":
        return -V.euclid(x, c)
    if sim == "dot":
        return V.dot(x, c)
    raise ValueError(f"no such score: {sim!r}; there are {SIMILARITIES}")


def score_columns(x: Column, labels: list, vectors: list, sim: str) -> Column:
    """array<double> of scores against each centroid, in label order."""
    if sim not in SIMILARITIES:
        raise ValueError(f"no such score: {sim!r}; there are {SIMILARITIES}")
    if sim == "cosine":
        # normalise the model once, on the driver, before it becomes a literal
        import math
        vectors = [[v / max(math.sqrt(sum(t * t for t in vec)), 1e-12) for v in vec] for vec in vectors]
        return V.let(V.l2_normalize(x), lambda xn: F.transform(V.lit_matrix(vectors), lambda c: V.dot(xn, c)))
    return F.transform(V.lit_matrix(vectors), lambda c: similarity(x, c, sim))


def argmax_label(scores: Column, labels: list) -> Column:
    """Label of the largest score; ties go to the first (smallest) label."""
    lab = F.array(*[F.lit(l) for l in labels])
    return F.element_at(lab, F.array_position(scores, F.array_max(scores)).cast("int"))


def nearest_centroid_scores(df: DataFrame, centroids: DataFrame, sim: str = "cosine", id_col: str = "vec_id",
                            features: str = "x", label: str = "label") -> DataFrame:
    """(id, cls, score) — every row scored against every class mean."""
    labels, vectors = fetch_centroids(centroids, label)
    scored = df.select(id_col, score_columns(F.col(features), labels, vectors, sim).alias("_s"))
    lab = F.array(*[F.lit(l) for l in labels])
    return scored.select(id_col, F.explode(F.arrays_zip(lab.alias("cls"), F.col("_s").alias("score"))).alias("z")) \
        .select(id_col, F.col("z.cls").alias("cls"), F.col("z.score").alias("score"))


def predict_nearest_centroid(df: DataFrame, centroids: DataFrame, sim: str = "cosine", features: str = "x",
                             label: str = "label", out: str = "pred") -> DataFrame:
    labels, vectors = fetch_centroids(centroids, label)
    s = score_columns(F.col(features), labels, vectors, sim)
    return df.withColumn(out, argmax_label(s, labels))


def predict_nearest_centroid_literal(df: DataFrame, labels: list, vectors: list, sim: str = "cosine",
                                     features: str = "x", out: str = "pred") -> DataFrame:
    """Score with an already-collected model (labels + vectors)."""
    return df.withColumn(out, argmax_label(score_columns(F.col(features), labels, vectors, sim), labels))
