"""Aligning per-position vectors with per-sequence label strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_embeddings(labels: DataFrame, vectors: DataFrame, key: str, label_col: str,
                     pos: str = "pos", vec: str = "x") -> DataFrame:
    """Join (key, pos, vec) rows to (key, labels string). If a sequence has
    exactly len(labels) + 2 vectors the first and last are begin/end rows
    and are dropped; otherwise both sides are cut to the shorter length.
    Output: (key, pos, label_char, vec) with 0-based label positions."""
    n = vectors.groupBy(key).agg(F.count("*").alias("_emb_len"))
    a = labels.join(n, key).withColumn("_L", F.length(label_col))
    a = a.withColumn("_off", F.when(F.col("_emb_len") == F.col("_L") + 2, 1).otherwise(0))
    j = vectors.join(a, key)
    p = F.col(pos) - F.col("_off")
    keep = (p >= 0) & (p < F.least(F.col("_L"), F.col("_emb_len") - 2 * F.col("_off")))
    return j.filter(keep).select(key, p.cast("long").alias(pos),
                                 F.substring(F.col(label_col), (p + 1).cast("int"), 1).alias("label_char"), vec)
