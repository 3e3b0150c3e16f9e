"""Index -> vector lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pooled_lookup(df: DataFrame, ids: str, table: DataFrame, width: int) -> DataFrame:
    """Add (n, pooled): how many of a row's indices ``table`` (idx, x) knows and
    the mean of their vectors (null where n = 0).

    Each distinct index array is looked up once (arrays are told apart by a
    128-bit hash). An index that occurs often in an array is joined once, with
    its count, and the sums of the ``width`` coordinates combine map-side."""
    names = df.columns
    h = df.withColumns({"_h": F.xxhash64(ids), "_g": F.xxhash64(F.lit(1), F.col(ids))})
    each = h.select("_h", "_g", F.col(ids).alias("_ids")).dropDuplicates(["_h", "_g"])
    counts = each.select("_h", "_g", F.explode("_ids").alias("_i")).groupBy("_h", "_g", "_i").agg(F.count("*").alias("_n"))
    j = counts.join(table.select(F.col("idx").alias("_i"), F.col("x").alias("_x")), "_i")
    sums = j.groupBy("_h", "_g").agg(F.sum("_n").alias("n"), *[F.sum(F.col("_n") * F.get("_x", F.lit(k))).alias(f"_s{k}") for k in range(width)])
    pooled = sums.select("_h", "_g", "n", F.array(*[F.col(f"_s{k}") / F.col("n") for k in range(width)]).alias("pooled"))
    return h.join(pooled, ["_h", "_g"], "left").select(*names, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "pooled")
