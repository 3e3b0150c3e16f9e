"""Training-history tables: running best, stale counter, early stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_so_far(hist: DataFrame, run: str, epoch: str, metric: str, patience: int = 3,
                initial_best: float = -1.0) -> DataFrame:
    """Per (run, epoch): best metric so far, stale count and the stop flag.

    An epoch improves when its metric is strictly greater than the best of
    the earlier epochs (starting from ``initial_best``); stale = epochs since
    the last improvement; the run stops at the first epoch with
    stale >= patience. Windows are per run and ordered by epoch."""
    w_prev = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    w_cur = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("_prev", F.greatest(F.lit(initial_best), F.coalesce(F.max(metric).over(w_prev), F.lit(initial_best))))
    h = h.withColumn("improved", F.col(metric) > F.col("_prev"))
    h = h.withColumn("best_so_far", F.greatest(F.col("_prev"), F.col(metric)))
    h = h.withColumn("_last", F.coalesce(F.max(F.when(F.col("improved"), F.col(epoch))).over(w_cur), F.lit(0)))
    h = h.withColumn("stale", (F.col(epoch) - F.col("_last")).cast("int"))
    h = h.withColumn("_first_stop", F.min(F.when(F.col("stale") >= patience, F.col(epoch))).over(
        Window.partitionBy(run)))
    return h.withColumn("stop", F.coalesce(F.col(epoch) == F.col("_first_stop"), F.lit(False))).drop("_prev", "_last", "_first_stop")


def best_so_far_segmented(hist: DataFrame, run: str, order: list[str], metric: str, patience: int = 3,
                          initial_best: float = -1.0, segment_rows: int = 1 << 20) -> DataFrame:
    """Same table as :func:`best_so_far`, without one window per run.

    A run may hold a large share of all rows, so rows are numbered in
    (run, order) with the distributed global index and cut into fixed-size
    segments; every window is per (run, segment) — at most ``segment_rows``
    rows — and what earlier segments contribute (the running best and the
    last improving epoch) comes from a small per-(run, segment) table with a
    prefix window over segments."""
    from quarry.operators.ordering import with_global_index
    from quarry.session import cut_lineage
    g = with_global_index(hist.select(run, *order, metric), [run, *order], "_g")
    g = g.withColumn("_seg", F.expr(f"_g div {int(segment_rows)}"))

    seg = Window.partitionBy(run).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    local_prev = Window.partitionBy(run, "_seg").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    local_cur = Window.partitionBy(run, "_seg").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)

    # one small per-(run, segment) table gives both the run's first index
    # (epoch numbering) and the best value of all earlier segments
    sstat = g.groupBy(run, "_seg").agg(F.max(metric).alias("_smax"), F.min("_g").alias("_gmin"))
    carry = sstat.select(run, "_seg", F.max("_smax").over(seg).alias("_carry"),
                         F.min("_gmin").over(Window.partitionBy(run)).alias("_g0"))
    h = g.join(carry, [run, "_seg"])
    h = h.withColumn("epoch", F.col("_g") - F.col("_g0") + 1).drop("_g0")
    prev = F.greatest(F.lit(initial_best), F.coalesce(F.col("_carry"), F.lit(initial_best)),
                      F.coalesce(F.max(metric).over(local_prev), F.lit(initial_best)))
    h = h.withColumn("_prev", prev).withColumn("improved", F.col(metric) > F.col("_prev"))
    h = h.withColumn("best_so_far", F.greatest(F.col("_prev"), F.col(metric)))
    h = h.withColumn("_llast", F.max(F.when(F.col("improved"), F.col("epoch"))).over(local_cur))
    h = cut_lineage(h)  # the windows run once; the carries below are taken from the result
    slast = h.groupBy(run, "_seg").agg(F.max(F.when(F.col("improved"), F.col("epoch"))).alias("_sl"))
    lcarry = slast.select(run, "_seg", F.max("_sl").over(seg).alias("_lc"))
    h = h.join(lcarry, [run, "_seg"])
    last = F.coalesce(F.col("_llast"), F.col("_lc"), F.lit(0))
    h = h.withColumn("stale", (F.col("epoch") - last).cast("int"))
    stop = h.groupBy(run).agg(F.min(F.when(F.col("stale") >= patience, F.col("epoch"))).alias("_fs"))
    h = h.join(stop, run)
    return (h.withColumn("stop", F.coalesce(F.col("epoch") == F.col("_fs"), F.lit(False)))
            .drop("_g", "_seg", "_carry", "_prev", "_llast", "_lc", "_fs"))
