"""History windows, decision grids and hyper-parameter choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import vec as V
from quarry.operators import centroid as C
from quarry.plans.common import SQL_EMB, emb, tbl
from quarry.plans.registry import register

R = 6
GRID = 20


@register("win_best_so_far", f"""WITH h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events),
a AS (SELECT *, greatest(-1.0, coalesce(max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0)) AS prev FROM h),
b AS (SELECT *, value > prev AS improved, greatest(prev, value) AS best_so_far FROM a),
c AS (SELECT *, (epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0))::INTEGER AS stale FROM b),
d AS (SELECT *, min(CASE WHEN stale >= 3 THEN epoch END) OVER (PARTITION BY run) AS fs FROM c)
SELECT run, epoch, round(value, {R}) AS value, improved, round(best_so_far, {R}) AS best_so_far, stale, coalesce(epoch = fs, false) AS stop FROM d""")
def q_win_best_so_far(spark, sf):
    """Early-stopping table: every user's events in time order are the
    epochs of one run, the event value its validation metric (patience 3)."""
    from quarry.operators.history import best_so_far_segmented
    ev = tbl(spark, sf, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    b = best_so_far_segmented(ev, "run", ["ts", "event_id"], "value", patience=3)
    return b.select("run", F.col("epoch").cast("long").alias("epoch"), F.round("value", R).alias("value"), "improved",
                    F.round("best_so_far", R).alias("best_so_far"), "stale", "stop")


@register("join_grid", f"""WITH {SQL_EMB},
m AS (SELECT min(x[1]) AS lo0, max(x[1]) AS hi0, min(x[2]) AS lo1, max(x[2]) AS hi1 FROM e),
g AS (SELECT i, j, lo0 + (hi0 - lo0) * i / {GRID - 1}.0 AS g0, lo1 + (hi1 - lo1) * j / {GRID - 1}.0 AS g1
      FROM m, range({GRID}) ti(i), range({GRID}) tj(j)),
c AS (SELECT label, avg(x[1]) AS c0, avg(x[2]) AS c1 FROM e WHERE split = 'train' GROUP BY label),
s AS (SELECT i, j, g0, g1, label, row_number() OVER (PARTITION BY i, j ORDER BY (g0 - c0) ^ 2 + (g1 - c1) ^ 2, label) AS r FROM g, c)
SELECT i, j, round(g0, {R}) AS g0, round(g1, {R}) AS g1, label AS pred FROM s WHERE r = 1""")
def q_join_grid(spark, sf):
    """A 20 x 20 mesh over the range of the first two coordinates (two
    generated axes, no join), each point labelled by the nearest class mean
    in that plane."""
    e = emb(spark, sf).select("x", "label", "split", F.slice("x", 1, 2).alias("x2"))
    m = e.agg(F.min(F.element_at("x", 1)).alias("lo0"), F.max(F.element_at("x", 1)).alias("hi0"),
              F.min(F.element_at("x", 2)).alias("lo1"), F.max(F.element_at("x", 2)).alias("hi1"))
    g = (m.select(F.posexplode(V.linspace("lo0", "hi0", GRID)).alias("i", "g0"), "lo1", "hi1")
         .select("i", "g0", F.posexplode(V.linspace("lo1", "hi1", GRID)).alias("j", "g1")))
    cents = C.class_average(e.filter("split = 'train'").select("label", F.col("x2").alias("x")))
    labels, vectors = C.fetch_centroids(cents)
    pt = F.array("g0", "g1")
    s = F.transform(V.lit_matrix(vectors), lambda c: -V.sq_euclid(pt, c))
    return g.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
                    F.round("g0", R).alias("g0"), F.round("g1", R).alias("g1"),
                    C.argmax_label(s, labels).alias("pred"))
