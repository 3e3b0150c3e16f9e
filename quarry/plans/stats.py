"""Aggregations: descriptive statistics, counts, Gram/covariance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import vec as V
from quarry.operators import gram as G
from quarry.operators import stats as S
from quarry.plans.common import SQL_EMB, emb, tbl
from quarry.plans.registry import register
from quarry.sources.tables import TABLES

R = 6
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("agg_basic_stats", f"""SELECT round(avg(l_extendedprice), {R}) AS mean, round(stddev_pop(l_extendedprice), {R}) AS std,
  round(quantile_cont(l_extendedprice, 0.5), {R}) AS median FROM lineitem""")
def q_agg_basic_stats(spark, sf):
    s = S.basic_stats(tbl(spark, sf, "lineitem"), "l_extendedprice")
    return s.select(*[F.round(c, R).alias(c) for c in ("mean", "std", "median")])


@register("agg_mode_variance", f"""SELECT (SELECT l_quantity FROM lineitem GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1) AS mode,
  round(var_samp(l_quantity), {R}) AS variance FROM lineitem""")
def q_agg_mode_variance(spark, sf):
    li = tbl(spark, sf, "lineitem")
    m = S.mode(li, "l_quantity")
    v = li.agg(F.round(F.var_samp("l_quantity"), R).alias("variance"))
    return S._one_row_concat(m, v)


@register("agg_describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), {R}) AS mean, round(stddev_samp({c}), {R}) AS std,
  round(min({c}), {R}) AS min, round(quantile_cont({c}, 0.25), {R}) AS p25, round(quantile_cont({c}, 0.5), {R}) AS p50,
  round(quantile_cont({c}, 0.75), {R}) AS p75, round(max({c}), {R}) AS max FROM lineitem""" for c in LI_COLS))
def q_agg_describe(spark, sf):
    d = S.describe(tbl(spark, sf, "lineitem"), LI_COLS)
    return d.select("column", "count", *[F.round(c, R).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@register("agg_count", " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in TABLES))
def q_agg_count(spark, sf):
    parts = [tbl(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("agg_count_distinct", """SELECT (SELECT count(DISTINCT label) FROM embeddings) AS n_labels,
  (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_parts""")
def q_agg_count_distinct(spark, sf):
    a = tbl(spark, sf, "embeddings").agg(F.countDistinct("label").alias("n_labels"))
    b = tbl(spark, sf, "lineitem").agg(F.countDistinct("l_partkey").alias("n_parts"))
    return S._one_row_concat(a, b)


@register("agg_global_mean_std", f"""WITH {SQL_EMB}
SELECT round(avg(v), {R}) AS mean, round(stddev_samp(v), {R}) AS std, count(*) AS n FROM (SELECT unnest(x) AS v FROM e)""")
def q_agg_global_mean_std(spark, sf):
    """One mean/std over every coordinate of every vector (sample std)."""
    v = emb(spark, sf).select(F.explode("x").alias("v"))
    return v.agg(F.round(F.avg("v"), R).alias("mean"), F.round(F.stddev_samp("v"), R).alias("std"), F.count("*").alias("n"))


SQL_U = f"""WITH {SQL_EMB},
u AS (SELECT vec_id, 0 AS i, 1.0::DOUBLE AS v FROM e
      UNION ALL SELECT vec_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM e
      UNION ALL SELECT vec_id, len(x) + 1 AS i, label::DOUBLE AS v FROM e)"""


@register("agg_gram", SQL_U + f"""
SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(a.v * b.v), {R}) AS value FROM u a JOIN u b USING (vec_id) GROUP BY a.i, b.i""")
def q_agg_gram(spark, sf):
    """ZᵀZ for Z = [1, x, y] (y = label as a number): n, sums, XᵀX, Xᵀy, yᵀy."""
    g = G.gram(emb(spark, sf), "x", "label")
    return g.select("i", "j", F.round("value", R).alias("value"))


@register("agg_covariance", f"""WITH {SQL_EMB},
u AS (SELECT vec_id, unnest(range(len(x))) AS i, unnest(x) AS v FROM e)
SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(covar_samp(a.v, b.v), {R}) + 0.0 AS cov FROM u a JOIN u b USING (vec_id) GROUP BY a.i, b.i""")
def q_agg_covariance(spark, sf):
    """Sample covariance matrix of the 64 coordinates, from the Gram cells."""
    c = G.covariance_long(G.gram(emb(spark, sf), "x"))
    return c.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.round("cov", R).alias("cov"))


@register("agg_minmax", f"""SELECT round(min(x[1]), {R}) AS x0_min, round(max(x[1]), {R}) AS x0_max,
  round(min(x[2]), {R}) AS x1_min, round(max(x[2]), {R}) AS x1_max FROM (SELECT CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""")
def q_agg_minmax(spark, sf):
    e = emb(spark, sf)
    return e.agg(*[F.round(f(F.element_at("x", i + 1)), R).alias(f"x{i}_{n}") for i in (0, 1)
                   for f, n in ((F.min, "min"), (F.max, "max"))])


@register("agg_sparsity", f"""WITH {SQL_EMB}
SELECT round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), {R}) AS sparsity FROM (
  SELECT unnest(list_transform(x, lambda w: greatest(0.0, least(1.0, w * 4.0)))) AS v FROM e)""")
def q_agg_sparsity(spark, sf):
    """Share of exactly-zero entries (here of the clipped vectors; the model
    plans apply the same operator to coefficient tables)."""
    e = emb(spark, sf).select(V.clip(V.scale("x", 4.0), 0.0, 1.0).alias("c"))
    return S.sparsity(e, "c").select(F.round("sparsity", R).alias("sparsity"))
