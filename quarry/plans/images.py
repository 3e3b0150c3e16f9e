"""Image-grid plans: each 64-dim vector viewed as an 8x8 image."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import image as I
from quarry.plans.common import tbl
from quarry.plans.registry import register

R = 6
# fixed values: the 3x3 kernel used by the convolution plan (a Laplacian)
KERNEL = [[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]]


def _px(spark, sf):
    return tbl(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


SQL_PX = """WITH px AS (SELECT vec_id AS img, (i // 8)::INTEGER AS r, (i % 8)::INTEGER AS c, v FROM (
  SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings))"""


def _round(df):
    return df.select("img", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.round("v", R).alias("v"))


@register("img_avg_pool", SQL_PX + f"\nSELECT img, r // 2 AS r, c // 2 AS c, round(avg(v), {R}) AS v FROM px GROUP BY ALL")
def q_img_avg_pool(spark, sf):
    return _round(I.pool(_px(spark, sf), "vec_id", "x", 8, 8, 2, "avg"))


@register("img_max_pool", SQL_PX + f"\nSELECT img, r // 2 AS r, c // 2 AS c, round(max(v), {R}) AS v FROM px GROUP BY ALL")
def q_img_max_pool(spark, sf):
    return _round(I.pool(_px(spark, sf), "vec_id", "x", 8, 8, 2, "max"))


_K = " UNION ALL ".join(f"SELECT {a - 1} AS dr, {b - 1} AS dc, {KERNEL[a][b]} AS k" for a in range(3) for b in range(3))


@register("img_conv3x3", SQL_PX + f""",
kk AS ({_K})
SELECT img, (r - dr)::INTEGER AS r, (c - dc)::INTEGER AS c, round(sum(v * k), {R}) AS v FROM px, kk
WHERE r - dr BETWEEN 0 AND 7 AND c - dc BETWEEN 0 AND 7 GROUP BY ALL""")
def q_img_conv3x3(spark, sf):
    return _round(I.conv3x3(_px(spark, sf), "vec_id", "x", KERNEL, 8, 8))


@register("img_conv3x3_stride", SQL_PX + f""",
kk AS ({_K}), o AS (SELECT * FROM range(4) tr(r), range(4) tc(c))
SELECT img, o.r::INTEGER AS r, o.c::INTEGER AS c, round(sum(v * k), {R}) AS v FROM o, kk, px
WHERE px.r = o.r * 2 + dr AND px.c = o.c * 2 + dc GROUP BY ALL""")
def q_img_conv3x3_stride(spark, sf):
    """The same filter at every second row and column."""
    return _round(I.conv3x3(_px(spark, sf), "vec_id", "x", KERNEL, 8, 8, stride=2))


@register("img_upsample_nn", SQL_PX + f"""
SELECT img, (r * 2 + a)::INTEGER AS r, (c * 2 + b)::INTEGER AS c, round(v, {R}) AS v FROM px, range(2) ta(a), range(2) tb(b)""")
def q_img_upsample_nn(spark, sf):
    return _round(I.upsample_nearest(_px(spark, sf), "vec_id", "x", 8, 8, 2))
