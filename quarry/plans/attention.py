"""Attention plans over ``embeddings``: sequences are blocks of 10
consecutive vector ids (seq = vec_id div 10, pos = vec_id mod 10); Q = K = V
are the vectors; a key is padding when its label is 0 (mask variant)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import vec as V
from quarry.operators import attention as A
from quarry.plans.common import tbl
from quarry.plans.registry import register

R = 6
BLOCK = 10


def _seqs(spark, sf):
    e = tbl(spark, sf, "embeddings")
    return e.select(F.expr(f"vec_id div {BLOCK}").alias("seq"), (F.col("vec_id") % BLOCK).cast("long").alias("pos"),
                    F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).alias("pad"))


SQL_SEQ = f"""WITH t AS (SELECT vec_id // {BLOCK} AS seq, vec_id % {BLOCK} AS pos, CAST(embedding AS DOUBLE[]) AS x, label = 0 AS pad FROM embeddings)"""


def _sql_attend(extra_cond: str, key_filter: str) -> str:
    return SQL_SEQ + f""",
p AS (SELECT q.seq, q.pos AS q_pos, k.pos AS k_pos, list_inner_product(q.x, k.x) / sqrt(len(q.x)) AS sc, k.x AS v
      FROM t q JOIN t k ON q.seq = k.seq {extra_cond} WHERE {key_filter}),
pm AS (SELECT *, max(sc) OVER (PARTITION BY seq, q_pos) AS mx FROM p),
w AS (SELECT seq, q_pos, k_pos, v, exp(sc - mx) / sum(exp(sc - mx)) OVER (PARTITION BY seq, q_pos) AS weight FROM pm),
u AS (SELECT seq, q_pos, unnest(range(len(v))) AS i, unnest(v) AS vv, weight FROM w),
o AS (SELECT seq, q_pos, i, sum(weight * vv) AS o FROM u GROUP BY ALL)
SELECT seq, q_pos, list(round(o, {R}) + 0.0 ORDER BY i) AS out FROM o GROUP BY seq, q_pos"""


def _out(df):
    return df.select("seq", "q_pos", V.round_array("out", R).alias("out"))


@register("att_scaled_dot", _sql_attend("", "true"))
def q_att_scaled_dot(spark, sf):
    """softmax(Q Kᵀ / sqrt(d)) V within each sequence."""
    return _out(A.attend(_seqs(spark, sf)))


@register("att_weights", SQL_SEQ + f""",
p AS (SELECT q.seq, q.pos AS q_pos, k.pos AS k_pos, list_inner_product(q.x, k.x) / sqrt(len(q.x)) AS sc FROM t q JOIN t k ON q.seq = k.seq),
pm AS (SELECT *, max(sc) OVER (PARTITION BY seq, q_pos) AS mx FROM p)
SELECT seq, q_pos, k_pos, round(exp(sc - mx) / sum(exp(sc - mx)) OVER (PARTITION BY seq, q_pos), {R}) AS weight FROM pm""")
def q_att_weights(spark, sf):
    """The attention weights themselves (rows of each softmax sum to 1)."""
    w = A.attention_weights(_seqs(spark, sf))
    return w.select("seq", "q_pos", "k_pos", F.round("weight", R).alias("weight"))


@register("att_mask", _sql_attend("", "NOT k.pad"))
def q_att_mask(spark, sf):
    """Padding keys (label 0 here) take no weight; fully padded -> no row."""
    return _out(A.attend(_seqs(spark, sf), key_mask="pad"))


@register("att_causal", _sql_attend("AND k.pos <= q.pos", "true"))
def q_att_causal(spark, sf):
    """Each position attends only to itself and earlier positions."""
    return _out(A.attend(_seqs(spark, sf), causal=True))


@register("att_mean_pool", SQL_SEQ + f""",
u AS (SELECT seq, unnest(range(len(x))) AS i, unnest(x) AS v FROM t)
SELECT seq, list(round(m, {R}) + 0.0 ORDER BY i) AS pooled FROM (SELECT seq, i, avg(v) AS m FROM u GROUP BY ALL) GROUP BY seq""")
def q_att_mean_pool(spark, sf):
    p = A.mean_pool(_seqs(spark, sf), "seq")
    return p.select("seq", V.round_array("pooled", R).alias("pooled"))


@register("join_attention_pairs", SQL_SEQ + f"""
SELECT q.seq, q.pos AS q_pos, k.pos AS k_pos, round(list_inner_product(q.x, k.x), {R}) AS score FROM t q JOIN t k ON q.seq = k.seq""")
def q_join_attention_pairs(spark, sf):
    """Every position paired with every position of its own sequence."""
    t = _seqs(spark, sf)
    q = t.select("seq", F.col("pos").alias("q_pos"), F.col("x").alias("qx"))
    k = t.select("seq", F.col("pos").alias("k_pos"), F.col("x").alias("kx"))
    return q.join(k, "seq").select("seq", "q_pos", "k_pos", F.round(V.dot("qx", "kx"), R).alias("score"))
