"""Nearest neighbours and clustering on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import vec as V
from quarry.functions.hashing import hash_u60, sql_hash_u60
from quarry.operators import cluster as CL
from quarry.operators import neighbors as NN
from quarry.operators.small import collect_small
from quarry.plans.common import SEED, SQL_EMB, emb
from quarry.plans.registry import register
from quarry.session import scratch_table

R = 6
K = 5
N_CLUSTERS = 10

SQL_KNN = f"""WITH {SQL_EMB},
d AS (SELECT q.vec_id AS qid, t.vec_id AS rid, t.label, list_distance(q.x, t.x) AS dist
      FROM e q, e t WHERE q.split = 'test' AND t.split = 'train'),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM d) WHERE rank <= {K})"""


def _nn(spark, sf):
    e = emb(spark, sf)
    q = e.filter("split = 'test'").select(F.col("vec_id").alias("qid"), "x")
    r = e.filter("split = 'train'").select(F.col("vec_id").alias("rid"), "x", "label")
    return NN.knn(q, r, K, "qid", "rid", "x")


@register("join_knn", SQL_KNN + f"\nSELECT qid, rid, rank::INTEGER AS rank, round(dist, {R}) AS dist FROM nn")
def q_join_knn(spark, sf):
    """Exact 5 nearest training vectors of every test vector (Euclidean)."""
    return _nn(spark, sf).select("qid", "rid", "rank", F.round("dist", R).alias("dist"))


@register("join_knn_classify", SQL_KNN + """,
v AS (SELECT qid, label, count(*) AS n FROM nn GROUP BY ALL)
SELECT qid AS vec_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) AS r FROM v) WHERE r = 1""")
def q_join_knn_classify(spark, sf):
    """k = 5 majority vote (ties -> smallest class)."""
    return NN.knn_classify(_nn(spark, sf), "qid", "label").withColumnRenamed("qid", "vec_id")


@register("join_knn_prob", SQL_KNN + f"\nSELECT qid AS vec_id, label, round(count(*) / {float(K)}, {R}) AS prob FROM nn GROUP BY ALL")
def q_join_knn_prob(spark, sf):
    p = NN.knn_proba(_nn(spark, sf), "qid", "label", K)
    return p.select(F.col("qid").alias("vec_id"), "label", F.round("prob", R).alias("prob"))


@register("join_knn_regress", SQL_KNN + f"\nSELECT qid AS vec_id, round(avg(label), {R}) AS pred FROM nn GROUP BY ALL")
def q_join_knn_regress(spark, sf):
    """Mean target (the label as a number) of the 5 neighbours."""
    p = NN.knn_regress(_nn(spark, sf), "qid", "label")
    return p.select(F.col("qid").alias("vec_id"), F.round("pred", R).alias("pred"))


RECALL_SAMPLE = 256


@register("join_knn_approx")
def q_join_knn_approx(spark, sf):
    """Approximate kNN: the nearest cells only, as many as a searched sample
    needs for a recall of 0.95, with what is certified to be exact and the recall
    against exact search on a sample of other queries."""
    e = emb(spark, sf)
    q = e.filter("split = 'test'").select(F.col("vec_id").alias("qid"), "x")
    r = e.filter("split = 'train'").select(F.col("vec_id").alias("rid"), "x")
    out = scratch_table(NN.knn_clustered(q, r, K, "qid", "rid", "x", seed=SEED), "knn-answer")
    share = NN.recall(out, q, r, K, "qid", "rid", "x", RECALL_SAMPLE, SEED + 1)
    return out.select("qid", "rid", "rank", F.round("dist", R).alias("dist"), "certified", F.round(F.lit(share).cast("double"), R).alias("recall"))


# -- clustering --------------------------------------------------------------------

SQL_INIT = f"""WITH {SQL_EMB},
init AS (SELECT cid, x AS c FROM (SELECT x, row_number() OVER (ORDER BY {sql_hash_u60(SEED, 'vec_id')}, vec_id) - 1 AS cid FROM e)
         WHERE cid < {N_CLUSTERS}),
asg AS (SELECT * FROM (SELECT e.vec_id, e.x, init.cid, list_distance(e.x, init.c) AS d, init.c,
          row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.x, init.c), init.cid) AS r FROM e, init) WHERE r = 1)"""


def _init_centers(spark, sf):
    e = emb(spark, sf)
    rows = collect_small(e.withColumn("_h", hash_u60(SEED, "vec_id")).orderBy("_h", "vec_id").limit(N_CLUSTERS)
                         .select("x"), "initial centers")
    return e, [list(r["x"]) for r in rows], list(range(len(rows)))


@register("mdl_kmeans_step", SQL_INIT + f""",
u AS (SELECT cid, unnest(x) AS v, unnest(range(len(x))) AS i FROM asg),
m AS (SELECT cid, i, avg(v) AS m FROM u GROUP BY ALL)
SELECT cid AS cluster, (SELECT count(*) FROM asg WHERE asg.cid = m.cid) AS n, list(round(m, {R}) + 0.0 ORDER BY i) AS centroid
FROM m GROUP BY cid""")
def q_mdl_kmeans_step(spark, sf):
    """One k-means round from 10 seeded initial centers: assign, then mean."""
    e, centers, ids = _init_centers(spark, sf)
    st = CL.kmeans_step(e, centers, ids)
    return st.select(F.col("cluster").cast("bigint").alias("cluster"), "n", V.round_array("centroid", R).alias("centroid"))


@register("agg_inertia", SQL_INIT + f"\nSELECT round(sum(d * d), {R - 2}) AS inertia FROM asg")
def q_agg_inertia(spark, sf):
    """Σ squared distance of every vector to its assigned center."""
    e, centers, ids = _init_centers(spark, sf)
    a = CL.assign(e, centers, ids)
    return CL.inertia(a, centers, ids).select(F.round("inertia", R - 2).alias("inertia"))


@register("agg_silhouette", SQL_INIT + f""",
pd AS (SELECT a.vec_id, a.cid, b.cid AS cto, list_distance(a.x, b.x) AS d, list_distance(a.x, b.x) ^ 2 AS d2
       FROM asg a JOIN asg b ON a.vec_id <> b.vec_id),
pc AS (SELECT vec_id, cid, cto, avg(d) AS md, avg(d2) AS md2 FROM pd GROUP BY ALL),
ab AS (SELECT vec_id, max(md) FILTER (WHERE cid = cto) AS a, min(md) FILTER (WHERE cid <> cto) AS b,
              max(md2) FILTER (WHERE cid = cto) AS a2, min(md2) FILTER (WHERE cid <> cto) AS b2 FROM pc GROUP BY vec_id),
full_ AS (SELECT asg.vec_id, asg.cid, ab.a, ab.b, ab.a2, ab.b2, row_number() OVER (PARTITION BY asg.cid ORDER BY {sql_hash_u60(SEED, 'asg.vec_id')}, asg.vec_id) AS nth,
            count(*) OVER (PARTITION BY asg.cid) AS nc, count(*) OVER () AS total,
            CASE WHEN ab.a IS NULL OR ab.b IS NULL THEN 0.0 ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END AS s FROM asg LEFT JOIN ab USING (vec_id)),
strata AS (SELECT cid, avg(s) AS m, coalesce(var_samp(s), 0.0) AS v, count(*) AS k, any_value(nc) AS nc, any_value(total) AS total
           FROM full_ WHERE nth <= {CL.SAMPLED_ROWS} GROUP BY cid),
est AS (SELECT sum(nc / total * m) AS e, 1.96 * sqrt(sum((nc / total) ^ 2 * v / k * (1 - k / nc))) AS half FROM strata)
SELECT round(avg(s), {R}) AS silhouette_euclid,
       round(avg(CASE WHEN a2 IS NULL OR b2 IS NULL THEN 0.0 ELSE (b2 - a2) / greatest(a2, b2) END), {R}) AS silhouette_sq,
       round(any_value(e), {R}) AS silhouette_sampled, round(any_value(e - half), {R}) AS sampled_low, round(any_value(e + half), {R}) AS sampled_high
FROM full_, est""")
def q_agg_silhouette(spark, sf):
    """Mean silhouette of the seeded-center assignment, with Euclidean
    distance (exact, blocked pair sums), with squared Euclidean distance
    (exact, O(n K) from cluster sums), and estimated from 50 rows of each cluster
    with a 95 % interval (Euclidean, O(n))."""
    e, centers, ids = _init_centers(spark, sf)
    a = CL.assign(e, centers, ids)
    s1 = CL.silhouette_euclid(a, "vec_id").select(F.round("silhouette", R).alias("silhouette_euclid"))
    s2 = CL.silhouette_sq(a).select(F.round("silhouette", R).alias("silhouette_sq"))
    s3 = CL.silhouette_sampled(a, "vec_id", seed=SEED).select(F.round("silhouette", R).alias("silhouette_sampled"),
                                                              F.round("low", R).alias("sampled_low"), F.round("high", R).alias("sampled_high"))
    from quarry.operators.stats import _one_row_concat
    return _one_row_concat(_one_row_concat(s1, s2), s3)


@register("mdl_kmeans_sweep")
def q_mdl_kmeans_sweep(spark, sf):
    """k = 2..10, seeded by oversampling and run until no row moves: inertia and
    Euclidean silhouette per k."""
    e = emb(spark, sf)
    out = CL.lloyd_sweep(e, "vec_id", CL.seeds(e, "vec_id", range(2, 11), SEED))
    return out.select("k", "rounds", F.round("inertia", R - 2).alias("inertia"), F.round("silhouette", R).alias("silhouette"))
