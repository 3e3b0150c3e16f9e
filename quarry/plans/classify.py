"""Class-average classifier on ``embeddings`` and the evaluation tables that
read its predictions (the minimum end-to-end slice and its metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vec as V
from quarry.operators import centroid as C
from quarry.operators import metrics as M
from quarry.plans.common import SQL_CENTROIDS, SQL_EMB, emb
from quarry.plans.registry import register

R = 6  # rounding of every float output (both engines)


def _fit(spark, sf):
    """Test split and the class-average model of the training split."""
    e = emb(spark, sf)
    labels, vectors, _ = C.class_average_model(e.filter("split = 'train'"))
    return e, labels, vectors


def _scores(spark, sf, sim="cosine") -> DataFrame:
    e, labels, vectors = _fit(spark, sf)
    return C.scores_long(e.filter("split = 'test'"), labels, vectors, sim)


def _preds(spark, sf) -> DataFrame:
    """(vec_id, label, sim, pred) for the three similarity modes."""
    e, labels, vectors = _fit(spark, sf)
    test = e.filter("split = 'test'")
    cols = [F.struct(F.lit(s).alias("sim"),
                     C.argmax_label(C.score_columns(F.col("x"), labels, vectors, s), labels).alias("pred"))
            for s in C.SIMILARITIES]
    return test.select("vec_id", "label", F.explode(F.array(*cols)).alias("z")).select(
        "vec_id", "label", "z.sim", "z.pred")


def _cos_preds(spark, sf) -> DataFrame:
    return _preds(spark, sf).filter("sim = 'cosine'")


SQL_SCORES = f"""WITH {SQL_EMB}, {SQL_CENTROIDS},
s AS (SELECT e.vec_id, e.label, c.label AS cls,
             list_cosine_similarity(e.x, c.centroid) AS s_cosine,
             -list_distance(e.x, c.centroid) AS s_euc,
             list_inner_product(e.x, c.centroid) AS s_dot
      FROM e, c WHERE e.split = 'test'),
p AS (SELECT vec_id, label, sim, cls AS pred FROM (
        SELECT vec_id, label, sim, cls, row_number() OVER (PARTITION BY vec_id, sim ORDER BY score DESC, cls) AS rn
        FROM (SELECT vec_id, label, cls, 'cosine' AS sim, s_cosine AS score FROM s
              UNION ALL SELECT vec_id, label, cls, 'euc', s_euc FROM s
              UNION ALL SELECT vec_id, label, cls, 'dot', s_dot FROM s)) WHERE rn = 1),
pc AS (SELECT vec_id, label, pred FROM p WHERE sim = 'cosine'),
classes AS (SELECT label AS k FROM pc UNION SELECT pred FROM pc),
conf AS (SELECT a.k AS actual, b.k AS predicted, count(pc.vec_id) AS n
         FROM classes a CROSS JOIN classes b LEFT JOIN pc ON pc.label = a.k AND pc.pred = b.k
         GROUP BY a.k, b.k),
pcl AS (SELECT k.k AS cls,
               coalesce((SELECT n FROM conf WHERE actual = k.k AND predicted = k.k), 0) AS tp,
               (SELECT sum(n) FROM conf WHERE actual = k.k) AS support,
               (SELECT sum(n) FROM conf WHERE predicted = k.k) AS npred FROM classes k),
pcm AS (SELECT cls, tp, support, npred,
               CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pcl),
pcf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
        FROM pcm)"""


def _q_class_average(spark: SparkSession, sf: str) -> DataFrame:
    e = emb(spark, sf).filter("split = 'train'")
    return C.class_average_long(e).select("label", F.col("i").cast("long").alias("i"), F.round("mean", R).alias("mean"))


register("agg_class_average", f"""WITH {SQL_EMB}
SELECT label, i, round(avg(v), {R}) AS mean FROM (
  SELECT label, unnest(x) AS v, unnest(range(len(x))) AS i FROM e WHERE split = 'train') GROUP BY label, i""")(
    _q_class_average)


@register("join_nearest_centroid", SQL_SCORES + f"\nSELECT vec_id, cls, round(s_cosine, {R}) AS score FROM s")
def q_join_nearest_centroid(spark, sf):
    return _scores(spark, sf, "cosine").select("vec_id", "cls", F.round("score", R).alias("score"))


@register("agg_argmax", SQL_SCORES + "\nSELECT vec_id, pred FROM p WHERE sim = 'cosine'")
def q_agg_argmax(spark, sf):
    s = _scores(spark, sf, "cosine")
    return s.groupBy("vec_id").agg(F.max_by("cls", F.struct(F.col("score"), -F.col("cls"))).alias("pred"))


@register("mdl_class_average", SQL_SCORES + "\nSELECT vec_id, label, sim, pred FROM p")
def q_mdl_class_average(spark, sf):
    return _preds(spark, sf)


@register("agg_accuracy", SQL_SCORES + f"""
SELECT sim, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), {R}) AS accuracy, count(*) AS n FROM p GROUP BY sim""")
def q_agg_accuracy(spark, sf):
    a = M.accuracy(_preds(spark, sf), by=["sim"])
    return a.select("sim", F.round("accuracy", R).alias("accuracy"), "n")


@register("agg_confusion", SQL_SCORES + "\nSELECT actual, predicted, n FROM conf")
def q_agg_confusion(spark, sf):
    return M.confusion(_cos_preds(spark, sf))


@register("agg_class_report", SQL_SCORES + f""",
tot AS (SELECT sum(tp) AS tp, sum(support) AS n, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
               sum(f1 * support) / sum(support) AS wf FROM pcf)
SELECT CAST(cls AS VARCHAR) AS cls, round(precision, {R}) AS precision, round(recall, {R}) AS recall,
       round(f1, {R}) AS f1, CAST(support AS BIGINT) AS support FROM pcf
UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / n, {R}), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(mp, {R}), round(mr, {R}), round(mf, {R}), CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', round(wp, {R}), round(wr, {R}), round(wf, {R}), CAST(n AS BIGINT) FROM tot""")
def q_agg_class_report(spark, sf):
    r = M.class_report(M.confusion(_cos_preds(spark, sf)))
    return r.select("cls", *[F.round(c, R).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("agg_f1_weighted", SQL_SCORES + f"""
SELECT round(sum(f1 * support) / sum(support), {R}) AS f1_weighted FROM pcf""")
def q_agg_f1_weighted(spark, sf):
    return M.f1_weighted(M.confusion(_cos_preds(spark, sf))).select(F.round("f1_weighted", R).alias("f1_weighted"))


@register("agg_mcc", SQL_SCORES + f""",
m AS (SELECT sum(support)::DOUBLE AS s, sum(support * npred)::DOUBLE AS tp_, sum(support * support)::DOUBLE AS tt,
             sum(npred * npred)::DOUBLE AS pp, sum(tp)::DOUBLE AS c FROM pcl)
SELECT round(CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (c * s - tp_) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0.0 END, {R}) AS mcc FROM m""")
def q_agg_mcc(spark, sf):
    return M.mcc(M.confusion(_cos_preds(spark, sf))).select(F.round("mcc", R).alias("mcc"))


@register("agg_hard_vote", SQL_SCORES + """,
v AS (SELECT vec_id, pred, count(*) AS n FROM p GROUP BY vec_id, pred)
SELECT vec_id, pred FROM (SELECT vec_id, pred, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, pred) AS rn FROM v)
WHERE rn = 1""")
def q_agg_hard_vote(spark, sf):
    return M.hard_vote(_preds(spark, sf).select("vec_id", "pred"))


SQL_PROBS = SQL_SCORES + """,
lp AS (SELECT vec_id, cls, 'cosine' AS sim, s_cosine AS score FROM s
       UNION ALL SELECT vec_id, cls, 'euc', s_euc FROM s UNION ALL SELECT vec_id, cls, 'dot', s_dot FROM s),
lm AS (SELECT *, max(score) OVER (PARTITION BY vec_id, sim) AS mx FROM lp),
pr AS (SELECT vec_id, cls, sim, exp(score - mx) / sum(exp(score - mx)) OVER (PARTITION BY vec_id, sim) AS prob FROM lm)"""


def _probs(spark, sf):
    e, labels, vectors = _fit(spark, sf)
    test = e.filter("split = 'test'")
    sims = F.array(*[F.struct(F.lit(s).alias("sim"), C.score_columns(F.col("x"), labels, vectors, s).alias("scores"))
                     for s in C.SIMILARITIES])
    lab = F.array(*[F.lit(c) for c in labels])
    allsc = (test.select("vec_id", F.explode(sims).alias("t"))
             .select("vec_id", "t.sim", F.explode(F.arrays_zip(lab.alias("cls"), F.col("t.scores").alias("score"))).alias("z"))
             .select("vec_id", "sim", "z.cls", "z.score"))
    return M.softmax_group(allsc, ["vec_id", "sim"])


@register("agg_soft_vote", SQL_PROBS + """,
m AS (SELECT vec_id, cls, avg(prob) AS p FROM pr GROUP BY vec_id, cls)
SELECT vec_id, pred FROM (SELECT vec_id, cls AS pred, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS rn FROM m)
WHERE rn = 1""")
def q_agg_soft_vote(spark, sf):
    return M.soft_vote(_probs(spark, sf))


@register("win_softmax_group", SQL_PROBS + f"\nSELECT vec_id, cls, round(prob, {R}) AS prob FROM pr WHERE sim = 'cosine'")
def q_win_softmax_group(spark, sf):
    return M.softmax_group(_scores(spark, sf, "cosine"), ["vec_id"]).select(
        "vec_id", "cls", F.round("prob", R).alias("prob"))


@register("agg_cross_entropy", SQL_SCORES + f""",
sm AS (SELECT *, max(s_cosine) OVER (PARTITION BY vec_id) AS mx FROM s),
ls AS (SELECT vec_id, label, cls, s_cosine - (mx + ln(sum(exp(s_cosine - mx)) OVER (PARTITION BY vec_id))) AS logp FROM sm)
SELECT round(-avg(logp), {R}) AS cross_entropy, count(*) AS n FROM ls WHERE cls = label AND label <> -100""")
def q_agg_cross_entropy(spark, sf):
    e = emb(spark, sf).filter("split = 'test'")
    ce = M.cross_entropy(_scores(spark, sf, "cosine"), e, ignore_index=-100)
    return ce.select(F.round("cross_entropy", R).alias("cross_entropy"), "n")


@register("agg_cross_entropy_batches", SQL_SCORES + f""",
sm AS (SELECT *, max(s_cosine) OVER (PARTITION BY vec_id) AS mx FROM s),
ls AS (SELECT vec_id, label, cls, s_cosine - (mx + ln(sum(exp(s_cosine - mx)) OVER (PARTITION BY vec_id))) AS logp FROM sm),
b AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch FROM e WHERE split = 'test'),
m AS (SELECT batch, -avg(logp) AS loss FROM ls JOIN b USING (vec_id) WHERE cls = label GROUP BY batch)
SELECT round(avg(loss), {R}) AS cross_entropy, count(*) AS n_batches FROM m""")
def q_agg_cross_entropy_batches(spark, sf):
    """Mean over batches (64 consecutive test rows) of each batch's mean loss,
    as a training loop reports it: a short last batch counts like the others."""
    from quarry.operators.ordering import with_global_index
    test = emb(spark, sf).filter("split = 'test'")
    b = with_global_index(test.select("vec_id", "label"), ["vec_id"], "_i").withColumn("batch", F.expr("_i div 64"))
    losses = M.sample_losses(_scores(spark, sf, "cosine"), b.select("vec_id", "label", "batch"), keep=["batch"])
    m = losses.groupBy("batch").agg(F.avg("loss").alias("loss"))
    return m.agg(F.round(F.avg("loss"), R).alias("cross_entropy"), F.count("*").alias("n_batches"))


def _compare(spark, sf):
    """Accuracy, RMSE of the class number and share of zero weights by model."""
    e, labels, vectors = _fit(spark, sf)
    weights = [v for vec in vectors for v in vec]
    sparsity = sum(v == 0 for v in weights) / len(weights) if weights else None
    p = _preds(spark, sf)
    return p.groupBy(F.col("sim").alias("model")).agg(
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"),
        F.sqrt(F.avg(F.pow(F.col("pred") - F.col("label"), 2))).alias("rmse"), F.lit(sparsity).cast("double").alias("sparsity"),
        F.count("*").alias("n"))


@register("agg_compare_models", SQL_SCORES + f""",
w AS (SELECT avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) AS sparsity FROM (SELECT unnest(centroid) AS v FROM c))
SELECT sim AS model, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), {R}) AS accuracy,
       round(sqrt(avg((pred - label) ^ 2)), {R}) AS rmse, round(any_value(sparsity), {R}) AS sparsity, count(*) AS n
FROM p, w GROUP BY sim""")
def q_agg_compare_models(spark, sf):
    return _compare(spark, sf).select("model", *[F.round(c, R).alias(c) for c in ("accuracy", "rmse", "sparsity")], "n")


@register("srt_results", SQL_SCORES + f""",
cm AS (SELECT sim AS model, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM p GROUP BY sim)
SELECT model, round(accuracy, {R}) AS accuracy, row_number() OVER (ORDER BY accuracy DESC, model) AS rank FROM cm""")
def q_srt_results(spark, sf):
    from pyspark.sql import Window
    cm = _compare(spark, sf)  # one row per model: the window sorts a handful of rows
    return cm.select("model", F.round("accuracy", R).alias("accuracy"),
                     F.row_number().over(Window.orderBy(F.desc("accuracy"), "model")).cast("long").alias("rank"))


SQL_TWO_CENTROIDS = f"""WITH {SQL_EMB}, {SQL_CENTROIDS},
ct AS (SELECT label, list(m ORDER BY i) AS centroid FROM (
        SELECT label, i, avg(v) AS m FROM (
          SELECT label, unnest(x) AS v, unnest(range(len(x))) AS i FROM e WHERE split = 'test')
        GROUP BY label, i) GROUP BY label),
d AS (SELECT c.label AS a, ct.label AS b, list_inner_product(c.centroid, ct.centroid) AS dot,
             list_cosine_similarity(c.centroid, ct.centroid) AS cosine FROM c, ct)"""


@register("join_similarity_matrix", SQL_TWO_CENTROIDS + f"""
SELECT a, b, round(dot, {R}) AS dot, round(exp(dot - mx) / sum(exp(dot - mx)) OVER (PARTITION BY a), {R}) AS softmax,
       round(cosine, {R}) AS cosine FROM (SELECT *, max(dot) OVER (PARTITION BY a) AS mx FROM d)""")
def q_join_similarity_matrix(spark, sf):
    """Class means of the train split against those of the test split: a
    K x K product written as an equi-join on the coordinate index."""
    from quarry.operators.linalg import matmul_long
    e = emb(spark, sf)
    a = C.class_average_long(e.filter("split = 'train'")).select(F.col("label").alias("row"), "i", F.col("mean").alias("v"))
    b = C.class_average_long(e.filter("split = 'test'")).select(F.col("label").alias("col"), "i", F.col("mean").alias("v"))
    dots = matmul_long(a, b.select(F.col("i"), F.col("col"), "v"), "row", "i", "col").withColumnRenamed("value", "dot")
    na = a.groupBy("row").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("na"))
    nb = b.groupBy("col").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nb"))
    t = dots.join(na, "row").join(nb, "col")
    t = M.softmax_group(t, ["row"], score="dot", out="softmax")
    return t.select(F.col("row").alias("a"), F.col("col").alias("b"), F.round("dot", R).alias("dot"),
                    F.round("softmax", R).alias("softmax"),
                    F.round(F.col("dot") / (F.col("na") * F.col("nb")), R).alias("cosine"))


@register("join_similarity_weights")
def q_join_similarity_weights(spark, sf):
    """Class means of the train split against the weights of the multi-output
    least-squares model (no intercept): dot, cosine and row softmax of the
    K x K products. The weights come from a pseudo-inverse, which SQL lacks."""
    from quarry.operators import gram as G
    from quarry.operators import linear as L
    from quarry.operators.linalg import matmul_long
    from quarry.operators.small import local_frame
    train = emb(spark, sf).filter("split = 'train'")
    labels, vectors, _ = C.class_average_model(train)
    theta = L.ols_multi(G.gram_matrix(G.gram(train.withColumn("y", V.onehot("label", 10)), "x", "y")), len(vectors[0]))
    a = local_frame(spark, [(l, i, v) for l, vec in zip(labels, vectors) for i, v in enumerate(vec)], "row int, i int, v double")
    b = local_frame(spark, [(i, k, float(theta[i, k])) for i in range(theta.shape[0]) for k in range(theta.shape[1])], "i int, col int, v double")
    dots = matmul_long(a, b, "row", "i", "col").withColumnRenamed("value", "dot")
    size = lambda df, c, name: df.groupBy(c).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias(name))
    t = M.softmax_group(dots.join(size(a, "row", "na"), "row").join(size(b, "col", "nb"), "col"), ["row"], score="dot", out="softmax")
    return t.select(F.col("row").alias("a"), F.col("col").alias("b"), F.round("dot", R).alias("dot"), F.round("softmax", R).alias("softmax"),
                    F.round(F.col("dot") / (F.col("na") * F.col("nb")), R).alias("cosine"))


@register("join_zero_shot", SQL_SCORES + f"""
SELECT vec_id, pred, round(score, {R}) AS score FROM (
  SELECT vec_id, cls AS pred, s_cosine AS score, row_number() OVER (PARTITION BY vec_id ORDER BY s_cosine DESC, cls) AS rn FROM s)
WHERE rn = 1""")
def q_join_zero_shot(spark, sf):
    """Each test item to its nearest label vector by cosine (label vectors =
    normalised class means of the training split), with the winning score."""
    s = _scores(spark, sf, "cosine")
    best = s.groupBy("vec_id").agg(F.max_by(F.struct("cls", "score"), F.struct(F.col("score"), -F.col("cls"))).alias("b"))
    return best.select("vec_id", F.col("b.cls").alias("pred"), F.round("b.score", R).alias("score"))


@register("win_maxabs_norm", f"""WITH {SQL_EMB}, {SQL_CENTROIDS},
u AS (SELECT label, unnest(centroid) AS v, unnest(range(len(centroid))) AS i FROM c)
SELECT label, i, round(v / greatest(max(abs(v)) OVER (PARTITION BY label), 1e-8), {R}) AS value FROM u""")
def q_win_maxabs_norm(spark, sf):
    """Per-class max-abs scaling of the class means. The per-class maxima are
    a grouped aggregate joined back (K rows), not a window that
    would pull each class into one task."""
    e = emb(spark, sf).filter("split = 'train'")
    long = C.class_average_long(e)
    mx = long.groupBy("label").agg(F.greatest(F.max(F.abs("mean")), F.lit(1e-8)).alias("m"))
    return long.join(mx, "label").select(
        "label", F.col("i").cast("long").alias("i"), F.round(F.col("mean") / F.col("m"), R).alias("value"))


@register("join_matmul", f"""WITH {SQL_EMB}, {SQL_CENTROIDS},
a AS (SELECT vec_id, unnest(range(len(x))) AS j, unnest(x) AS v FROM e WHERE split = 'test'),
b AS (SELECT label AS k, unnest(range(len(centroid))) AS j, unnest(centroid) AS w FROM c)
SELECT vec_id, k, round(sum(v * w), {R}) AS value FROM a JOIN b USING (j) GROUP BY vec_id, k""")
def q_join_matmul(spark, sf):
    """X Wᵀ in long form: test vectors (row, j, v) times the class-mean
    matrix transposed (j, k, w) — an equi-join on the inner index j (the
    K x d side is broadcast after a size check) and a grouped sum; partial
    sums combine map-side because one row's cells sit in one partition."""
    from quarry.operators.linalg import matmul_long, to_long, transpose_long
    e = emb(spark, sf)
    a = to_long(e.filter("split = 'test'"), "vec_id", "x", "vec_id", "j", "v")
    w = C.class_average_long(e.filter("split = 'train'")).select(F.col("label").alias("k"), F.col("i").cast("long").alias("j"),
                                                                 F.col("mean").alias("v"))
    wt = transpose_long(w, "k", "j")  # (k, j) -> (j, k): column names swap
    out = matmul_long(a, wt.select(F.col("k").alias("j"), F.col("j").alias("k"), "v"), "vec_id", "j", "k")
    return out.select("vec_id", "k", F.round("value", R).alias("value"))
