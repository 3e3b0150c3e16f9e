"""Fitted-model plans (Spark ML): predictions of the test split. These are
iterative fits, so the correctness gate is rows-only; own property tests
live in tests/."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import kernel as K
from quarry.operators import metrics as M
from quarry.operators import models as MD
from quarry.operators import prep as P
from quarry.operators import trees as TR
from quarry.plans.common import SEED, emb, tbl
from quarry.plans.registry import register
from quarry.session import cut_lineage

R = 6


def _xy(spark, sf, binary=False):
    e = emb(spark, sf)
    if binary:
        e = e.filter(F.col("label").isin(0, 1))
    e = MD.with_vector(e).withColumn("label", F.col("label").cast("double"))
    return e.filter("split = 'train'"), e.filter("split = 'test'")


def _arrays(spark, sf):
    e = emb(spark, sf).withColumn("label", F.col("label").cast("double"))
    return e.filter("split = 'train'"), e.filter("split = 'test'")


def _with_accuracy(preds, *scores):
    """Add the accuracy of the predictions (and given scores) to every row."""
    preds = cut_lineage(preds)
    share = preds.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    cols = {"accuracy": share, **dict(scores)}
    return preds.withColumns({c: F.round(F.lit(v).cast("double"), R) for c, v in cols.items()})


@register("mdl_logistic")
def q_mdl_logistic(spark, sf):
    """Multinomial logistic regression, L2 with C = 1, 200 iterations."""
    tr, te = _xy(spark, sf)
    return MD.predict(MD.logistic(tr), te, "vec_id")


@register("mdl_svm")
def q_mdl_svm(spark, sf):
    """Max-margin classifier on classes 0/1, C = 1: linear, and with the RBF
    kernel (gamma = 'scale') on landmarks."""
    tr, te = _xy(spark, sf, binary=True)
    lin = MD.predict(MD.linear_svm(tr), te, "vec_id", name="linear")
    machine = K.fit_rbf_svm(tr, "vec_id", gamma=MD.rbf_gamma_scale(tr, "x"), seed=SEED)
    return lin.unionByName(machine.predict(te, "vec_id").withColumn("model", F.lit("rbf")))


@register("mdl_tree")
def q_mdl_tree(spark, sf):
    tr, te = _xy(spark, sf)
    return MD.tree_predictions(tr, te, "vec_id", seed=SEED)


@register("mdl_random_forest")
def q_mdl_random_forest(spark, sf):
    """100 trees on Poisson bags, sqrt features per split, with the test accuracy
    and the out-of-bag score of the same trees: the share of training rows that
    the trees that haven't seen them vote right on."""
    tr, te = _arrays(spark, sf)
    forest = TR.fit_forest(tr, "vec_id", 100, seed=SEED)
    score = forest.out_of_bag().agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    return _with_accuracy(forest.predict(te, "vec_id"), ("oob_score", score))


@register("mdl_random_forest_reg")
def q_mdl_random_forest_reg(spark, sf):
    """100-tree regressor: part price from size, brand and type indices."""
    p = tbl(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type", F.col("p_retailprice").alias("y"))
    p = P.label_encode(P.label_encode(p, "p_brand"), "p_type")
    p = P.exact_split(p, "p_partkey", 0.25, SEED)
    p = MD.with_vector(p.withColumn("x", F.array(F.col("p_size").cast("double"), F.col("p_brand_idx").cast("double"),
                                                  F.col("p_type_idx").cast("double"))))
    m = MD.forest_values(p.filter("split = 'train'"), p.filter("split = 'test'"), "p_partkey")
    return m.select("p_partkey", "y", F.round("prediction", R).alias("pred"))


@register("mdl_voting")
def q_mdl_voting(spark, sf):
    """Logistic + tree + linear SVM (one against the rest), hard vote over
    all classes, with its accuracy."""
    tr, te = _xy(spark, sf)
    u = MD.tree_predictions(tr, te, "vec_id", seed=SEED)
    tr = MD.fit_rows(tr)
    try:
        models = [MD.logistic(tr), MD.one_vs_rest(MD.svm_estimator(tr), tr)]
    finally:
        tr.unpersist()
    for m in models:
        u = u.unionByName(MD.predict(m, te, "vec_id"))
    voted = M.hard_vote(u.select("vec_id", "pred")).join(te.select("vec_id", F.col("label").cast("int").alias("label")), "vec_id")
    return _with_accuracy(voted)


@register("mdl_stacking")
def q_mdl_stacking(spark, sf):
    """Base logistic + tree, meta forest of 50 on out-of-fold probabilities."""
    tr, te = _xy(spark, sf)
    return MD.stacking(tr, te, "vec_id", 5, seed=SEED)


@register("mdl_bagging")
def q_mdl_bagging(spark, sf):
    """20 random-feature trees on Poisson bootstrap bags, grown together;
    out-of-bag predictions of training rows and test predictions, both by
    majority vote."""
    tr, te = _arrays(spark, sf)
    forest = TR.fit_forest(tr, "vec_id", 20, seed=SEED)
    forest.hard = True
    oob = forest.out_of_bag().select(F.col("id").alias("vec_id"), F.col("y").cast("double").alias("label"), "pred", F.lit("oob").alias("split"))
    test = forest.predict(te, "vec_id").withColumn("split", F.lit("test"))
    return oob.unionByName(test)


@register("mdl_boosting")
def q_mdl_boosting(spark, sf):
    """Gradient-boosted trees on the softmax loss of all classes at once: 20
    rounds of depth 5, with the test accuracy."""
    tr, te = _arrays(spark, sf)
    return _with_accuracy(TR.fit_boosting(tr, "vec_id", rounds=20, max_depth=5).predict(te, "vec_id"))


@register("mdl_mlp")
def q_mdl_mlp(spark, sf):
    """Feed-forward classifier 64-128-64-10 (sigmoid hidden units, L-BFGS):
    predictions with the mean cross-entropy and the accuracy on the test rows."""
    from pyspark.ml.functions import vector_to_array
    tr, te = _xy(spark, sf)
    out = MD.mlp(tr, [64, 128, 64, 10]).transform(te)
    own = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    p = cut_lineage(out.select("vec_id", "label", F.col("prediction").cast("int").alias("pred"),
                               (-F.log(F.greatest(own, F.lit(1e-15)))).alias("loss")))
    return _with_accuracy(p.drop("loss"), ("loss", p.agg(F.avg("loss")).first()[0]))


_C = {"t": "l_extendedprice", "p": "l_quantity", "q": "l_discount", "r": "l_tax"}


@register("prep_pipeline", f"""WITH m AS (SELECT {", ".join(
    f"covar_pop({_C[u]}, {_C[v]}) AS {u}{v}" for u, v in ("pp", "pq", "pr", "qq", "qr", "rr", "pt", "qt", "rt", "tt"))},
       count(*) AS n FROM lineitem),
d AS (SELECT *, pp * (qq * rr - qr * qr) - pq * (pq * rr - qr * pr) + pr * (pq * qr - qq * pr) AS det FROM m),
w AS (SELECT *, (pt * (qq * rr - qr * qr) - pq * (qt * rr - qr * rt) + pr * (qt * qr - qq * rt)) / det AS wp,
                (pp * (qt * rr - qr * rt) - pt * (pq * rr - qr * pr) + pr * (pq * rt - qt * pr)) / det AS wq,
                (pp * (qq * rt - qt * qr) - pq * (pq * rt - qt * pr) + pt * (pq * qr - qq * pr)) / det AS wr FROM d)
SELECT round(sqrt(tt - wp * pt - wq * qt - wr * rt), 4) AS rmse, n FROM w""")
def q_prep_pipeline(spark, sf):
    """Assemble -> standardise -> linear regression as one fitted pipeline."""
    li = tbl(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    m = MD.pipeline_regression(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    pr = m.transform(li)
    return pr.agg(F.round(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("l_extendedprice"), 2))), 4).alias("rmse"), F.count("*").alias("n"))


@register("mdl_token_probe")
def q_mdl_token_probe(spark, sf):
    """Per-character label (letter / space / other) by a logistic probe trained
    on the train split of conversations, from the one-hot characters of a +-1
    window and from the embedding of the character (zeros for one that has
    none, which stays in the counts): the confusion counts on
    valid and test, with weighted F1 and accuracy of each. Equal windows are
    counted first and weigh as much as they occur, so the fits and the metrics
    run on distinct windows, not on characters."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from quarry.operators import text as T
    c = tbl(spark, sf, "conversations").select("conv_id", "turn", "text")
    c = T.encode_frame(c, TX.chars("text"), T.vocabulary(c, TX.chars("text")), "ids")
    c = P.hash_split(c, "conv_id", {"train": 0.8, "valid": 0.1, "test": 0.1}, SEED)
    ids, n = F.col("ids"), F.size("ids")
    prev = F.concat(F.array(F.lit(0)), F.slice(ids, 1, F.greatest(n - 1, F.lit(0))))
    nxt = F.concat(F.slice(ids, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(0)))
    z = F.arrays_zip(TX.chars("text").alias("ch"), ids.alias("cur"), prev.alias("prev"), nxt.alias("next"))
    lab = F.when(TX.char_class(F.col("t.ch")) == "L", 0).when(TX.char_class(F.col("t.ch")) == "O", 1).otherwise(2)
    tok = cut_lineage(c.filter(n > 0).select("split", F.explode(z).alias("t"))
                      .groupBy("split", "t.prev", "t.cur", "t.next", lab.cast("double").alias("label")).agg(F.count("*").alias("n")))
    enc = OneHotEncoder(inputCols=["prev", "cur", "next"], outputCols=["o1", "o2", "o3"], dropLast=False,
                        handleInvalid="keep").fit(tok)
    onehot = VectorAssembler(inputCols=["o1", "o2", "o3"], outputCol="features").transform(enc.transform(tok))
    table = tbl(spark, sf, "embeddings").select(F.col("vec_id").alias("cur"), F.col("embedding").alias("x"))
    width = table.agg(F.max(F.size("x"))).first()[0] or 1
    zero = F.array_repeat(F.lit(0.0), width)  # of a token that the embedding table doesn't have
    every = (tok.groupBy("split", "cur", "label").agg(F.sum("n").alias("n")).join(table, "cur", "left")
             .withColumn("x", F.coalesce(F.col("x").cast("array<double>"), zero)))
    counts = None
    for name, feats in (("onehot", onehot), ("embedding", MD.with_vector(every))):
        feats = feats.select("split", "label", "n", "features").persist()
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="n", maxIter=50, regParam=1e-4)
        pred = lr.fit(feats.filter("split = 'train'")).transform(feats.filter("split != 'train'"))
        part = cut_lineage(pred.groupBy(F.lit(name).alias("features"), "split", F.col("label").cast("int").alias("actual"),
                                        F.col("prediction").cast("int").alias("predicted")).agg(F.sum("n").alias("n")))
        feats.unpersist()
        counts = part if counts is None else counts.unionByName(part)
    by = ["features", "split"]
    conf = M.confusion_grid(counts, by)
    return conf.join(M.f1_weighted(conf, by), by)
