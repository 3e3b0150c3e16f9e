"""Vector functions and projections over ``embeddings`` (and a few scalar
columns of ``lineitem``/``part``/``orders``). Pure narrow projections: each
plan is a single scan stage inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import vec as V
from quarry.operators import centroid as C
from quarry.operators.ordering import with_global_index
from quarry.plans.common import SQL_CENTROIDS, SQL_EMB, emb, tbl
from quarry.plans.registry import register

R = 6
E = f"WITH {SQL_EMB}\n"


def ra(col):
    return V.round_array(col, R)


def sra(expr: str) -> str:
    return f"list_transform({expr}, lambda v: round(v, {R}) + 0.0)"


def rev(col="x"):
    return F.reverse(F.col(col))


@register("vec_add_mul", f"""WITH {SQL_EMB},
mu AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(v) AS m FROM (
         SELECT unnest(x) AS v, unnest(range(len(x))) AS i FROM e) GROUP BY i))
SELECT vec_id,
  {sra('list_transform(range(1, len(x) + 1), lambda i: x[i] + list_reverse(x)[i])')} AS plus,
  {sra('list_transform(range(1, len(x) + 1), lambda i: x[i] * list_reverse(x)[i])')} AS times,
  {sra('list_transform(range(1, len(x) + 1), lambda i: x[i] - mean[i])')} AS centred
FROM e, mu""")
def q_vec_add_mul(spark, sf):
    """Element-wise sum and product, and a row-broadcast subtraction of the
    column-mean vector (a one-row aggregate shipped as a literal)."""
    e = emb(spark, sf)
    mean = (e.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i"))
    from quarry.operators.small import collect_small
    mu = [r["m"] for r in collect_small(mean, "mean vector")]  # d values
    return e.select("vec_id", ra(V.add("x", rev())).alias("plus"), ra(V.mul("x", rev())).alias("times"),
                    ra(V.sub("x", V.lit_vector(mu))).alias("centred"))


@register("vec_dot", E + f"SELECT vec_id, round(list_inner_product(x, list_reverse(x)), {R}) AS dot FROM e")
def q_vec_dot(spark, sf):
    return emb(spark, sf).select("vec_id", F.round(V.dot("x", rev()), R).alias("dot"))


@register("vec_norm", E + f"""SELECT vec_id,
  round(list_sum(list_transform(x, lambda v: abs(v))), {R}) AS l1,
  round(sqrt(list_sum(list_transform(x, lambda v: v * v))), {R}) AS l2,
  round(pow(list_sum(list_transform(x, lambda v: pow(abs(v), 3.0))), 1.0 / 3.0), {R}) AS l3,
  round(list_max(list_transform(x, lambda v: abs(v))), {R}) AS linf FROM e""")
def q_vec_norm(spark, sf):
    e = emb(spark, sf)
    return e.select("vec_id", *[F.round(V.norm("x", p), R).alias(n) for p, n in
                                ((1, "l1"), (2, "l2"), (3, "l3"), (float("inf"), "linf"))])


@register("vec_l2_normalize", E + f"""SELECT vec_id,
  {sra('list_transform(x, lambda v: v / greatest(sqrt(list_sum(list_transform(x, lambda w: w * w))), 1e-12))')} AS xn FROM e""")
def q_vec_l2_normalize(spark, sf):
    return emb(spark, sf).select("vec_id", ra(V.l2_normalize("x")).alias("xn"))


@register("vec_cosine", E + f"SELECT vec_id, round(list_cosine_similarity(x, list_reverse(x)), {R}) AS cosine FROM e")
def q_vec_cosine(spark, sf):
    return emb(spark, sf).select("vec_id", F.round(V.cosine("x", rev()), R).alias("cosine"))


@register("vec_euclid", E + f"""SELECT vec_id, round(list_distance(x, list_reverse(x)), {R}) AS dist,
  round(-list_distance(x, list_reverse(x)), {R}) AS score FROM e""")
def q_vec_euclid(spark, sf):
    d = V.euclid("x", rev())
    return emb(spark, sf).select("vec_id", F.round(d, R).alias("dist"), F.round(-d, R).alias("score"))


@register("vec_softmax", E + f"""SELECT vec_id,
  {sra('list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda w: exp(w - list_max(x)))))')} AS softmax,
  {sra('list_transform(x, lambda v: v - (list_max(x) + ln(list_sum(list_transform(x, lambda w: exp(w - list_max(x)))))))')} AS log_softmax
FROM e""")
def q_vec_softmax(spark, sf):
    return emb(spark, sf).select("vec_id", ra(V.softmax("x")).alias("softmax"), ra(V.log_softmax("x")).alias("log_softmax"))


_ACT_SQL = {
    "relu": "greatest(0.0, v)",
    "sigmoid": "1.0 / (1.0 + exp(-v))",
    "tanh": "tanh(v)",
    "silu": "v / (1.0 + exp(-v))",
    "gelu": "0.5 * v * (1.0 + tanh(sqrt(2.0 / pi()) * (v + 0.044715 * v * v * v)))",
}


@register("vec_activations", E + "SELECT vec_id, act, value FROM (" + " UNION ALL ".join(
    f"SELECT vec_id, '{k}' AS act, {sra(f'list_transform(list_transform(x, lambda w: w * 4.0), lambda v: {s})')} AS value FROM e"
    for k, s in _ACT_SQL.items()) + ")")
def q_vec_activations(spark, sf):
    e = emb(spark, sf).select("vec_id", V.scale("x", 4.0).alias("x4"))
    each = F.array(*[F.struct(F.lit(k).alias("act"), ra(V.activation("x4", k)).alias("value")) for k in _ACT_SQL])
    return e.select("vec_id", F.explode(each).alias("a")).select("vec_id", "a.act", "a.value")


@register("vec_layernorm", E + f"""SELECT vec_id, {sra('list_transform(x, lambda v: (v - mu) / sqrt(var + 1e-5))')} AS ln
FROM (SELECT vec_id, x, list_avg(x) AS mu, list_sum(list_transform(x, lambda v: (v - list_avg(x)) * (v - list_avg(x)))) / len(x) AS var FROM e)""")
def q_vec_layernorm(spark, sf):
    return emb(spark, sf).select("vec_id", ra(V.layernorm("x")).alias("ln"))


@register("vec_batchnorm", f"""WITH o AS (SELECT o_orderkey, o_totalprice,
      (row_number() OVER (ORDER BY o_orderkey) - 1) // 512 AS batch FROM orders),
st AS (SELECT batch, avg(o_totalprice) AS mu, var_pop(o_totalprice) AS var FROM o GROUP BY batch)
SELECT o_orderkey, batch, round((o_totalprice - mu) / sqrt(var + 1e-5), {R}) AS z FROM o JOIN st USING (batch)""")
def q_vec_batchnorm(spark, sf):
    """Batch normalisation of a column: batches of 512 consecutive orders
    (distributed global index), per-batch mean/population variance by a
    grouped aggregate joined back."""
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    o = with_global_index(o, ["o_orderkey"], "idx").withColumn("batch", F.expr("idx div 512"))
    st = o.groupBy("batch").agg(F.avg("o_totalprice").alias("mu"), F.var_pop("o_totalprice").alias("var"))
    return o.join(st, "batch").select("o_orderkey", "batch",
                                      F.round((F.col("o_totalprice") - F.col("mu")) / F.sqrt(F.col("var") + 1e-5), R).alias("z"))


@register("win_batch_id", """SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch,
  (row_number() OVER (ORDER BY o_orderkey) - 1) % 64 AS pos_in_batch FROM orders""")
def q_win_batch_id(spark, sf):
    o = with_global_index(tbl(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "idx")
    return o.select("o_orderkey", F.expr("idx div 64").alias("batch"),
                    (F.col("idx") % 64).cast("long").alias("pos_in_batch"))


@register("vec_linear", f"""WITH {SQL_EMB}, {SQL_CENTROIDS}
SELECT e.vec_id, c.label AS k, round(list_inner_product(c.centroid, e.x) + 0.1 * c.label, {R}) AS y
FROM e, c WHERE e.split = 'test'""")
def q_vec_linear(spark, sf):
    """y = W x + b with W = class means of the training split (one row per
    output), b_k = 0.1 k; W is a small fitted model shipped as a literal."""
    e = emb(spark, sf)
    labels, vectors = C.fetch_centroids(C.class_average(e.filter("split = 'train'")))
    y = V.linear(F.col("x"), V.lit_matrix(vectors), V.lit_vector([0.1 * l for l in labels]))
    lab = F.array(*[F.lit(l) for l in labels])
    return (e.filter("split = 'test'").select("vec_id", F.arrays_zip(lab.alias("k"), y.alias("y")).alias("z"))
            .select("vec_id", F.explode("z").alias("t")).select("vec_id", "t.k", F.round("t.y", R).alias("y")))


@register("vec_onehot", E + "SELECT vec_id, list_transform(range(10), lambda j: CASE WHEN j = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS onehot FROM e")
def q_vec_onehot(spark, sf):
    return emb(spark, sf).select("vec_id", V.onehot("label", 10).alias("onehot"))


@register("vec_sinusoid_pe", E + f"""SELECT vec_id, vec_id % 10 AS pos, {sra(
    "list_transform(range(64), lambda j: CASE WHEN j % 2 = 0 THEN sin((vec_id % 10) / pow(10000.0, (j - j % 2) / 64.0)) ELSE cos((vec_id % 10) / pow(10000.0, (j - j % 2) / 64.0)) END)")} AS pe FROM e""")
def q_vec_sinusoid_pe(spark, sf):
    """Position vectors (base 10000) for the in-sequence position of each
    vector (sequences of 10 consecutive ids, as in the attention plans)."""
    e = emb(spark, sf).withColumn("pos", F.col("vec_id") % 10)
    return e.select("vec_id", "pos", ra(V.sinusoid_position("pos", 64)).alias("pe"))


@register("vec_linspace", f"""WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT i, round(lo + (hi - lo) * i / 10.0, {R - 2}) AS value FROM m, range(11) t(i)""")
def q_vec_linspace(spark, sf):
    """11-point grid spanning the observed price range (min/max aggregate,
    then a generated sequence)."""
    m = tbl(spark, sf, "lineitem").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    g = m.select(F.posexplode(V.linspace("lo", "hi", 11)).alias("i", "value"))
    return g.select(F.col("i").cast("long").alias("i"), F.round("value", R - 2).alias("value"))


@register("vec_neg_cosine_loss", f"""WITH {SQL_EMB}, {SQL_CENTROIDS}
SELECT round(avg(-list_cosine_similarity(e.x, c.centroid)), {R}) AS loss, count(*) AS n
FROM e JOIN c ON e.label = c.label WHERE e.split = 'test'""")
def q_vec_neg_cosine_loss(spark, sf):
    """Alignment loss: mean negative cosine between each test vector and its
    own class mean (join on the class key; the model side is K rows)."""
    e = emb(spark, sf)
    cents = C.class_average(e.filter("split = 'train'")).select("label", "centroid")
    j = e.filter("split = 'test'").join(cents, "label")
    return j.agg(F.round(F.avg(-V.cosine("x", "centroid")), R).alias("loss"), F.count("*").alias("n"))


# -- projections / predicates ------------------------------------------------

@register("prj_filter_eq", E + "SELECT count(*) AS n_before, count(*) FILTER (WHERE label = 1) AS n_after FROM e")
def q_prj_filter_eq(spark, sf):
    """Rows before/after an equality filter, in one pass."""
    return emb(spark, sf).agg(F.count("*").alias("n_before"), F.count_if(F.col("label") == 1).alias("n_after"))


@register("prj_filter_in", "SELECT vec_id, label FROM embeddings WHERE label IN (0, 1)")
def q_prj_filter_in(spark, sf):
    return tbl(spark, sf, "embeddings").select("vec_id", "label").filter(F.col("label").isin(0, 1))


@register("prj_filter_ne", "SELECT vec_id, label FROM embeddings WHERE label <> 2")
def q_prj_filter_ne(spark, sf):
    return tbl(spark, sf, "embeddings").select("vec_id", "label").filter(F.col("label") != 2)


@register("prj_drop_cast", "SELECT vec_id, CAST(embedding AS FLOAT[]) AS x, CAST(label AS BIGINT) AS y FROM embeddings")
def q_prj_drop_cast(spark, sf):
    """X as float32 array and y as int64, label column dropped from X."""
    t = tbl(spark, sf, "embeddings")
    return t.select("vec_id", F.col("embedding").cast("array<float>").alias("x"),
                    F.col("label").cast("long").alias("y"))


@register("prj_slice_cols", E + "SELECT vec_id, x[1:2] AS x2 FROM e")
def q_prj_slice_cols(spark, sf):
    return emb(spark, sf).select("vec_id", F.slice("x", 1, 2).alias("x2"))


@register("prj_clip", E + f"SELECT vec_id, {sra('list_transform(x, lambda v: greatest(0.0, least(1.0, v * 4.0)))')} AS clipped FROM e")
def q_prj_clip(spark, sf):
    return emb(spark, sf).select("vec_id", ra(V.clip(V.scale("x", 4.0), 0.0, 1.0)).alias("clipped"))


@register("prj_threshold", E + "SELECT vec_id, CAST(x[1] + 0.5 >= 0.5 AS INTEGER) AS pred FROM e")
def q_prj_threshold(spark, sf):
    """score >= 0.5 -> class 1 (inclusive; Spark's Binarizer is strict)."""
    s = F.element_at("x", 1) + F.lit(0.5)
    return emb(spark, sf).select("vec_id", (s >= 0.5).cast("int").alias("pred"))


@register("prj_bias", E + "SELECT vec_id, list_concat([1.0::DOUBLE], x) AS xb FROM e")
def q_prj_bias(spark, sf):
    return emb(spark, sf).select("vec_id", F.concat(F.array(F.lit(1.0)), F.col("x")).alias("xb"))


@register("prj_flatten", E + """SELECT vec_id, list_transform(range(8), lambda r: x[r * 8 + 1 : r * 8 + 8]) AS grid,
  flatten(list_transform(range(8), lambda r: x[r * 8 + 1 : r * 8 + 8])) = x AS roundtrip FROM e""")
def q_prj_flatten(spark, sf):
    """64 -> 8x8 reshape (row-major) and the flatten back."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("x", r * 8 + 1, 8))
    e = emb(spark, sf).select("vec_id", "x", grid.alias("grid"))
    return e.select("vec_id", "grid", (F.flatten("grid") == F.col("x")).alias("roundtrip"))


@register("prj_xy", """SELECT p_partkey, [CAST(p_size AS DOUBLE), CAST(length(p_name) AS DOUBLE)] AS x, p_retailprice AS y FROM part""")
def q_prj_xy(spark, sf):
    p = tbl(spark, sf, "part")
    return p.select("p_partkey", F.array(F.col("p_size").cast("double"), F.length("p_name").cast("double")).alias("x"),
                    F.col("p_retailprice").alias("y"))


@register("prj_poly", E + f"""SELECT vec_id, len(list_concat(x, flatten(list_transform(range(len(x)), lambda i: list_transform(range(i, len(x)), lambda j: x[i + 1] * x[j + 1]))))) AS n_terms,
  {sra('list_concat(x, flatten(list_transform(range(len(x)), lambda i: list_transform(range(i, len(x)), lambda j: x[i + 1] * x[j + 1]))))')} AS poly,
  list_concat(list_transform(range(len(x)), lambda i: 'x' || i), flatten(list_transform(range(len(x)), lambda i: list_transform(range(i, len(x)),
    lambda j: CASE WHEN i = j THEN 'x' || i || '^2' ELSE 'x' || i || ' x' || j END)))) AS names FROM e""")
def q_prj_poly(spark, sf):
    """Degree-2 expansion without bias in the usual order: all degree-1
    terms, then x_i * x_j for i <= j (lexicographic). One lambda, so the
    generated code does not grow with the number of terms."""
    from quarry.operators.prep import poly2, poly2_names
    e = emb(spark, sf).select("vec_id", poly2("x").alias("poly"), poly2_names("x", "x").alias("names"))
    return e.select("vec_id", F.size("poly").cast("long").alias("n_terms"), ra("poly").alias("poly"), "names")


@register("prj_exp_feature", f"SELECT l_orderkey, l_linenumber, round(exp(l_discount), {R}) AS exp_discount FROM lineitem")
def q_prj_exp_feature(spark, sf):
    return tbl(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.exp("l_discount"), R).alias("exp_discount"))
