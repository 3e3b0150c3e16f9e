"""Preparation, sampling, set operations, sorts, sources and sinks."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import vec as V
from quarry.functions.hashing import hash_unit, sql_hash_u60, sql_hash_unit
from quarry.operators import centroid as C
from quarry.operators import prep as P
from quarry.operators import sampling as SM
from quarry.operators.ordering import with_global_index
from quarry.plans.common import SEED, SQL_CENTROIDS, SQL_EMB, emb, tbl
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources.tables import preview, read_csv_labelled, row_at

R = 6


# -- splits and folds --------------------------------------------------------

@register("prep_split", f"""WITH h AS (SELECT p_partkey, {sql_hash_u60(SEED, 'p_partkey')} AS h FROM part),
n AS (SELECT count(*) AS n FROM h)
SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY h, p_partkey) <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split
FROM h, n""")
def q_prep_split(spark, sf):
    """Seeded hold-out with exactly ceil(0.25 n) test rows."""
    return P.exact_split(tbl(spark, sf, "part").select("p_partkey"), "p_partkey", 0.25, SEED)


@register("prep_split_stratified", f"""WITH h AS (SELECT doc_id, quality, {sql_hash_u60(SEED, 'doc_id')} AS h FROM labels)
SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY h, doc_id)
  <= ceil(count(*) OVER (PARTITION BY quality) * 0.3) THEN 'test' ELSE 'train' END AS split FROM h""")
def q_prep_split_stratified(spark, sf):
    """Hold-out per class: ceil(0.3 n_c) test rows in every class."""
    return P.exact_split(tbl(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 0.3, SEED, by="quality")


@register("prep_split3", f"""SELECT vec_id, CASE WHEN {sql_hash_unit(SEED, 'vec_id')} < 0.8 THEN 'train'
  WHEN {sql_hash_unit(SEED, 'vec_id')} < 0.9 THEN 'valid' ELSE 'test' END AS split FROM embeddings""")
def q_prep_split3(spark, sf):
    """train/valid/test 80/10/10 by seeded hash buckets."""
    return P.hash_split(tbl(spark, sf, "embeddings").select("vec_id"), "vec_id",
                        {"train": 0.8, "valid": 0.1, "test": 0.1}, SEED)


@register("prep_kfold", f"""WITH {SQL_EMB},
f AS (SELECT vec_id, x, label, ({sql_hash_u60(SEED, 'vec_id')}) % 5 AS fold FROM e),
u AS (SELECT fold, label, unnest(range(len(x))) AS i, unnest(x) AS v FROM f),
fs AS (SELECT fold, label, i, sum(v) AS s FROM u GROUP BY ALL),
fn AS (SELECT fold, label, count(*) AS n FROM f GROUP BY ALL),
ts AS (SELECT label, i, sum(s) AS s FROM fs GROUP BY ALL),
tn AS (SELECT label, sum(n) AS n FROM fn GROUP BY ALL),
folds AS (SELECT DISTINCT fold FROM f),
cm AS (SELECT k.fold, ts.label, ts.i, (ts.s - coalesce(fs.s, 0)) / (tn.n - coalesce(fn.n, 0)) AS m
       FROM folds k CROSS JOIN ts JOIN tn ON tn.label = ts.label
       LEFT JOIN fs ON fs.fold = k.fold AND fs.label = ts.label AND fs.i = ts.i
       LEFT JOIN fn ON fn.fold = k.fold AND fn.label = ts.label
       WHERE tn.n - coalesce(fn.n, 0) > 0),
c AS (SELECT fold, label, list(m ORDER BY i) AS centroid FROM cm GROUP BY ALL),
s AS (SELECT f.vec_id, f.fold, f.label, c.label AS cls, list_cosine_similarity(f.x, c.centroid) AS score
      FROM f JOIN c ON c.fold = f.fold),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS rn FROM s) WHERE rn = 1)
SELECT fold, round(accuracy, {R}) AS accuracy, n, round(avg(accuracy) OVER (), {R}) AS mean_accuracy FROM (
  SELECT fold::INTEGER AS fold, avg(CASE WHEN label = cls THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM p GROUP BY fold)""")
def q_prep_kfold(spark, sf):
    """5-fold CV of the class-average classifier in one pass: per-(fold,
    class) coordinate sums; the training means of fold f are
    (total - fold f) / (n - n_f); each fold is scored with its own model."""
    e = P.kfold(emb(spark, sf), "vec_id", 5, SEED)
    fs = e.select("fold", "label", F.posexplode("x").alias("i", "v")).groupBy("fold", "label", "i").agg(F.sum("v").alias("s"))
    fn = e.groupBy("fold", "label").agg(F.count("*").alias("n"))
    from quarry.operators.small import collect_small
    rows = collect_small(fs, "fold class sums")  # folds * K * d cells: the fitted models
    tot_s, tot_n, by = {}, {}, {}
    for r in rows:
        tot_s[(r["label"], r["i"])] = tot_s.get((r["label"], r["i"]), 0.0) + r["s"]
        by[(r["fold"], r["label"], r["i"])] = r["s"]
    for r in collect_small(fn, "fold class counts"):
        tot_n[r["label"]] = tot_n.get(r["label"], 0) + r["n"]
        by[(r["fold"], r["label"])] = r["n"]
    labels = sorted(tot_n)
    d = max(i for (_, i) in tot_s) + 1
    folds = sorted({f for (f, *_rest) in by})
    # one pass: every row is scored with the model of its own fold, the K
    # centroid sets travel as one literal array indexed by fold
    models = []
    for f in folds:
        vecs = []
        for l in labels:
            n = tot_n[l] - by.get((f, l), 0)
            vecs.append([(tot_s[(l, i)] - by.get((f, l, i), 0.0)) / n for i in range(d)] if n > 0 else None)
        models.append(vecs)
    import math as _m
    unit = [[([v / max(_m.sqrt(sum(t * t for t in vec)), 1e-12) for v in vec] if vec is not None else [float("nan")] * d)
             for vec in m] for m in models]
    import json as _j
    lit = F.from_json(F.lit(_j.dumps(unit).replace("NaN", "null")), "array<array<array<double>>>")
    pos = F.array_position(V.lit_ints(folds), F.col("fold").cast("long")).cast("int")
    scores = V.let(V.l2_normalize("x"), lambda xn: F.transform(
        F.element_at(lit, pos), lambda c: F.coalesce(V.dot(xn, c), F.lit(float("-inf")))))
    allp = e.withColumn("pred", C.argmax_label(scores, labels))
    each = allp.groupBy("fold").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    mean = F.avg("accuracy").over(Window.partitionBy(F.lit(1)))  # over the handful of folds
    return each.select("fold", F.round("accuracy", R).alias("accuracy"), "n", F.round(mean, R).alias("mean_accuracy"))


# -- scaling, encoding, binning ---------------------------------------------

@register("prep_standardize", f"""WITH h AS (SELECT p_partkey, p_size, p_retailprice, {sql_hash_u60(SEED, 'p_partkey')} AS h FROM part),
n AS (SELECT count(*) AS n FROM h),
s AS (SELECT h.*, CASE WHEN row_number() OVER (ORDER BY h, p_partkey) <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM h, n),
st AS (SELECT avg(p_size) AS ms, coalesce(nullif(stddev_pop(p_size), 0), 1) AS ss,
              avg(p_retailprice) AS mp, coalesce(nullif(stddev_pop(p_retailprice), 0), 1) AS sp FROM s WHERE split = 'train')
SELECT p_partkey, split, round((p_size - ms) / ss, {R}) AS size_z, round((p_retailprice - mp) / sp, {R}) AS price_z FROM s, st""")
def q_prep_standardize(spark, sf):
    """(x - mean) / population std fitted on the training split only and
    applied to both splits; a constant column divides by 1."""
    p = P.exact_split(tbl(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 0.25, SEED)
    st = P.standardize_fit(p.filter("split = 'train'"), ["p_size", "p_retailprice"])
    z = P.standardize_apply(p, st)
    return z.select("p_partkey", "split", F.round("p_size_z", R).alias("size_z"), F.round("p_retailprice_z", R).alias("price_z"))


# fixed values: the normalisation constants of the digit images (mean, std after /255)
IMG_MEAN, IMG_STD = 0.1307, 0.3081


@register("prep_normalize_const", f"""WITH {SQL_EMB}
SELECT vec_id, {"list_transform(x, lambda v: round((((v + 1.0) * 127.5) / 255.0 - 0.1307) / 0.3081, 6) + 0.0)"} AS xn FROM e""")
def q_prep_normalize_const(spark, sf):
    """Pixel-style normalisation with given constants: values mapped to
    0..255, divided by 255, then (v - mean) / std."""
    e = emb(spark, sf)
    f = F.transform("x", lambda v: F.round((((v + 1.0) * 127.5) / 255.0 - IMG_MEAN) / IMG_STD, R))
    return e.select("vec_id", f.alias("xn"))


@register("prep_label_encode", """SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1) AS p_type_idx FROM part""")
def q_prep_label_encode(spark, sf):
    """Each distinct string -> integer in ascending order."""
    return P.label_encode(tbl(spark, sf, "part").select("p_partkey", "p_type"), "p_type").select(
        "p_partkey", "p_type", "p_type_idx")


@register("prep_bin", """SELECT floor(l_extendedprice / 1000)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def q_prep_bin(spark, sf):
    """$1000-wide bins of the price and their counts."""
    li = tbl(spark, sf, "lineitem")
    return li.groupBy(P.bin_floor("l_extendedprice", 1000).alias("bin")).agg(F.count("*").alias("n"))


# -- sampling ------------------------------------------------------------------

@register("smp_without_repl", f"""SELECT o_orderkey FROM orders ORDER BY {sql_hash_u60(SEED, 'o_orderkey')}, o_orderkey LIMIT 100""")
def q_smp_without_repl(spark, sf):
    return SM.sample_k(tbl(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, SEED)


@register("smp_shuffle", f"""SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash_u60(SEED, 'o_orderkey')}, o_orderkey) - 1 AS pos FROM orders""")
def q_smp_shuffle(spark, sf):
    return SM.shuffle_order(tbl(spark, sf, "orders").select("o_orderkey"), "o_orderkey", SEED)


def _poisson_sql(u: str) -> str:
    th = SM.poisson1_thresholds()
    parts = " ".join(f"WHEN {u} < {t!r} THEN {k}" for k, t in enumerate(th))
    return f"CASE {parts} ELSE {len(th)} END"


@register("smp_bootstrap", f"""SELECT o_orderkey, bag, {_poisson_sql(sql_hash_unit(SEED, 'o_orderkey', 'bag'))} AS draws
FROM orders, range(10) t(bag)""")
def q_smp_bootstrap(spark, sf):
    """10 bootstrap bags: Poisson(1) draw count per (row, bag); 0 = out of bag."""
    b = SM.bootstrap_counts(tbl(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10, SEED)
    return b.select("o_orderkey", F.col("bag").cast("long").alias("bag"), F.col("draws").cast("int").alias("draws"))


# -- set operations --------------------------------------------------------------

SQL_DOC_SPLIT = f"""CASE WHEN {sql_hash_unit(SEED, 'doc_id')} < 0.9 THEN 'train' WHEN {sql_hash_unit(SEED, 'doc_id')} < 0.95 THEN 'valid' ELSE 'test' END"""


def _split_docs(spark, sf):
    return P.hash_split(tbl(spark, sf, "documents").select("doc_id", "text"), "doc_id",
                        {"train": 0.9, "valid": 0.05, "test": 0.05}, SEED)


def _doc_splits(spark, sf):
    d = _split_docs(spark, sf)
    return [d.filter(F.col("split") == s) for s in ("train", "valid", "test")]


@register("set_union_splits", f"SELECT doc_id, {SQL_DOC_SPLIT} AS split FROM documents")
def q_set_union_splits(spark, sf):
    """Concatenate the named splits back into one table (duplicates kept)."""
    a, b, c = _doc_splits(spark, sf)
    return a.unionByName(b).unionByName(c).select("doc_id", "split")


@register("set_distinct_seqs", "SELECT DISTINCT text FROM documents")
def q_set_distinct_seqs(spark, sf):
    """Distinct sequences across all splits (exact copies collapse)."""
    return _split_docs(spark, sf).select("text").distinct()


# -- sorts ----------------------------------------------------------------------

@register("srt_by_length", """SELECT doc_id, length(text) AS len, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS rank FROM documents""")
def q_srt_by_length(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("len"))
    return with_global_index(d, ["len", "doc_id"], "rank")


@register("srt_argsort", """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders""")
def q_srt_argsort(spark, sf):
    """Rank by a key, descending (ties by id)."""
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return with_global_index(o, ["o_totalprice", "o_orderkey"], "rank", ascending=[False, True]).select("o_orderkey", "rank")


# -- sources and sinks -------------------------------------------------------------

PART_SCHEMA = T.StructType([
    T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()), T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])


@register("src_csv", "SELECT * FROM part")
def q_src_csv(spark, sf):
    """Labelled CSV with an explicit schema: the part table is written as
    CSV to the shared scratch folder and read back."""
    path = scratch_path(spark, "part-csv")
    tbl(spark, sf, "part").write.mode("overwrite").option("header", True).csv(path)
    return read_csv_labelled(spark, path, PART_SCHEMA)


@register("src_split_dataset", f"""SELECT {SQL_DOC_SPLIT} AS split, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1""")
def q_src_split_dataset(spark, sf):
    """Named splits of a dataset (train/valid/test) and their sizes."""
    return _split_docs(spark, sf).groupBy("split").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


def _synth_cols(key):
    u1, u2, u3 = (hash_unit(SEED, key, F.lit(t)) for t in ("x", "n1", "n2"))
    x = u1 * 2.0
    noise = F.sqrt(-2.0 * F.log(F.lit(1.0) - u2)) * F.cos(2.0 * math.pi * u3)
    return x, noise


def _synth_sql(key):
    u1, u2, u3 = (sql_hash_unit(SEED, key, f"'{t}'") for t in ("x", "n1", "n2"))
    return f"({u1}) * 2.0", f"sqrt(-2.0 * ln(1.0 - {u2})) * cos(2.0 * pi() * {u3})"


_SX, _SN = _synth_sql("o_orderkey")


@register("src_synth_linear", f"""SELECT o_orderkey, round({_SX}, {R}) AS x, round(4.0 + 3.0 * {_SX} + {_SN}, {R}) AS y FROM orders""")
def q_src_synth_linear(spark, sf):
    """y = 4 + 3x + N(0, 1), x uniform in [0, 2): one synthetic row per order,
    drawn from seeded hashes (Box-Muller), so it is reproducible everywhere."""
    x, noise = _synth_cols("o_orderkey")
    o = tbl(spark, sf, "orders").select("o_orderkey")
    return o.select("o_orderkey", F.round(x, R).alias("x"), F.round(4.0 + 3.0 * x + noise, R).alias("y"))


@register("src_synth_regression", f"""SELECT o_orderkey, round({_SX} - 1.0, {R}) AS x, round(60.0 * ({_SX} - 1.0) + 10.0 * ({_SN}), {R}) AS y FROM orders""")
def q_src_synth_regression(spark, sf):
    """One-feature regression data with noise of deviation 10, one row per order."""
    x, noise = _synth_cols("o_orderkey")
    o = tbl(spark, sf, "orders").select("o_orderkey")
    return o.select("o_orderkey", F.round(x - 1.0, R).alias("x"), F.round(60.0 * (x - 1.0) + 10.0 * noise, R).alias("y"))


@register("src_synth_quadratic", f"""SELECT o_orderkey, round(2.0 * {_SX} - 2.0, {R}) AS x,
  round(0.5 * (2.0 * {_SX} - 2.0) * (2.0 * {_SX} - 2.0) + 0.3 * (2.0 * {_SX} - 2.0) + 0.1 * ({_SN}), {R}) AS y FROM orders""")
def q_src_synth_quadratic(spark, sf):
    """y = 0.5 x² + 0.3 x + N(0, 0.1²), x uniform in [-2, 2), one row per order."""
    x01, noise = _synth_cols("o_orderkey")
    x = 2.0 * x01 - 2.0
    o = tbl(spark, sf, "orders").select("o_orderkey")
    return o.select("o_orderkey", F.round(x, R).alias("x"), F.round(0.5 * x * x + 0.3 * x + 0.1 * noise, R).alias("y"))


@register("src_synth_normal", f"""SELECT o_orderkey, round({_SN}, {R}) AS v FROM orders""")
def q_src_synth_normal(spark, sf):
    """A standard normal draw per order, from seeded hashes (Box-Muller)."""
    _, noise = _synth_cols("o_orderkey")
    return tbl(spark, sf, "orders").select("o_orderkey", F.round(noise, R).alias("v"))


@register("src_preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def q_src_preview(spark, sf):
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return preview(o, ["o_orderkey"], 5)


@register("src_row_at", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 100")
def q_src_row_at(spark, sf):
    return row_at(tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


@register("snk_embeddings", f"""WITH {SQL_EMB}
SELECT vec_id, list_transform(x, lambda v: round(v / greatest(sqrt(list_sum(list_transform(x, lambda w: w * w))), 1e-12), {R}) + 0.0) AS xn FROM e""")
def q_snk_embeddings(spark, sf):
    """Persist (normalised) vectors as parquet and read them back."""
    from quarry.sources.sinks import write_vectors
    path = scratch_path(spark, "vectors")
    e = emb(spark, sf).select("vec_id", V.l2_normalize("x").alias("xn"))
    write_vectors(e, path)
    back = spark.read.parquet(path)
    return back.select("vec_id", V.round_array("xn", R).alias("xn"))


@register("snk_model", f"""WITH {SQL_EMB}, {SQL_CENTROIDS},
s AS (SELECT e.vec_id, c.label AS cls, list_cosine_similarity(e.x, c.centroid) AS score FROM e, c WHERE e.split = 'test')
SELECT vec_id, cls AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS rn FROM s) WHERE rn = 1""")
def q_snk_model(spark, sf):
    """Save the fitted class-average model, reload it and score with it."""
    from quarry.sources.sinks import load_centroid_model, save_centroid_model
    e = emb(spark, sf)
    path = scratch_path(spark, "centroids")
    save_centroid_model(C.class_average(e.filter("split = 'train'")), path)
    model = load_centroid_model(spark, path)
    return C.predict_nearest_centroid(e.filter("split = 'test'"), model, "cosine").select("vec_id", "pred")
