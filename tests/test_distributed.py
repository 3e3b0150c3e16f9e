"""The scale helpers against brute force on small inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import ordering as O
from quarry.operators import prep as P


def test_exact_quantiles_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(O, "_FINAL_ROWS", 50)  # force several refinement rounds
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 0.25)])  # a hot value
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 3, len(vals)), "v": vals}))
    q = {(r["g"], r["prob"]): r["quantile"] for r in O.exact_quantiles(df, "v", [0.1, 0.5, 0.9], ["g"]).collect()}
    pdf = df.toPandas()
    for g in range(3):
        for p in (0.1, 0.5, 0.9):
            assert math.isclose(q[(g, p)], np.quantile(pdf[pdf.g == g].v, p), rel_tol=1e-12, abs_tol=1e-12)


def test_global_index_is_a_dense_total_order(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 5, 2000), "id": np.arange(2000)})  # heavy ties on k
    df = spark.createDataFrame(pdf)
    out = O.with_global_index(df, ["k", "id"], "idx").toPandas().sort_values("idx")
    assert list(out["idx"]) == list(range(2000))
    exp = pdf.sort_values(["k", "id"])
    assert list(out["id"]) == list(exp["id"])


def test_exact_split_sizes_and_disjointness(spark):
    df = spark.range(1001).withColumn("c", (F.col("id") % 3).cast("int"))
    s = P.exact_split(df, "id", 0.25)
    assert s.filter("split = 'test'").count() == math.ceil(1001 * 0.25)
    st = P.exact_split(df, "id", 0.3, by="c").groupBy("c", "split").count().collect()
    sizes = {(r["c"], r["split"]): r["count"] for r in st}
    for c in range(3):
        n = sizes[(c, "test")] + sizes[(c, "train")]
        assert sizes[(c, "test")] == math.ceil(n * 0.3)


def test_kfold_complete_and_disjoint(spark):
    df = P.kfold(spark.range(500), "id", 5)
    assert df.select("id").distinct().count() == 500
    assert sorted(r[0] for r in df.select("fold").distinct().collect()) == [0, 1, 2, 3, 4]


def _by_force(Q, qids, R, rids, k, metric="euclid", exclude_self=False):
    def dist(x, y):
        if metric == "cosine":
            return 1 - x @ y / max(np.linalg.norm(x), 1e-12) / max(np.linalg.norm(y), 1e-12)
        d2 = ((x - y) ** 2).sum()
        return d2 if metric == "sqeuclid" else np.sqrt(d2)
    return {q: [j for _, j in sorted((dist(x, y), j) for j, y in zip(rids, R) if not (exclude_self and j == q))[:k]] for q, x in zip(qids, Q)}


def _answers(found):
    out = {}
    for g in sorted(found.collect(), key=lambda g: (g["qid"], g["rank"])):
        assert g["rank"] == len(out.setdefault(g["qid"], [])) + 1
        out[g["qid"]].append(g["rid"])
    return out


@pytest.mark.parametrize("metric", ["euclid", "sqeuclid", "cosine"])
@pytest.mark.parametrize("clustered", [False, True])
def test_knn_matches_brute_force(spark, monkeypatch, metric, clustered):
    from quarry.operators import neighbors
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 5))
    if clustered:
        X = 8 * rng.normal(size=(6, 5))[rng.integers(0, 6, 300)] + 0.3 * X
    X[5], X[250] = 0, 0
    q = spark.createDataFrame([(i, X[i].tolist()) for i in range(40)], "qid long, x array<double>")
    r = spark.createDataFrame([(i, X[i].tolist()) for i in range(40, 300)], "rid long, x array<double>")
    init = neighbors.PivotIndex.__init__
    monkeypatch.setattr(init, "__defaults__", (*init.__defaults__[:-2], 20, 16))  # many cells, cut into tiles
    got = _answers(neighbors.knn(q, r, 4, metric=metric))
    assert got == _by_force(X[:40], range(40), X[40:], range(40, 300), 4, metric)


def test_knn_edge_cases(spark):
    from quarry.operators.neighbors import knn, knn_clustered
    x = [[0.0, 1.0], [0.0, 2.0], None, [], [float("nan"), 1.0], [1.0, None], [float("inf"), 0.0], [0.0, 1.0]]
    q = spark.createDataFrame(list(enumerate(x)), "qid long, x array<double>")
    r = q.withColumnRenamed("qid", "rid")
    assert _answers(knn(q, r, 2)) == {0: [0, 7], 1: [1, 0], 7: [0, 7]}
    assert _answers(knn(q, r, 5, exclude_self=True)) == {0: [7, 1], 1: [0, 7], 7: [0, 1]}
    for some in (knn, knn_clustered):
        assert some(q, r.where("rid = 2"), 2).collect() == [] == some(q, r.limit(0), 2).collect() == some(q.limit(0), r, 2).collect()
    assert knn(q, r.limit(0), 2).columns == knn(q, r, 2).columns


def test_knn_prunes_on_clusters(spark):
    from quarry.operators.neighbors import PivotIndex, _distinct_queries
    rng = np.random.default_rng(8)
    X = 50 * rng.normal(size=(40, 16))[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(X.tolist())], "id long, x array<double>")
    q, r = rows.where("id % 4 = 0").withColumnRenamed("id", "qid"), rows.where("id % 4 <> 0").withColumnRenamed("id", "rid")
    index = PivotIndex(r, 5, cell_rows=100)
    asked = _distinct_queries(q, "qid", "x")[1]
    limited = index.search(asked)[1]
    found = index.compare(index.visits(asked.withColumn("_t", F.lit(float("inf"))), False)).count() + index.compare(index.visits(limited, True)).count()
    assert found < 2000 * 6000 / 1024 * 5 / 4  # of blocks of 1,024 rows
    assert index.visits(limited, True).count() < 2000 * len(index.pivots) / 10


def test_silhouettes_match_brute_force(spark):
    from quarry.operators.cluster import silhouette_euclid, silhouette_sq
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(4, 1, (25, 3)), [[10, 10, 10]]])
    c = np.array([0] * 30 + [1] * 25 + [2])
    df = spark.createDataFrame([(i, X[i].tolist(), int(c[i])) for i in range(len(X))], "id long, x array<double>, cluster int")

    def brute(sq):
        D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
        D = D ** 2 if sq else D
        s = []
        for i in range(len(X)):
            own = c == c[i]
            if own.sum() == 1:
                s.append(0.0)
                continue
            a = D[i, own].sum() / (own.sum() - 1)
            b = min(D[i, c == k].mean() for k in set(c) if k != c[i])
            s.append((b - a) / max(a, b))
        return float(np.mean(s))

    assert math.isclose(silhouette_euclid(df, "id", tile_rows=10).first()[0], brute(False), rel_tol=1e-9)
    assert math.isclose(silhouette_sq(df).first()[0], brute(True), rel_tol=1e-9)


def test_bpe_matches_plain_python(spark):
    from quarry.operators.text import bpe_apply, bpe_learn
    words = {"lower": 5, "low": 7, "newest": 6, "widest": 3, "aaa": 4}

    def brute(n):
        seqs = {w: list(w) for w in words}
        merges = []
        for _ in range(n):
            cnt = {}
            for w, s in seqs.items():
                for a, b in zip(s, s[1:]):
                    cnt[(a, b)] = cnt.get((a, b), 0) + words[w]
            if not cnt:
                break
            (a, b), c = min(cnt.items(), key=lambda t: (-t[1], t[0]))
            merges.append((a, b, c))
            for w, s in seqs.items():
                out, i = [], 0
                while i < len(s):
                    if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                        out.append(a + b)
                        i += 2
                    else:
                        out.append(s[i])
                        i += 1
                seqs[w] = out
        return merges, seqs

    df = spark.createDataFrame(list(words.items()), "word string, n long")
    merges = bpe_learn(df, 6, checkpoint_every=3)
    exp, seqs = brute(6)
    assert merges == exp
    got = {r["word"]: r["s"] for r in df.select("word", bpe_apply(F.col("word"), merges).alias("s")).collect()}
    assert got == seqs


def _clustered(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 10, (6, 4))
    X = np.vstack([c + rng.normal(0, 0.5, (60, 4)) for c in centers])
    idx = rng.permutation(len(X))
    q = spark.createDataFrame([(int(i), X[i].tolist()) for i in idx[:50]], "qid long, x array<double>")
    r = spark.createDataFrame([(int(i), X[i].tolist()) for i in idx[50:]], "rid long, x array<double>")
    return q, r


def test_sampled_silhouette_covers_the_exact_one(spark):
    from quarry.operators.cluster import silhouette_euclid, silhouette_sampled
    hits = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        X = np.vstack([rng.normal(c, 1, (n, 3)) for c, n in ((0, 400), (2, 150), (5, 30))] + [[[20.0, 20, 20]]])
        c = np.repeat([0, 1, 2, 7], [400, 150, 30, 1])
        df = spark.createDataFrame([(i, X[i].tolist(), int(c[i])) for i in range(len(X))], "id long, x array<double>, cluster int")
        exact, r = silhouette_euclid(df, "id").first()[0], silhouette_sampled(df, "id", seed=seed).first()
        hits += r["low"] <= exact <= r["high"]
        assert abs(r["silhouette"] - exact) < 0.05 and r["high"] - r["low"] < 0.12
        whole = silhouette_sampled(df, "id", per_cluster=400).first()
        assert abs(whole["silhouette"] - exact) < 1e-9 and abs(whole["high"] - whole["low"]) < 1e-12
    assert hits >= 5


def test_knn_ties_among_many_equal_vectors(spark, monkeypatch):
    from quarry.operators import neighbors
    rng = np.random.default_rng(6)
    X = rng.normal(size=(1500, 8))
    X[rng.permutation(1500)[:500]] = X[0]  # a third are equal: hundreds in each block
    rows = [(i, X[i].tolist(), i % 7) for i in range(len(X))]
    q = spark.createDataFrame([(i, v) for i, v, _ in rows[:30]], "qid long, x array<double>")
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    r = spark.createDataFrame(shuffled, "rid long, x array<double>, label int").coalesce(1)
    want = {i: sorted((float(np.sqrt(((X[i] - X[j]) ** 2).sum())), j) for j in range(len(X)))[:5] for i in range(30)}
    for most in (neighbors.MOST_CANDIDATES, 700):
        monkeypatch.setattr(neighbors, "MOST_CANDIDATES", most)
        got = {}
        for g in sorted(neighbors.knn(q, r, 5).collect(), key=lambda g: g["rank"]):
            assert g["label"] == g["rid"] % 7
            got.setdefault(g["qid"], []).append(g["rid"])
        assert got == {i: [j for _, j in x] for i, x in want.items()}


@pytest.mark.parametrize("structure", [True, False])
def test_clustered_knn_recall(spark, structure):
    from quarry.operators.neighbors import knn, knn_clustered, recall
    if structure:
        q, r = _clustered(spark)
    else:
        X = np.random.default_rng(12).normal(size=(1500, 24))
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(X.tolist())], "id long, x array<double>")
        q, r = rows.where("id % 5 = 0").withColumnRenamed("id", "qid"), rows.where("id % 5 <> 0").withColumnRenamed("id", "rid")
    got = knn_clustered(q, r, 5, cell_rows=30)
    assert recall(got, q, r, 5, seed=1) >= 0.9
    exact, sure = _answers(knn(q, r, 5)), {g["qid"] for g in got.where("certified").collect()}
    mine = _answers(got)
    assert all(mine[i] == exact[i] for i in sure) and (sure or not structure)


def test_sweep_equals_plain_lloyd(spark):
    from quarry.operators.cluster import lloyd_sweep, seeds
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(size=(300, 6)), rng.normal(4, 1, (200, 6))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(X.tolist())] + [(900, None)], "id long, x array<double>").repartition(5)
    starts = seeds(df, "id", range(2, 11))
    assert sorted(starts) == list(range(2, 11)) and all(len(c) == k for k, c in starts.items())
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    got = {r["k"]: r for r in lloyd_sweep(df, "id", starts).collect()}
    for k, c in starts.items():
        c, own, rounds = np.array(c), None, -1
        while True:
            d2 = ((X[:, None] - c[None]) ** 2).sum(2)
            new, rounds = d2.argmin(1), rounds + 1
            if own is not None and (new == own).all():
                break
            own = new
            c = np.array([X[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        s = []
        for i in range(len(X)):
            a = D[i][(own == own[i]) & (np.arange(len(X)) != i)]
            b = min(D[i][own == j].mean() for j in set(own.tolist()) - {own[i]})
            s.append((b - a.mean()) / max(a.mean(), b) if len(a) else 0.0)
        assert got[k]["rounds"] == rounds and abs(got[k]["inertia"] - d2.min(1).sum()) < 1e-6 and abs(got[k]["silhouette"] - np.mean(s)) < 1e-9
    assert lloyd_sweep(df.limit(0), "id", seeds(df.limit(0), "id", [2])).collect() == []


def test_encoding_depends_on_the_tokens_alone(spark):
    from quarry.functions import text as TX
    from quarry.operators import text as T
    rows = [(1, "abcab"), (1, "zz a"), (2, ""), (3, "zz a"), (3, "zz a"), (4, "q")]
    df = spark.createDataFrame(rows, "id int, text string")
    vocab = T.vocabulary(df.filter("id < 4"), TX.chars("text"))
    index = {r["token"]: r["idx"] for r in vocab.collect()}
    got = sorted((r["id"], r["text"], r["ids"]) for r in T.encode_frame(df, TX.chars("text"), vocab).collect())
    assert got == sorted((i, t, [index.get(c) for c in t]) for i, t in rows)


def test_several_arrays_are_encoded_side_by_side(spark):
    from quarry.operators import text as T
    df = spark.createDataFrame([(1, ["a", "b"], ["x"]), (2, [], ["y", "x", "q"]), (1, ["a", "b"], ["x"]), (3, [], [])],
                               "id int, t array<string>, u array<string>")
    v = spark.createDataFrame([("a", 0), ("b", 1)], "token string, idx long")
    w = spark.createDataFrame([("x", 5), ("y", 6)], "token string, idx long")
    got = sorted((r["id"], r["i"], r["j"]) for r in T.encode_frames(df, {"i": (F.col("t"), v), "j": (F.col("u"), w)}).collect())
    assert got == [(1, [0, 1], [5]), (1, [0, 1], [5]), (2, [], [6, 5, None]), (3, [], [])]


def test_vocabularies_in_slices(spark, monkeypatch):
    from quarry.functions import text as TX
    from quarry.operators import text as T
    monkeypatch.setattr(T, "SLICE_TOKENS", 7)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz éñ漢😀\n"), rng.integers(0, 40))) for _ in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    vocab = T.vocabulary(df, TX.chars("text"))
    assert len(T._slices(vocab)) > 3
    index = {r["token"]: r["idx"] for r in vocab.collect()}
    got = {r["id"]: r["ids"] for r in T.encode_frame(df, TX.chars("text"), vocab).collect()}
    assert got == {i: [index[c] for c in t or ""] for i, t in enumerate(texts)}


def test_two_valued_column_sorts_no_ties(spark, monkeypatch):
    monkeypatch.setattr(O, "_FINAL_ROWS", 10)
    vals = [1.0] * 700 + [2.0] * 301
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "v double, i long")
    q = {r["prob"]: r["quantile"] for r in O.exact_quantiles(df, "v", [0.0, 0.5, 0.7, 0.75, 1.0]).collect()}
    assert q == {p: float(np.quantile(vals, p)) for p in q}
    out = O.select_ranks(df, "v", [(0,), (450,), (700,), (1000,)], tiebreak=["i"])
    assert sorted((r["_rank"], r["v"], r["i"]) for r in out.collect()) == [(0, 1.0, 0), (450, 1.0, 450), (700, 2.0, 700), (1000, 2.0, 1000)]
    # the answers of one-valued intervals need no rows at all
    same = O.select_ranks(df.filter("v = 1"), "v", [(350,)])
    assert "Window" not in same._jdf.queryExecution().toString() and same.first()["v"] == 1.0


def test_confusion_keeps_zero_cells_and_groups(spark):
    from quarry.operators import metrics as M
    counts = spark.createDataFrame([("a", 0, 0, 5_000_000_000), ("a", 0, 1, 2), ("b", 2, 0, 1)], "g string, actual int, predicted int, n long")
    grid = {(r["g"], r["actual"], r["predicted"]): r["n"] for r in M.confusion_grid(counts, ["g"]).collect()}
    assert grid == {("a", 0, 0): 5_000_000_000, ("a", 0, 1): 2, ("a", 1, 0): 0, ("a", 1, 1): 0,
                    ("b", 0, 0): 0, ("b", 0, 2): 0, ("b", 2, 0): 1, ("b", 2, 2): 0}
    f1 = {r["g"]: r["accuracy"] for r in M.f1_weighted(M.confusion_grid(counts, ["g"]), ["g"]).collect()}
    assert math.isclose(f1["a"], 5_000_000_000 / 5_000_000_002) and f1["b"] == 0


def test_pooled_lookup_keeps_rows_without_a_hit(spark):
    from quarry.operators.lookup import pooled_lookup
    df = spark.createDataFrame([(1, [0, 0, 2]), (1, [9]), (2, []), (3, [0, 0, 2])], "id int, ids array<int>")
    table = spark.createDataFrame([(0, [1.0, 2.0]), (2, [4.0, 8.0])], "idx int, x array<double>")
    got = sorted((r["id"], r["n"], r["pooled"]) for r in pooled_lookup(df, "ids", table, 2).collect())
    assert got == [(1, 0, None), (1, 3, [2.0, 4.0]), (2, 0, None), (3, 3, [2.0, 4.0])]


def test_image_operators_match_loops(spark):
    from quarry.operators import image as I
    rng = np.random.default_rng(6)
    X = rng.normal(size=(3, 5, 7))
    df = spark.createDataFrame([(i, X[i].ravel().tolist()) for i in range(3)], "id int, x array<double>")
    K = [[1.0, 2.0, 0.0], [0.5, -1.0, 0.0], [0.0, 3.0, 1.0]]
    for stride in (1, 2):
        got = {(r["img"], r["r"], r["c"]): r["v"] for r in I.conv3x3(df, "id", "x", K, 5, 7, stride).collect()}
        pad = np.pad(X, ((0, 0), (1, 1), (1, 1)))
        want = {(i, r, c): (pad[i, r * stride:r * stride + 3, c * stride:c * stride + 3] * K).sum()
                for i in range(3) for r in range(-(-5 // stride)) for c in range(-(-7 // stride))}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    for how, f in (("avg", np.mean), ("max", np.max)):
        got = {(r["img"], r["r"], r["c"]): r["v"] for r in I.pool(df, "id", "x", 5, 7, 2, how).collect()}
        assert all(math.isclose(v, f(X[i, 2 * r:2 * r + 2, 2 * c:2 * c + 2])) for (i, r, c), v in got.items()) and len(got) == 3 * 3 * 4


def test_collects_are_bounded_in_bytes(spark):
    import pytest
    from quarry.operators.small import TooLargeError, collect_small
    df = spark.range(1000)
    assert len(collect_small(df)) == 1000
    with pytest.raises(TooLargeError):
        collect_small(df, "ids", max_bytes=4000)


def test_silhouettes_in_strips(spark, monkeypatch):
    from quarry.operators import cluster as CL
    monkeypatch.setattr(CL, "STRIP_ROWS", 7)
    rng = np.random.default_rng(11)
    x, a, b = rng.normal(size=(90, 3)), rng.integers(0, 3, 90), rng.integers(0, 2, 90)
    df = spark.createDataFrame([(i, v, int(p), int(q)) for i, (v, p, q) in enumerate(zip(x.tolist(), a, b))], "id long, x array<double>, a int, b int")
    got = {r["clustering"]: r["silhouette"] for r in CL.silhouettes_euclid(df, "id", ["a", "b"], tile_rows=25).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for k, c in enumerate((a, b)):
        s = []
        for i in range(90):
            own = (c == c[i]) & (np.arange(90) != i)
            near, far = d[i, own].mean(), min(d[i, c == o].mean() for o in set(c.tolist()) - {c[i]})
            s.append((far - near) / max(near, far))
        assert abs(got[k] - np.mean(s)) < 1e-9


def test_knn_ships_a_query_once_to_a_bundle(spark):
    from quarry.operators.neighbors import PivotIndex, knn
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 24))  # without structure: nearly every cell must be visited
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "rid long, x array<double>")
    index = PivotIndex(rows, 3, cell_rows=10)
    queries = rows.where("rid < 40").select(F.col("rid").alias("_qid"), F.col("x").alias("_x"))
    top, limited = index.search(queries)
    assert len(index.pivots) > 50 and index.visits(limited, True).count() <= 40 * 25
    want = {}
    for i in range(40):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want[i] = sorted(zip(d.tolist(), range(600)))[:3]
    got = {}
    for r in top.collect():
        got.setdefault(r["_qid"], []).append((r["dist"], r["_rid"]))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}
    found = knn(rows.where("rid < 40").withColumnRenamed("rid", "qid"), rows, 3)
    assert {(r["qid"], r["rid"]) for r in found.collect()} == {(i, j) for i, v in want.items() for _, j in v}
