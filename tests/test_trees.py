"""Trees grown level by level, against plain versions that hold all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import trees as TR


def _data(n=240, d=5, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    y = ((x[:, 0] > 0.2).astype(int) + (x[:, 1] + x[:, 2] > 0.5)) % k
    y = np.where(rng.random(n) < 0.1, rng.integers(0, k, n), y)
    return x, y


def _frame(spark, x, y):
    rows = [(i, float(c), v) for i, (c, v) in enumerate(zip(y, x.tolist()))]
    return spark.createDataFrame(rows, "id long, label double, x array<double>").repartition(4)


def _scores(sums, kind):
    with np.errstate(divide="ignore", invalid="ignore"):
        return (sums**2).sum() / sums.sum() if kind == "gini" else sums[0] ** 2 / (sums[1] + 1.0)


def _plain_split(b, sums, features, bins, kind):
    """The first best (slot, bin) over all rows of a node."""
    best, at = 1e-9, None
    total = sums.sum(0)
    count = (lambda s: s.sum()) if kind == "gini" else (lambda s: s[-1])
    for slot, f in enumerate(features):
        for c in range(bins):
            left = sums[b[:, f] <= c].sum(0)
            right = total - left
            if count(left) > 0.5 and count(right) > 0.5:
                gain = _scores(left, kind) + _scores(right, kind) - _scores(total, kind)
                if gain > best + 1e-9:
                    best, at = gain, (slot, c)
    return at


@pytest.mark.parametrize("part_cells", [None, 500])
def test_forest_equals_plain_trees(spark, monkeypatch, part_cells):
    if part_cells:
        monkeypatch.setattr(TR, "PART_CELLS", part_cells)
        monkeypatch.setattr(TR, "_KEPT_CELLS", 300)
    x, y = _data()
    bins = 8
    forest = TR.fit_forest(_frame(spark, x, y), "id", 4, max_depth=4, bins=bins, per_split=2, seed=3)
    rows = {r["id"]: r for r in forest.rows.collect()}
    b = np.array([list(rows[i]["bins"]) for i in range(len(x))])
    draws = np.array([list(rows[i]["draws"]) for i in range(len(x))])
    assert (b == TR._binned(x, forest.cuts)).all() and draws.shape == (len(x), 4) and 0.7 < draws.mean() < 1.3
    trees = forest.trees
    # grow the same trees one node at a time, with the features that the levels drew
    open_ = [(t, np.ones(len(x), bool)) for t in range(4)]
    nodes = list(range(4))
    for depth in range(4):
        subset = np.argsort(np.random.default_rng([3, depth]).random((len(open_), 5)), axis=1)[:, :2]
        following = []
        for (t, mine), node, features in zip(open_, nodes, subset):
            one = np.eye(3)[y] * draws[:, [t]] * mine[:, None]
            assert np.allclose(trees.value[node], one.sum(0))
            at = _plain_split(b, one, features, bins, "gini")
            if at is None:
                assert trees.feature[node] == -1
                continue
            assert (trees.feature[node], trees.cut[node]) == (features[at[0]], at[1])
            goes = b[:, features[at[0]]] <= at[1]
            for child, side in ((trees.left[node], goes), (trees.left[node] + 1, ~goes)):
                if (trees.value[child] > 0).sum() > 1:
                    following.append(((t, mine & side), child))
        open_, nodes = [f for f, _ in following], [c for _, c in following]
    # the out-of-bag votes are those of the trees that haven't seen the row
    got = {r["id"]: (r["y"], r["pred"]) for r in forest.out_of_bag().collect()}
    assert set(got) == set(np.flatnonzero((draws == 0).any(1)).tolist())
    for i, (label, pred) in got.items():
        votes = sum(trees.value[n] / trees.value[n].sum() for t in range(4) if draws[i, t] == 0 for n in trees.leaves(b[i:i + 1], t))
        assert label == y[i] and pred == votes.argmax()


def test_forest_learns(spark):
    x, y = _data(1200, seed=1)
    df = _frame(spark, x, y)
    forest = TR.fit_forest(df.where("id % 4 <> 0"), "id", 30, seed=1)
    test = forest.predict(df.where("id % 4 = 0"), "id")
    accuracy = test.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    oob = forest.out_of_bag().agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    assert accuracy > 0.8 and abs(accuracy - oob) < 0.1


def test_boosting_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(TR, "ROUNDS_KEPT", 2)
    x, y = _data(200, d=4, seed=2)
    bins, k, rounds = 8, 3, 5
    model = TR.fit_boosting(_frame(spark, x, y), "id", rounds=rounds, max_depth=3, bins=bins, rate=0.3)
    b = TR._binned(x, model.cuts)
    margins = np.tile(np.log(np.bincount(y) / len(y)), (len(x), 1))
    assert np.allclose(model.base, margins[0]) and len(model.trees.roots) == rounds * k
    for r in range(rounds):
        e = np.exp(margins)
        p = e / e.sum(1, keepdims=True)
        step = np.zeros_like(margins)
        for c in range(k):
            sums = np.stack([(y == c) - p[:, c], p[:, c] * (1 - p[:, c]), np.ones(len(x))], axis=1)

            def grow(node, mine, depth):
                own = sums * mine[:, None]
                leaf = own.sum(0)[0] / (own.sum(0)[1] + 1.0) * (k - 1) / k
                assert abs(model.trees.value[node, 0] - leaf) < 1e-9
                at = _plain_split(b, own, range(4), bins, "newton") if depth < 3 else None
                if at is None:
                    assert model.trees.feature[node] == -1
                    step[mine, c] = 0.3 * leaf
                    return
                assert (model.trees.feature[node], model.trees.cut[node]) == at
                goes = b[:, at[0]] <= at[1]
                grow(model.trees.left[node], mine & goes, depth + 1)
                grow(model.trees.left[node] + 1, mine & ~goes, depth + 1)

            grow(model.trees.roots[r * k + c], np.ones(len(x), bool), 0)
        margins += step
    pred = {r["id"]: r["pred"] for r in model.predict(_frame(spark, x, y), "id").collect()}
    assert [pred[i] for i in range(len(x))] == margins.argmax(1).tolist() and (margins.argmax(1) == y).mean() > 0.8


def test_edge_cases(spark):
    none = spark.createDataFrame([], "id long, label double, x array<double>")
    same = spark.createDataFrame([(i, 2.0, [1.0, 1.0]) for i in range(9)] + [(9, None, [1.0, 1.0]), (10, 2.0, None)], none.schema)
    for fit in (lambda df: TR.fit_forest(df, "id", 3), lambda df: TR.fit_boosting(df, "id", rounds=2)):
        assert fit(none).predict(same, "id").collect() == []
        assert {r["pred"] for r in fit(same).predict(same, "id").collect()} == {2}
    mixed = same.unionByName(spark.createDataFrame([(20, 1.0, [1.0, 1.0])], none.schema))  # nothing to tell the classes by
    assert {r["pred"] for r in TR.fit_forest(mixed, "id", 3).predict(mixed, "id").collect()} == {2}


def _walk(forest, deep, b, t):
    """The sums in the leaf of a row in a tree, node by node, also below a node that was handed over."""
    trees, at = forest.trees, forest.trees.roots[t]
    while trees.feature[at] >= 0:
        at = trees.left[at] + (b[trees.feature[at]] > trees.cut[at])
    if forest.part[at] < 0:
        return trees.value[at], at
    names, feature, cut, left, value = deep[forest.part[at]]
    n = int(np.flatnonzero(names == at)[0])
    while feature[n] >= 0:
        n = left[n] + (b[feature[n]] > cut[n])
    return value[n], at


@pytest.mark.parametrize("hard", [False, True])
def test_forest_with_more_open_nodes_than_the_driver_holds(spark, monkeypatch, hard):
    from quarry.operators.small import collect_small
    monkeypatch.setattr(TR, "collect_small", lambda df, what: collect_small(df, what, 1 << 16))  # 30 splits
    monkeypatch.setattr(TR, "MOST_OPEN", 12, raising=False)
    monkeypatch.setattr(TR, "GROUP_ROWS", 60, raising=False)
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(400, 5)).round(2), rng.integers(0, 3, 400)
    df = _frame(spark, np.vstack([x, x[:30]]), np.concatenate([y, y[:30]])).withColumn("id", F.col("id") % 400)  # some rows twice
    forest = TR.fit_forest(df, "id", 6, bins=16, seed=5)
    forest.hard = hard
    whole = forest.deep.collect()
    assert len(whole) > 10
    deep = {r["part"]: [*(np.frombuffer(r[c], np.int64) for c in ("names", "feature", "cut", "left")), np.frombuffer(r["value"], float).reshape(-1, 3)] for r in whole}
    rows = [(r["id"], r["y"], np.frombuffer(r["bins"], np.uint8), np.frombuffer(r["draws"], np.uint8)) for r in forest.rows.collect()]
    # what lies in a leaf is what its tree drew, and a leaf that is not pure can't be cut
    inside = {}
    for _, c, b, w in rows:
        for t in range(6):
            if w[t]:
                value, at = _walk(forest, deep, b, t)
                inside.setdefault((at, value.tobytes(), id(value.base), value.ctypes.data), []).append((c, w[t], b.tobytes()))
    for (_, value, *_), got in inside.items():
        assert np.frombuffer(value).tolist() == [sum(int(w) for c, w, _ in got if c == k) for k in range(3)]
        assert len({c for c, _, _ in got}) == 1 or len({b for _, _, b in got}) == 1 or len({b for _, _, b in got}) < 4
    vote = lambda v: np.eye(3)[v.argmax()] if hard else v / v.sum()

    def pred(b, trees):
        return int(np.round(sum(vote(_walk(forest, deep, b, t)[0]) for t in trees), 9).argmax())

    want = sorted((i, c, pred(b, np.flatnonzero(w == 0))) for i, c, b, w in rows if (w == 0).any())
    assert sorted(map(tuple, forest.out_of_bag().collect())) == want
    want = sorted((i, c, pred(b, range(6))) for i, c, b, _ in rows)
    assert sorted((r["id"], int(r["label"]), r["pred"]) for r in forest.predict(df, "id").collect()) == want


def test_rest_of_a_tree_equals_plain_version():
    rng = np.random.default_rng(8)
    n, k, bins, slots = 150, 3, 8, 2
    b, y, w = rng.integers(0, bins, (n, 4)).astype(np.uint8), rng.integers(0, k, n), rng.integers(1, 3, n).astype(float)
    root, names, levels = rng.integers(0, 2, n), np.array([17, 40]), np.array([30, 2])
    trees = TR.grow_rest(root, y, w, b, names, levels, slots, bins, k, 1)
    path = TR._mix(names.astype(np.uint64) ^ TR._mix(np.array([1])))
    todo = [(i, root == i, path[i], int(levels[i])) for i in range(2)]
    seen = 0
    while todo:
        node, rows, name, left = todo.pop()
        sums = np.zeros((n, k))
        sums[np.arange(n), y] = w
        assert trees.value[node].tolist() == sums[rows].sum(0).tolist()
        subset = np.argsort(TR._mix(name + np.arange(4, dtype=np.uint64)), kind="stable")[:slots]
        found = _plain_split(b[rows], sums[rows], subset, bins, "gini") if left and (sums[rows].sum(0) > 0).sum() > 1 else None
        assert (trees.feature[node] >= 0) == bool(found)
        if found:
            seen += 1
            feature, cut = subset[found[0]], found[1]
            assert (trees.feature[node], trees.cut[node]) == (feature, cut)
            for side in (0, 1):
                todo.append((trees.left[node] + side, rows & ((b[:, feature] > cut) == side), TR._mix(name[None] * np.uint64(2) + np.uint64(side))[0], left - 1))
    assert seen > 20


def test_early_hand_over_is_one_whole_tree(spark, monkeypatch):
    monkeypatch.setattr(TR, "GROUP_CELLS", 200)  # 40 rows of a node
    x, y = _data(seed=5)
    df = _frame(spark, x, y)
    tree = TR.fit_tree(df, "id", max_depth=30)
    assert len(tree.part) and len(tree.part) < 60 and tree.deep.count() > 1  # the driver has the first levels only
    got = {r["id"]: r["pred"] for r in tree.predict(df, "id").collect()}
    b = TR._binned(x, tree.cuts)
    alone = {tuple(v) for v, n in zip(*np.unique(b, axis=0, return_counts=True)) if n == 1}
    assert all(got[i] == y[i] for i in range(len(x)) if tuple(b[i]) in alone) and len(alone) > 200  # grown until nodes are pure
    whole = TR.fit_forest(df, "id", 1, per_split=5, draws=F.array(F.lit(1)), max_depth=30)
    assert not len(whole.part)
    rng = np.random.default_rng(1)
    other = _frame(spark, rng.normal(size=(300, 5)), np.zeros(300))
    a, z = ({r["id"]: r["pred"] for r in t.predict(other, "id").collect()} for t in (tree, whole))
    assert np.mean([a[i] == z[i] for i in a]) > 0.85  # but for splits that are equally good


def test_trees_of_all_folds_grow_together(spark, monkeypatch):
    from quarry.operators import models as MD
    monkeypatch.setattr(TR, "GROUP_CELLS", 200)
    x, y = _data(n=600, seed=6)
    df = _frame(spark, x, y).withColumn("fold", (F.col("id") % 3).cast("int"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: (t != F.col("fold")).cast("int"))
    forest = TR.fit_forest(df, "id", 4, per_split=5, draws=draws, early=True)
    got = {r["id"]: r["shares"] for r in forest.out_of_bag_shares().collect()}
    assert len(got) == 600 and all(abs(sum(v) - 1) < 1e-9 for v in got.values())
    for fold in range(3):  # the tree of a fold is that of the other rows alone
        own = TR.fit_forest(df.where(F.col("fold") != fold), "id", 1, per_split=5, draws=F.array(F.lit(1)), early=True)
        own.cuts = forest.cuts
        want = {r["id"]: r["shares"] for r in own.class_shares(df.where(F.col("fold") == fold), "id").collect()}
        assert np.mean([np.argmax(got[i]) == np.argmax(v) for i, v in want.items()]) > 0.75
    every = {r["id"]: r["shares"] for r in forest.class_shares(df, "id", trees=[3]).collect()}
    assert np.mean([np.argmax(every[i]) == y[i] for i in every]) > 0.97
    monkeypatch.setattr(MD, "SPARK_TREE_ROWS", 100)
    vectors = MD.with_vector(df.drop("fold"))
    plain = MD.tree_predictions(vectors, vectors, "id").collect()
    assert len(plain) == 600 and np.mean([r["pred"] == r["label"] for r in plain]) > 0.97
    out = MD.stacking(vectors.where("id % 4 != 0"), vectors.where("id % 4 = 0"), "id", 3, meta_trees=10).collect()
    assert len(out) == 150 and np.mean([r["pred"] == r["label"] for r in out]) > 0.75


def test_tree_of_one_class_or_no_rows(spark):
    x, y = _data(n=40)
    assert {r["pred"] for r in TR.fit_tree(_frame(spark, x, y * 0 + 2), "id").predict(_frame(spark, x, y), "id").collect()} == {2}
    assert TR.fit_tree(_frame(spark, x, y).limit(0), "id").predict(_frame(spark, x, y), "id").collect() == []
    forest = TR.fit_forest(_frame(spark, x, y * 0), "id", 2, draws=F.array((F.col("id") % 2).cast("int"), F.lit(1)), early=True)
    assert [(r["id"], r["shares"]) for r in forest.out_of_bag_shares().orderBy("id").collect()] == [(i, [1.0]) for i in range(0, 40, 2)]


def test_large_forests_stay_out_of_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(TR, "EARLY_ROWS", 1000)
    monkeypatch.setattr(TR, "GROUP_CELLS", 400)  # 200 rows of a node
    x, y = _data(n=1600, seed=7)
    forest = TR.fit_forest(_frame(spark, x, y), "id", 4, seed=3)
    whole = TR.fit_forest(_frame(spark, x, y), "id", 4, seed=3, early=False)
    assert not len(whole.part) and len(forest.trees.feature) < len(whole.trees.feature) / 5 and forest.deep.count() > 4
    a, z = ({r["id"]: (r["y"], r["pred"]) for r in f.out_of_bag().collect()} for f in (forest, whole))
    assert a.keys() == z.keys()
    right = [np.mean([u == v for u, v in got.values()]) for got in (a, z)]
    assert abs(right[0] - right[1]) < 0.1


def _plain_means(b, y, depth):
    """What a regression tree on all rows and features says of each row."""
    best, at = 1e-9, None
    for f in range(b.shape[1]):
        for c in np.unique(b[:, f])[:-1]:
            left = b[:, f] <= c
            gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
            if gain > best + 1e-9:
                best, at = gain, left
    if at is None or not depth:
        return np.full(len(y), y.mean())
    out = np.empty(len(y))
    out[at], out[~at] = _plain_means(b[at], y[at], depth - 1), _plain_means(b[~at], y[~at], depth - 1)
    return out


def _numbers(spark, n=900):
    rng = np.random.default_rng(9)
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 90, n), rng.integers(0, 3, n)], axis=1).astype(float)
    y = 50.0 * (x[:, 0] > 4) + x[:, 1] + 20 * x[:, 2] * (x[:, 0] > 8) + rng.normal(size=n) + 900
    return x, y, spark.createDataFrame([(i, v, list(r)) for i, (v, r) in enumerate(zip(y.tolist(), x.tolist()))], "id long, y double, x array<double>")


def test_grid_tree_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(TR, "poisson1_thresholds", lambda: [0.0])  # every row once
    monkeypatch.setattr(TR, "_KEPT_ROWS", 50)
    x, y, df = _numbers(spark)
    fitted = TR.fit_grid_forest(df, "id", 1, max_depth=5, bins=16, per_split=3)
    assert fitted.shape[0] == 12 and fitted.shape[2] == 3 and 10 < fitted.shape[1] <= 16
    want = _plain_means(TR._binned(x, fitted.cuts), y - y.mean(), 5) + y.mean()
    got = {r["id"]: r["prediction"] for r in fitted.predict(df, "id").collect()}
    assert np.abs(np.array([got[i] for i in range(len(y))]) - want).max() < 1e-6


def test_grid_forest_draws_rows_and_learns(spark, monkeypatch):
    from quarry.operators import models as MD
    x, y, df = _numbers(spark)
    train, test = df.where("id % 4 != 0"), df.where("id % 4 = 0")
    monkeypatch.setattr(MD, "SPARK_TREE_ROWS", 100)
    errors = []
    for cells in (TR.GRID_CELLS, 10):  # with a grid too large the trees are Spark's
        monkeypatch.setattr(TR, "GRID_CELLS", cells)
        got = MD.forest_values(MD.with_vector(train), MD.with_vector(test), "id").collect()
        errors.append(np.sqrt(np.mean([(r["prediction"] - r["y"]) ** 2 for r in got])))
        assert len(got) == 225
    assert errors[0] < 1.15 * errors[1] and errors[0] < 0.5 * y.std()
    monkeypatch.setattr(TR, "GRID_CELLS", 1 << 15)
    a, b = (TR.fit_grid_forest(d, "id", 10).predict(test, "id").orderBy("id").collect() for d in (train, train.repartition(7).orderBy("y")))
    assert np.abs(np.array([r["prediction"] for r in a]) - [r["prediction"] for r in b]).max() < 1e-9
    # rows without a key, or that come twice, are drawn one by one
    same = spark.createDataFrame([(None, float(i % 2), [1.0]) for i in range(400)], df.schema)
    said = [np.frombuffer(r["value"])[0] for r in TR.fit_grid_forest(same, "id", 40).trees.collect()]
    assert len(set(said)) > 20 and 0.01 < np.std(said) < 0.06 and abs(np.mean(said) - 0.5) < 0.03
