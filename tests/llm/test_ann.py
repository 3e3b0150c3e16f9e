import math

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import ann
from quarry.llm.queries import QUERIES
from tests.conftest import SF_MID
from tests.llm.helpers import unit_rows

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, ask, k=5):
    """{query id: [(id, cosine)]} by comparing with all."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in good:
        if ask(q):
            near = sorted((-float((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum())), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_hilbert_curve_steps_to_a_neighbour():
    for width, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), -1).reshape(-1, width)
        keys = [k.tobytes() for k in ann.hilbert_keys(grid, bits)]
        walk = grid[sorted(range(len(grid)), key=keys.__getitem__)]
        assert len(set(keys)) == len(grid) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def same(got, want):
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_small_tables_and_edge_cases(spark):
    x = unit_rows(np.random.default_rng(0), 9, 6).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(50, x[3]), (51, x[3]), (52, [2 * c for c in x[3]]), (60, None), (61, []), (62, [0.0] * 6),
            (63, [math.nan] * 6), (64, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (65, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, x[0]), (0, x[0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS x", "3 AS at", "4 AS curve", "5 AS rank")
    rows = [r for n, r in enumerate(rows) if n != len(rows) - 1]  # the repeated row counts once
    same(found(ann.curve_neighbours(df, F.col("id") % 1 == 0)), plain(rows, lambda i: True))


def test_many_equal_vectors(spark):
    x = unit_rows(np.random.default_rng(1), 40, 8).tolist()
    rows = [(i, x[0] if i % 3 == 0 else x[i % 40]) for i in range(300)]
    got = found(ann.curve_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0))
    same(got, plain(rows, lambda i: i % 50 == 0))


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.curve_neighbours(none, F.lit(True)).collect() == []
    assert ann.curve_neighbours(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA), F.lit(True)).collect() == []


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(5)
    two, three = ([(i, v) for i, v in enumerate(unit_rows(rng, 100, w).tolist(), 100 * w)] for w in (2, 3))
    rows = [(1, [1.0]), *two, *three, (200, three[0][1])]  # an id with vectors of both lengths
    got = found(ann.curve_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("id") > 200))
    want = plain(two, lambda i: i > 200) | plain([*three, (200, three[0][1])], lambda i: True)
    want.pop(200)
    same(got, want)
    alone = found(ann.curve_neighbours(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), F.lit(True)))
    assert alone == {}


def test_wide_windows_keep_groups_small(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "MOST_VISITS", 100)
    x = unit_rows(np.random.default_rng(6), 700, 8).tolist()
    rows = list(enumerate(x))
    index = ann.CurveIndex(spark.createDataFrame(rows, SCHEMA), curves=4)
    index.windows = {8: 10**5}
    same(found(index.nearest(F.lit(True))), plain(rows, lambda i: True))  # the whole table is in the window: exact
    groups = index.search(index.vectors.select("vid"))
    assert groups.count() == 700 * index.k


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in x}) for q, x in want.items()) / sum(map(len, want.values()))


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(3)
    centres = unit_rows(rng, 30, 24)
    x = centres[rng.integers(0, 30, 3000)] + 0.05 * rng.normal(size=(3000, 24))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    index = ann.CurveIndex(spark.createDataFrame(rows, SCHEMA))
    got, want = found(index.nearest(F.col("id") % 50 == 0)), plain(rows, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.9 and index.windows[24] < 500


def test_query_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = found(QUERIES["op9_hilbert_neighbours"](spark, SF_MID)), plain(rows, lambda i: i % 50 == 0)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values()) and recall(got, want) >= 0.9
