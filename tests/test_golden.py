"""Hand-worked cases (3-20 rows) with known answers."""

import math

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import vec as V
from quarry.operators import attention as A
from quarry.operators.linalg import matmul_long


def test_tiny_attention_weights(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0, 1.0]), (0, 1, [0.0, 2.0, 0.0])], "seq long, pos long, x array<double>")
    w = {(r["q_pos"], r["k_pos"]): round(r["weight"], 3) for r in A.attention_weights(df).collect()}
    assert w == {(0, 0): 0.760, (0, 1): 0.240, (1, 0): 0.090, (1, 1): 0.910}
    out = {r["q_pos"]: r["out"] for r in A.attend(df).collect()}
    ww = np.array([[w[(0, 0)], w[(0, 1)]], [w[(1, 0)], w[(1, 1)]]])
    assert np.allclose(out[0], ww[0] @ np.array([[1, 0, 1], [0, 2, 0]]), atol=2e-3)


def test_attention_identical_rows_returns_row(spark):
    v = [0.3, -1.0, 2.0]
    df = spark.createDataFrame([(1, i, v) for i in range(4)], "seq long, pos long, x array<double>")
    for r in A.attend(df).collect():
        assert np.allclose(r["out"], v)


def test_causal_first_position_sees_itself(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "seq long, pos long, x array<double>")
    out = {r["q_pos"]: r["out"] for r in A.attend(df, causal=True).collect()}
    assert np.allclose(out[0], [1.0, 0.0])


def test_all_padding_query_has_no_output(spark):
    df = spark.createDataFrame([(0, 0, [1.0], True), (0, 1, [2.0], True), (1, 0, [3.0], False)],
                               "seq long, pos long, x array<double>, pad boolean")
    rows = A.attend(df, key_mask="pad").collect()
    assert {r["seq"] for r in rows} == {1}


def test_small_matrices(spark):
    a = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate([[1, 2], [3, 4]]) for j, v in enumerate(row)],
                              "row long, k long, v double")
    b = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate([[5, 6], [7, 8]]) for j, v in enumerate(row)],
                              "k long, col long, v double")
    c = {(r["row"], r["col"]): r["value"] for r in matmul_long(a, b, "row", "k", "col").collect()}
    assert c == {(0, 0): 19.0, (0, 1): 22.0, (1, 0): 43.0, (1, 1): 50.0}
    df = spark.createDataFrame([([1.0, 2.0], [5.0, 6.0]), ([3.0, 4.0], [7.0, 8.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.mul("a", "b")).collect()] == [[5.0, 12.0], [21.0, 32.0]]
    m = spark.createDataFrame([([1.0, 2.0, 3.0],), ([4.0, 5.0, 6.0],)], "a array<double>")
    assert [r[0] for r in m.select(V.add("a", V.lit_vector([1, 0, 1]))).collect()] == [[2.0, 2.0, 4.0], [5.0, 5.0, 7.0]]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(V.norm("a", 2).alias("l2"), V.norm("a", 1).alias("l1"), V.cosine("a", "z").alias("cz"),
                  V.euclid("a", "z").alias("d"), V.softmax("a").alias("sm"), V.log_softmax("a").alias("lsm"),
                  V.layernorm("a").alias("ln"), V.onehot(F.lit(1), 3).alias("oh"),
                  V.sinusoid_position(F.lit(1), 4).alias("pe")).first()
    assert r["l2"] == 5.0 and r["l1"] == 7.0 and r["cz"] == 0.0 and r["d"] == 5.0
    assert abs(sum(r["sm"]) - 1.0) < 1e-12
    assert np.allclose(np.exp(r["lsm"]), r["sm"])
    assert np.allclose(r["ln"], [-1.0, 1.0], atol=1e-4)
    assert r["oh"] == [0.0, 1.0, 0.0]
    assert np.allclose(r["pe"], [math.sin(1), math.cos(1), math.sin(1 / 100), math.cos(1 / 100)])


def test_activations(spark):
    df = spark.createDataFrame([([-1.0, 0.0, 2.0],)], "x array<double>")
    r = df.select(*[V.activation("x", k).alias(k) for k in V.ACTIVATIONS]).first()
    x = np.array([-1.0, 0.0, 2.0])
    sig = 1 / (1 + np.exp(-x))
    assert np.allclose(r["relu"], np.maximum(0, x))
    assert np.allclose(r["sigmoid"], sig)
    assert np.allclose(r["silu"], x * sig)
    assert np.allclose(r["gelu"], 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x ** 3))))


def test_unknown_similarity_rejected(spark):
    import pytest
    from quarry.operators import centroid as C
    with pytest.raises(ValueError):
        C.score_columns(F.col("x"), [0], [[1.0]], "manhattan")
