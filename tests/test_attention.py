"""Tiled attention against a softmax over all keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import attention as A


def _plain(x, pad, causal):
    s = x @ x.T / np.sqrt(x.shape[1])
    s[:, pad] = -np.inf
    if causal:
        s[np.triu_indices(len(x), 1)] = -np.inf
    with np.errstate(invalid="ignore"):
        w = np.exp(s - s.max(axis=1, keepdims=True))
    return np.where(np.isfinite(s.max(axis=1))[:, None], w @ x / w.sum(axis=1, keepdims=True), np.nan)


@pytest.mark.parametrize("causal", [False, True])
@pytest.mark.parametrize("tile", [512, 7])
def test_tiles_equal_whole_sequences(spark, causal, tile):
    rng = np.random.default_rng(0)
    seqs = {name: 3 * rng.normal(size=(n, 4)) for name, n in (("a", 40), ("b", 1), ("c", 7), ("d", 15), ("e", 3))}
    pads = {name: rng.random(len(x)) < 0.3 for name, x in seqs.items()}
    pads["e"][:] = True
    rows = [(s, i, v, bool(pads[s][i])) for s, x in seqs.items() for i, v in enumerate(x.tolist())]
    rows += [(None, 0, [1.0] * 4, False), ("a", None, [1.0] * 4, False), ("z", 0, None, False)]
    df = spark.createDataFrame(rows, "seq string, pos int, x array<double>, pad boolean").repartition(3)
    got = {(r["seq"], r["q_pos"]): r["out"] for r in A.attend(df, causal=causal, key_mask="pad", tile=tile).collect()}
    want = {(s, i): v for s, x in seqs.items() for i, v in enumerate(_plain(x, pads[s], causal)) if np.isfinite(v[0])}
    assert set(got) == set(want) and all(np.allclose(got[k], v) for k, v in want.items())
    assert A.attend(df.limit(0)).collect() == []


def test_a_long_sequence_is_never_held_whole(spark):
    n = 100_000
    x = F.array(F.sin("id"), F.cos(F.col("id") * 3))
    df = spark.range(n).select(F.lit(1).alias("seq"), F.col("id").alias("pos"), x.alias("x")).union(spark.range(512).select(F.lit(2), "id", x))
    some = A.attend(df.withColumn("pad", F.col("pos") % 20 != 3), key_mask="pad", tile=4096).where("q_pos % 9973 = 3")
    got = {(r["seq"], r["q_pos"]): r["out"] for r in some.collect()}
    for seq, m in ((1, n), (2, 512)):
        i = np.arange(m)
        v = np.stack([np.sin(i), np.cos(3 * i)], axis=1)
        keys = v[i % 20 == 3]
        for q in range(3, m, 9973):
            w = np.exp(keys @ v[q] / np.sqrt(2))
            assert np.allclose(got[(seq, q)], w @ keys / w.sum())
