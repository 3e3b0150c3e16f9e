"""Scaled dot-product attention within sequences.

:func:`attend` cuts a sequence into tiles of positions. A pair of a query tile
and a key tile is worked out in one group and leaves, for each query, a mergeable
state: the greatest score, the sum of exponentials about it and the sum of
vectors weighted by them. The states of a query's key tiles are put together at
the end, so nothing ever holds all keys of a long sequence; short sequences share
groups. The work is Σ L², the rows shipped Σ L² / TILE.

:func:`attention_weights` returns the weights themselves, a row for each pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import vec as V
from quarry.session import scratch_table

TILE = 512                             # positions of a tile
GROUP_ROWS, LEAST_GROUPS = 4096, 64    # rows of a group, about; groups that small tables are dealt over


def attention_weights(df: DataFrame, seq: str = "seq", pos: str = "pos", x: str = "x",
                      causal: bool = False, key_mask: str | None = None, scale: float | None = None,
                      keep_values: bool = False) -> DataFrame:
    """(seq, q_pos, k_pos, weight) with weight = softmax_k(q·k / sqrt(d)).

    ``key_mask``: boolean column, True = padding; masked keys get no weight
    (their -inf score); a query whose keys are all masked yields no rows."""
    q = df.select(F.col(seq).alias("_s"), F.col(pos).alias("q_pos"), F.col(x).alias("_q"))
    kcols = [F.col(seq).alias("_s"), F.col(pos).alias("k_pos"), F.col(x).alias("_k")]
    k = df.select(*kcols, *([F.col(key_mask).alias("_m")] if key_mask else []))
    if key_mask:
        k = k.filter(~F.col("_m")).drop("_m")
    cond = [q["_s"] == k["_s"]]
    if causal:
        cond.append(k["k_pos"] <= q["q_pos"])
    pairs = q.join(k, on=cond).select(q["_s"], "q_pos", "k_pos", "_q", "_k")
    d = F.size("_q").cast("double")
    sc = F.lit(1.0 / math.sqrt(scale)) if scale else F.lit(1.0) / F.sqrt(d)
    s = pairs.withColumn("_sc", V.dot("_q", "_k") * sc)
    w = Window.partitionBy("_s", "q_pos")
    e = F.exp(F.col("_sc") - F.max("_sc").over(w))
    return s.withColumn("weight", e / F.sum(e).over(w)).select(
        F.col("_s").alias(seq), "q_pos", "k_pos", "weight", *(["_k"] if keep_values else []))


def attend(df: DataFrame, seq: str = "seq", pos: str = "pos", x: str = "x", causal: bool = False,
           key_mask: str | None = None, tile: int = TILE) -> DataFrame:
    """(seq, q_pos, out array<double>) = Σ_k weight · v_k (V = the same rows).

    Positions are whole numbers from 0, one row each. A query whose keys are all
    masked yields no row, as null sequences, positions and vectors take no part."""
    rows = df.select(F.col(seq).alias("_s"), F.col(pos).cast("long").alias("q_pos"), F.col(x).cast("array<double>").alias("_x"),
                     (F.col(key_mask) if key_mask else F.lit(False)).alias("_m")).where("_s IS NOT NULL AND q_pos IS NOT NULL AND _x IS NOT NULL")
    n, top = rows.agg(F.count("*"), F.max("q_pos")).first()
    own = F.floor(F.col("q_pos") / tile).cast("int")
    if (top or 0) < tile:
        rows = rows.withColumn("_last", F.lit(0))
    else:  # each sequence by its own length
        last = scratch_table(rows.groupBy("_s").agg(F.max(own).alias("_last")), "attention-lengths")
        rows = rows.join(last, "_s")
    rows = rows.withColumns({"_t": own, "_b": F.pmod(F.xxhash64("_s"), F.lit(max(LEAST_GROUPS, n // GROUP_ROWS)))})
    every = lambda a, z: F.explode(F.sequence(a, z))
    queries = rows.select("_b", F.col("_t").alias("_qt"), every(F.lit(0), F.col("_t") if causal else F.col("_last")).alias("_kt"),
                          "_s", "q_pos", "_x", F.lit(True).alias("_asks"))
    keys = rows.where(~F.col("_m")).select("_b", every(F.col("_t") if causal else F.lit(0), F.col("_last")).alias("_qt"), F.col("_t").alias("_kt"),
                                           "_s", "q_pos", "_x", F.lit(False).alias("_asks"))
    schema = T.StructType([rows.schema["_s"], *T.StructType.fromDDL("q_pos long, m double, z double, v array<double>").fields])

    def states(table: pa.Table) -> pa.Table:
        column = table["_x"].combine_chunks()
        x = column.flatten().to_numpy().reshape(len(column), -1)
        at, asks = table["q_pos"].to_numpy(), table["_asks"].to_numpy()
        which = pc.rank(table["_s"].combine_chunks(), tiebreaker="dense").to_numpy()
        order = np.lexsort((at, asks, which))
        ends = np.append(np.flatnonzero(np.diff(which[order])) + 1, len(order))
        found, a = [], 0
        for b in ends.tolist():
            mine, a = order[a:b], b
            q, k = mine[asks[mine]], mine[~asks[mine]]
            if not len(q) or not len(k):
                continue
            score = x[q] @ x[k].T / math.sqrt(x.shape[1])
            if causal:
                score[at[k][None, :] > at[q][:, None]] = -np.inf
            m = score.max(axis=1)
            some = np.isfinite(m)
            e = np.exp(score[some] - m[some, None])
            found.append((q[some], m[some], e.sum(axis=1), e @ x[k]))
        if not found:
            return pa.Table.from_batches([], pa.schema([table.schema.field("_s"), ("q_pos", pa.int64()), ("m", pa.float64()), ("z", pa.float64()),
                                                        ("v", pa.list_(pa.float64()))]))
        q, m, z, v = (np.concatenate(c) for c in zip(*found))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * x.shape[1]), pa.array(v.ravel()))
        return pa.Table.from_arrays([table["_s"].combine_chunks().take(pa.array(q)), pa.array(at[q]), pa.array(m), pa.array(z), vectors],
                                    names=["_s", "q_pos", "m", "z", "v"])

    found = queries.unionByName(keys).groupBy("_b", "_qt", "_kt").applyInArrow(states, schema)
    parts = found.groupBy("_s", "q_pos").agg(F.max("m").alias("_top"), F.collect_list(F.struct("m", "z", "v")).alias("_p"))
    share = lambda t: F.exp(t["m"] - F.col("_top"))
    total = F.aggregate("_p", F.lit(0.0), lambda z, t: z + share(t) * t["z"])
    out = F.aggregate("_p", F.array_repeat(F.lit(0.0), F.size(F.col("_p")[0]["v"])),
                      lambda acc, t: F.zip_with(acc, t["v"], lambda u, v: u + share(t) * v))
    return (parts.select("_s", "q_pos", total.alias("_z"), out.alias("_o"))
            .select(F.col("_s").alias(seq), "q_pos", F.transform("_o", lambda v: v / F.col("_z")).alias("out")))


def mean_pool(df: DataFrame, group: str, x: str = "x") -> DataFrame:
    """Average the vectors of each group into one."""
    p = df.select(group, F.posexplode(x).alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("m"))
    return (p.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_m"))
            .select(group, F.transform("_m", lambda t: t["m"]).alias("pooled")))
