"""Exact and approximate nearest neighbours without a cross join.

Both sides are assigned to the nearest of some pivots (reference rows picked by
a seeded hash) by the tasks that read them. A cell is known by its pivot, its
number of rows and its radius, which is all that the driver sees. A first round
compares a query with its own cell, which yields a k-th distance; by the triangle
inequality a cell whose pivot is further away than that distance and the radius
together can't hold a nearer row, so a second round ships the query only to the
cells that are left, and only rows within the distance come back. The answer is
exact, ties included (distance, then reference id).

Cells lie together in bundles, and a query is shipped once to a bundle with the
numbers of the cells that it visits there, so that what is shipped grows with the
queries even where every cell must be visited. A bundle and its queries are cut
into tiles of bounded size, each pair of which is one group. Equal reference vectors are kept with their smallest
ids only, equal query vectors are searched once.

Approximate search visits the nearest cells only, as many as a sample of
queries, searched exactly, needs for the wanted recall. A query that the bounds
clear before that is exact, and says so.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.small import collect_small, local_frame
from quarry.session import scratch_table

TILE_ROWS = 4096
CELL_ROWS, MOST_PIVOTS = 1024, 1 << 16  # rows of a cell, about; pivots that every task holds
BUNDLES, BUNDLE_TILES = 16, 4  # bundles of cells, about, and tiles of rows that one may hold
MOST_CANDIDATES = 1 << 17   # pairs whose distances are worked out at once


def _tiles(n: int, tile_rows: int) -> int:
    return max(1, math.ceil(n / tile_rows))


def _pair_block(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclid":
        d2 = (q * q).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2.0 * q @ t.T
        return np.sqrt(np.maximum(d2, 0.0))
    if metric == "sqeuclid":
        d2 = (q * q).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2.0 * q @ t.T
        return np.maximum(d2, 0.0)
    if metric == "cosine":  # distance = 1 - cosine
        qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        tn = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
        return 1.0 - qn @ tn.T
    raise ValueError(f"unknown metric {metric!r}")


def _exact_rows(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distance recomputed directly (for the few kept pairs)."""
    if metric == "euclid":
        return np.sqrt(((q - t) ** 2).sum(1))
    if metric == "sqeuclid":
        return ((q - t) ** 2).sum(1)
    qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    tn = t / np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-12)
    return 1.0 - (qn * tn).sum(1)


def _nearest_of(qid: np.ndarray, Q: np.ndarray, rid: np.ndarray, R: np.ndarray, k: int, metric: str,
                exclude_self: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, reference position, distance) of the k nearest; ties go
    to the smaller reference id. A fast product finds all that may be among them
    (however many are equally near), whose distances are then worked out alike."""
    D = _pair_block(Q, R, "sqeuclid" if metric == "euclid" else metric)
    if exclude_self:
        D = np.where(qid[:, None] == rid[None, :], np.inf, D)
    limit = np.full(len(qid), np.inf)
    if k < D.shape[1]:
        # what the products may be off by, on either side of the k-th
        size = np.full(len(qid), 2.0) if metric == "cosine" else (Q * Q).sum(1) + np.nanmax((R * R).sum(1))
        limit = np.partition(D, k - 1, axis=1)[:, k - 1] + (8 * Q.shape[1] + 64) * np.finfo(float).eps * size
        limit[np.isnan(limit)] = np.inf
    near = (D <= limit[:, None]) & np.isfinite(D)
    ends = np.cumsum(near.sum(1))
    out, a = [], 0
    while a < len(qid):  # some queries at a time: each may have many candidates
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST_CANDIDATES, "right")))
        qi, ri = np.nonzero(near[a:b])
        qi += a
        d = _exact_rows(Q[qi], R[ri], metric)
        order = np.lexsort((rid[ri], d, qi))
        qi, ri, d = qi[order], ri[order], d[order]
        first = np.searchsorted(qi, qi)  # where each query's candidates begin
        top = np.arange(len(qi)) - first < k
        out.append((qi[top], ri[top], d[top]))
        a = b
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _usable(x: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite entry."""
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))), F.lit(False))


class PivotIndex:
    """The reference rows by cell. ``ref`` has (r_id, features, ...extra columns
    carried to the output)."""

    def __init__(self, ref: DataFrame, k: int, r_id: str = "rid", features: str = "x", metric: str = "euclid", seed: int = 42,
                 cell_rows: int = CELL_ROWS, tile_rows: int = TILE_ROWS) -> None:
        from quarry.functions.hashing import hash_u60
        self.metric, self.tile_rows, self.k = metric, tile_rows, k
        self.extra = [c for c in ref.columns if c not in (r_id, features)]
        rows = ref.select(F.col(r_id).alias("_rid"), F.col(features).cast("array<double>").alias("_y"), *self.extra).where(_usable(F.col("_y")))
        n = ref.count()
        pivots = max(1, min(MOST_PIVOTS, math.ceil(n / cell_rows), math.ceil(max(64, math.sqrt(n)))))
        some = rows.withColumn("_h", hash_u60(seed, "_rid")).orderBy("_h", "_rid").select("_y").limit(pivots)
        self.pivots = self._space(np.array([r["_y"] for r in collect_small(some, "pivots")], float))
        # of equal vectors, those with larger ids are never among the nearest
        nth = F.row_number().over(Window.partitionBy("_y").orderBy("_rid"))
        rows = rows.withColumn("_n", nth).where(F.col("_n") <= k).drop("_n")
        self.schema = rows.schema

        def assign(batches):
            for pdf in batches:
                for at in self._steps(len(pdf)):
                    part = pdf.iloc[at:at + self._step]
                    d = self._to_pivots(np.stack(part["_y"].to_numpy()))
                    cell = d.argmin(1)
                    yield part.assign(_c=cell.astype("int32"), _d=d[np.arange(len(d)), cell])

        if not len(self.pivots):
            self.rows = None
            return
        kept = T.StructType([*self.schema.fields, T.StructField("_c", T.IntegerType()), T.StructField("_d", T.DoubleType())])
        self.rows = scratch_table(rows.mapInPandas(assign, kept), "knn-cells")
        self.counts, self.radius = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots))
        for r in collect_small(self.rows.groupBy("_c").agg(F.count("*").alias("n"), F.max("_d").alias("r")), "cells"):
            self.counts[r["_c"]], self.radius[r["_c"]] = r["n"], r["r"]
        self.bundle_rows = min(BUNDLE_TILES * tile_rows, max(cell_rows, n // BUNDLES))
        self.bundle, filled, b = np.zeros(len(self.pivots), np.int64), 0, 0
        for c, m in enumerate(self.counts.tolist()):
            if filled and filled + m > self.bundle_rows:
                filled, b = 0, b + 1
            self.bundle[c], filled = b, filled + m

    def __getstate__(self):  # what goes to the tasks
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, DataFrame)}

    def _space(self, x: np.ndarray) -> np.ndarray:
        """Where distances obey the triangle inequality: unit vectors for cosines."""
        if self.metric != "cosine" or not len(x):
            return x
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _steps(self, n: int) -> range:
        """Where batches begin that are worked on at once: fewer rows if there are many pivots."""
        return range(0, n, self._step)

    @property
    def _step(self) -> int:
        return max(1, min(256, (1 << 21) // max(1, len(self.pivots))))

    def _to_pivots(self, x: np.ndarray) -> np.ndarray:
        return _pair_block(self._space(x), self.pivots, "euclid")

    def _reach(self, limit: np.ndarray) -> np.ndarray:
        """A k-th distance in the space of the pivots."""
        if self.metric == "sqeuclid":
            return np.sqrt(limit)
        return np.sqrt(2 * np.maximum(limit, 0)) if self.metric == "cosine" else limit

    def _bounds(self, x: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The least distance that a row of each cell may have, less what rounding can take."""
        size = np.linalg.norm(self._space(x), axis=1)[:, None] + np.linalg.norm(self.pivots, axis=1)[None, :]
        return np.where(self.counts[None, :] > 0, d - self.radius[None, :] - 1e-6 * size, np.inf)

    def _home(self, d: np.ndarray) -> np.ndarray:
        """Marks the nearest cells that have k rows together."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.counts[order], axis=1) - self.counts[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < self.k, axis=1)
        return out & (self.counts > 0)

    def visits(self, queries: DataFrame, second: bool, probes: int | None = None) -> DataFrame:
        """(_qid, _x, _t, _b, _cs) for each bundle with cells that a query visits: at
        first its own (or the nearest, until they have k rows), later the others
        that may hold a row within ``_t``, its k-th distance so far; of the
        ``probes`` nearest cells only, if that is given."""
        def run(batches):
            for pdf in batches:
                for at in self._steps(len(pdf)):
                    part = pdf.iloc[at:at + self._step]
                    x = np.stack(part["_x"].to_numpy())
                    d = self._to_pivots(x)
                    go = self._home(d)
                    if second:
                        go = ~go & (self._bounds(x, d) <= self._reach(part["_t"].to_numpy())[:, None])
                        if probes is not None:
                            go &= np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) < probes
                    qi, ci = np.nonzero(go)
                    b = self.bundle[ci]  # grows with the number of the cell
                    begin = np.flatnonzero(np.concatenate([[True], (qi[1:] != qi[:-1]) | (b[1:] != b[:-1])])[:len(qi)])
                    go = part.iloc[qi[begin]]
                    cells = np.split(ci.astype("int32"), begin[1:]) if len(begin) else []
                    yield go.assign(_b=b[begin].astype("int32"), _cs=pd.Series(cells, go.index, dtype=object))

        return queries.mapInPandas(run, T.StructType([*queries.schema.fields, T.StructField("_b", T.IntegerType()),
                                                      T.StructField("_cs", T.ArrayType(T.IntegerType()))]))

    def compare(self, visits: DataFrame) -> DataFrame:
        """(_qid, _rid, dist, ...extra): of each pair of tiles the k
        nearest rows of the visited cells within the query's distance so far."""
        tile, k, metric, extra = self.tile_rows, self.k, self.metric, self.extra
        visits = scratch_table(visits, "knn-visits")  # one row for each query and bundle
        bundles = local_frame(visits.sparkSession, enumerate(self.bundle.tolist()), "_c int, _b int")
        rows = self.rows.join(bundles, "_c")
        sizes = visits.groupBy("_b").agg(F.ceil(F.count("*") / tile).cast("int").alias("_nq"))
        tiles = rows.groupBy("_b").agg(F.ceil(F.count("*") / self.bundle_rows).cast("int").alias("_nr")).join(sizes, "_b")
        own = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        rs = rows.join(tiles, "_b").select("_rid", "_y", *extra, "_c", F.col("_b").alias("_rb"), own("_rid", "_nr").alias("_rt"), every("_nq").alias("_rq"))
        qs = visits.join(tiles, "_b").select("_qid", "_x", "_t", "_cs", "_b", own("_qid", "_nq").alias("_qq"), every("_nr").alias("_qr"))
        schema = T.StructType([visits.schema["_qid"], T.StructField("_rid", self.schema["_rid"].dataType), T.StructField("dist", T.DoubleType()),
                               *[self.schema[c] for c in extra]])

        def block(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
            out = [rp.iloc[:0][["_rid", *extra]].assign(_qid=qp["_qid"].iloc[:0].to_numpy(), dist=np.zeros(0))[[f.name for f in schema.fields]]]
            if len(qp) and len(rp):
                rid, y, cell = rp["_rid"].to_numpy(), np.stack(rp["_y"].to_numpy()), rp["_c"].to_numpy()
                qid, x, t = qp["_qid"].to_numpy(), np.stack(qp["_x"].to_numpy()), qp["_t"].to_numpy()
                goes, to = np.repeat(np.arange(len(qp)), [len(c) for c in qp["_cs"]]), np.concatenate(list(qp["_cs"]))
                for c in np.unique(cell):
                    mine, all_visit = np.flatnonzero(cell == c), goes[to == c]
                    for a in range(0, len(all_visit), 512):
                        visit = all_visit[a:a + 512]
                        qi, ri, d = _nearest_of(qid[visit], x[visit], rid[mine], y[mine], k, metric)
                        near = d <= t[visit][qi]
                        found = rp.iloc[mine[ri[near]]][["_rid", *extra]].assign(_qid=qid[visit[qi[near]]], dist=d[near])
                        out.append(found[[f.name for f in schema.fields]])
            if len(out) == 1:
                return out[0]
            found = pd.concat(out, ignore_index=True)
            found = found.iloc[np.lexsort((found["_rid"], found["dist"], found["_qid"]))]
            return found[found.groupby("_qid").cumcount() < k]  # of all cells of the group

        return qs.groupBy("_b", "_qq", "_qr").cogroup(rs.groupBy("_rb", "_rq", "_rt")).applyInPandas(block, schema)

    def best(self, found: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("_qid").orderBy("dist", "_rid"))
        return found.withColumn("_rank", nth).where(F.col("_rank") <= self.k).drop("_rank")

    def search(self, queries: DataFrame, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The k nearest of each query (_qid, _x), and (_qid, _x, _t): the
        queries with the k-th distance of the first round."""
        first = scratch_table(self.best(self.compare(self.visits(queries.withColumn("_t", F.lit(float("inf"))), False))), "knn-first")
        limit = first.groupBy("_qid").agg(F.when(F.count("*") >= self.k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("_t"))
        limited = queries.join(limit, "_qid")
        second = self.compare(self.visits(limited, True, probes))
        return self.best(first.unionByName(second)), limited


def _distinct_queries(queries: DataFrame, q_id: str, features: str) -> tuple[DataFrame, DataFrame]:
    """All usable queries (_id, _x), and each different vector once (_qid: the smallest id that has it)."""
    every = queries.select(F.col(q_id).alias("_id"), F.col(features).cast("array<double>").alias("_x")).where(_usable(F.col("_x")))
    return every, scratch_table(every.groupBy("_x").agg(F.min("_id").alias("_qid")).select("_qid", "_x"), "knn-queries")


def _ranked(every: DataFrame, asked: DataFrame, top: DataFrame, k: int, q_id: str, r_id: str, extra: list[str], exclude_self: bool) -> DataFrame:
    """The answers of the different vectors, given to every query that has them."""
    reps = every.join(asked, "_x").select("_id", "_qid")
    mine = reps.join(top, "_qid").drop("_qid")
    if exclude_self:
        mine = mine.where(F.col("_id") != F.col("_rid"))
    w = Window.partitionBy("_id").orderBy("dist", "_rid")
    return (mine.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("_id").alias(q_id), F.col("_rid").alias(r_id), "dist", F.col("rank").cast("int").alias("rank"), *extra))


def _no_rows(queries: DataFrame, ref: DataFrame, q_id: str, r_id: str, extra: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(q_id, queries.schema[q_id].dataType), T.StructField(r_id, ref.schema[r_id].dataType),
                           T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType()), *[ref.schema[c] for c in extra]])
    return local_frame(ref.sparkSession, [], schema)


def knn(queries: DataFrame, ref: DataFrame, k: int, q_id: str = "qid", r_id: str = "rid",
        features: str = "x", metric: str = "euclid", exclude_self: bool = False) -> DataFrame:
    """(qid, rid, dist, rank) for the k nearest reference rows of each query.

    ``queries`` has (q_id, features), ``ref`` has (r_id, features, ...extra
    columns carried to the output); ids are numbers, each of one row. Vectors
    that are null, empty or hold a null, NaN or infinite entry take no part on
    either side. A side without rows gives no rows."""
    index = PivotIndex(ref, k + bool(exclude_self), r_id, features, metric)
    if index.rows is None:
        return _no_rows(queries, ref, q_id, r_id, index.extra)
    every, asked = _distinct_queries(queries, q_id, features)
    return _ranked(every, asked, index.search(asked)[0], k, q_id, r_id, index.extra, exclude_self)


def knn_classify(nn: DataFrame, q_id: str, label: str) -> DataFrame:
    """Majority label among the neighbours; ties -> smallest label."""
    c = nn.groupBy(q_id, label).agg(F.count("*").alias("n"))
    return c.groupBy(q_id).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("pred"))


def knn_proba(nn: DataFrame, q_id: str, label: str, k: int) -> DataFrame:
    """Share of each class among the k neighbours."""
    return nn.groupBy(q_id, label).agg((F.count("*") / F.lit(float(k))).alias("prob"))


def knn_regress(nn: DataFrame, q_id: str, target: str) -> DataFrame:
    return nn.groupBy(q_id).agg(F.avg(target).alias("pred"))


def knn_clustered(queries: DataFrame, ref: DataFrame, k: int, q_id: str = "qid", r_id: str = "rid", features: str = "x",
                  wanted: float = 0.95, sample: int = 256, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Approximate Euclidean kNN: (qid, rid, dist, rank, certified).

    A query visits its own cell and, of the others that may hold a nearer row,
    the nearest: as many as the ``sample`` queries with the lowest seeded hash,
    searched exactly, need for the ``wanted`` recall. ``certified`` says that no
    cell was left that could hold a nearer row, so that the answer is exact;
    :func:`knn` is the exact way for the others. Vectors that take no part in
    :func:`knn` take none here."""
    from quarry.functions.hashing import hash_u60
    index = PivotIndex(ref.select(r_id, features), k, r_id, features, "euclid", seed, cell_rows)
    if index.rows is None:
        return _no_rows(queries, ref, q_id, r_id, []).withColumn("certified", F.lit(True))
    every, asked = _distinct_queries(queries, q_id, features)
    some = scratch_table(asked.withColumn("_h", hash_u60(seed, "_qid")).orderBy("_h", "_qid").limit(sample).drop("_h"), "knn-sample")
    true = index.search(some)[0]
    cells = index.rows.select("_rid", F.col("_c").alias("_rc"))

    def depth(batches):  # how many cells must be visited, nearest first, to find the row
        for pdf in batches:
            for at in index._steps(len(pdf)):
                part = pdf.iloc[at:at + index._step]
                d = index._to_pivots(np.stack(part["_x"].to_numpy()))
                rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
                yield pd.DataFrame({"n": rank[np.arange(len(part)), part["_rc"].to_numpy()] + 1})

    needed = true.join(some, "_qid").join(cells, "_rid").select("_x", "_rc").mapInPandas(depth, "n long")
    depths = sorted(r["n"] for r in collect_small(needed, "depths of a sample"))
    probes = depths[min(len(depths) - 1, math.ceil(wanted * len(depths)))] if depths else 1
    top, limited = index.search(asked, probes)

    def cleared(batches):
        for pdf in batches:
            for at in index._steps(len(pdf)):
                part = pdf.iloc[at:at + index._step]
                x = np.stack(part["_x"].to_numpy())
                d = index._to_pivots(x)
                last = part["_last"].to_numpy()
                unseen = ~index._home(d) & (np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) >= probes)
                open_ = unseen & (index._bounds(x, d) <= index._reach(last)[:, None])
                yield part[["_qid"]].assign(certified=~open_.any(1))

    top = scratch_table(top, "knn-approx")
    last = top.groupBy("_qid").agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("_last"))
    sure = asked.join(last, "_qid").mapInPandas(cleared, T.StructType([asked.schema["_qid"], T.StructField("certified", T.BooleanType())]))
    return _ranked(every, asked, top.join(sure, "_qid"), k, q_id, r_id, ["certified"], False)


def recall(found: DataFrame, queries: DataFrame, ref: DataFrame, k: int, q_id: str = "qid", r_id: str = "rid", features: str = "x",
           sample: int = 256, seed: int = 42) -> float | None:
    """Share of the true k nearest that ``found`` has, over the ``sample``
    queries with the lowest seeded hash (None without any)."""
    from quarry.functions.hashing import hash_u60
    some = scratch_table(queries.withColumn("_h", hash_u60(seed, q_id)).orderBy("_h", q_id).limit(sample).drop("_h"), "knn-recall")
    true = knn(some, ref.select(r_id, features), k, q_id, r_id, features).select(q_id, r_id)
    hit = found.select(q_id, r_id, F.lit(1).alias("_hit"))
    return true.join(hit, [q_id, r_id], "left").agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double"))).first()[0]
