"""Clustering: one k-means step, inertia, silhouettes, k sweeps.

* squared-Euclidean silhouette is exact in O(n K): the mean squared
  distance from x to cluster C is |x|² - 2 x·S_C/n_C + Q_C/n_C from the
  per-cluster sums S_C (vector), Q_C (Σ|y|²) and counts n_C;
* Euclidean silhouette has no such decomposition; it reuses the tiled
  block nested loop of :mod:`quarry.operators.neighbors`, each tile pair
  emitting only per-(point, cluster) distance sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import vec as V
from quarry.functions.hashing import hash_u60, hash_unit
from quarry.operators import centroid as C
from quarry.operators.neighbors import _tiles
from quarry.operators.small import collect_small, local_frame

SEED_ROUNDS, MOST_ROUNDS = 5, 300
TILE_ROWS, STRIP_ROWS, LEAST_TILES = 1 << 14, 512, 8  # rows of a tile of pairs, and that meet the other tile at once; tiles of a small table
SAMPLED_ROWS = 50   # of a cluster, for an estimated silhouette


def assign(df: DataFrame, centers: list, ids: list, features: str = "x", out: str = "cluster") -> DataFrame:
    """Nearest center by Euclidean distance; ties -> first (lowest) id."""
    s = F.transform(V.lit_matrix(centers), lambda c: -V.sq_euclid(F.col(features), c))
    return df.withColumn(out, C.argmax_label(s, ids))


def kmeans_step(df: DataFrame, centers: list, ids: list, features: str = "x") -> DataFrame:
    """One assign + update round: (cluster, n, centroid)."""
    a = assign(df, centers, ids, features)
    return C.class_average(a.select("cluster", F.col(features).alias("x")), "x", "cluster")


def inertia(df: DataFrame, centers: list, ids: list, features: str = "x", cluster: str = "cluster") -> DataFrame:
    """Σ squared distance of every row to its own center."""
    m = V.lit_matrix(centers)
    pos = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(cluster)).cast("int")
    return df.agg(F.sum(V.sq_euclid(F.col(features), F.element_at(m, pos))).alias("inertia"))


def silhouette_sq(df: DataFrame, features: str = "x", cluster: str = "cluster") -> DataFrame:
    """Mean silhouette with squared Euclidean distance, exact, O(n K)."""
    stats = C.class_average(df.select(cluster, F.col(features).alias("x")), "x", cluster)
    q = df.groupBy(cluster).agg(F.sum(V.dot(features, features)).alias("q"))
    rows = collect_small(stats.join(q, cluster), "cluster sums")
    ids = sorted(r[cluster] for r in rows)
    by = {r[cluster]: r for r in rows}
    mus = [list(by[c]["centroid"]) for c in ids]
    ns = [float(by[c]["n"]) for c in ids]
    qs = [float(by[c]["q"]) for c in ids]
    x = F.col(features)
    nrm = V.dot(x, x)
    # mean squared distance to every cluster (own cluster: excluding self)
    own_pos = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(cluster)).cast("int")
    means = F.transform(V.lit_matrix(mus), lambda mu, j: nrm - 2.0 * V.dot(x, mu)
                        + F.element_at(V.lit_vector(qs), j + 1) / F.element_at(V.lit_vector(ns), j + 1))
    n_own = F.element_at(V.lit_vector(ns), own_pos)
    a = F.when(n_own > 1, F.element_at(F.col("_m"), own_pos) * n_own / (n_own - 1)).otherwise(F.lit(None))
    b = F.array_min(F.filter(F.transform(F.col("_m"), lambda v, j: F.when(j + 1 == own_pos, F.lit(None)).otherwise(v)),
                             lambda v: v.isNotNull()))
    s = F.when(a.isNull(), 0.0).otherwise((b - a) / F.greatest(a, b))
    return df.select(means.alias("_m"), cluster).select(F.avg(s).alias("silhouette"))


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest center (the first of equally near ones) and the squared distance to it."""
    d2 = ((x[:, None, :] - centers[None]) ** 2).sum(2)
    own = d2.argmin(1)
    return own, d2[np.arange(len(x)), own]


def seeds(df: DataFrame, id_col: str, ks, seed: int = 42, features: str = "x", rounds: int = SEED_ROUNDS) -> dict[int, list]:
    """Initial centers for each k, by oversampled parallel seeding (Bahmani et
    al., Scalable K-Means++, VLDB 2012). Each round every row is taken with a
    chance of 2 k times its share of the squared distances to what was taken so
    far, by a seeded hash of its id; the few candidates, weighted by the rows
    nearest to them, are thinned out by k-means++. One run serves all k: the
    first k of a sequence of k-means++ are a seeding of their own."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(features).cast("array<double>").alias("_x")).where(F.col("_x").isNotNull())
    first = rows.withColumn("_h", hash_u60(seed, "_id")).orderBy("_h", "_id").limit(1).select("_x").collect()
    if not first:
        return {}
    taken = np.array([first[0]["_x"]], float)
    most = max(ks)

    def with_distance(centers):
        def run(batches):
            for pdf in batches:
                for a in range(0, len(pdf), 1024):
                    part = pdf.iloc[a:a + 1024]
                    own, d2 = _nearest(np.stack(part["_x"].to_numpy()), centers)
                    yield part.assign(_own=own.astype("int32"), _d2=d2)
        return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("_own", T.IntegerType()), T.StructField("_d2", T.DoubleType())]))

    for r in range(rounds):
        at = with_distance(taken)
        cost = at.agg(F.sum("_d2")).first()[0]
        if not cost:
            break
        chance = F.least(F.lit(1.0), F.col("_d2") * F.lit(2.0 * most / cost))
        new = collect_small(at.where(hash_unit(seed + 1 + r, "_id") < chance).select("_id", "_x"), "candidates")
        taken = np.vstack([taken, *[np.array([x["_x"]], float) for x in sorted(new, key=lambda x: x["_id"])]])
    weight = np.zeros(len(taken))
    for r in collect_small(with_distance(taken).groupBy("_own").count(), "weights"):
        weight[r["_own"]] = r["count"]
    rng = np.random.default_rng(seed)
    picked = [int(weight.argmax())]
    for _ in range(1, min(most, len(taken))):
        share = _nearest(taken, taken[picked])[1] * weight
        if not share.any():
            break
        picked.append(int(rng.choice(len(taken), p=share / share.sum())))
    return {k: taken[picked[:k]].tolist() for k in ks if k <= len(picked)}


def lloyd_sweep(df: DataFrame, id_col: str, starts: dict[int, list], most_rounds: int = MOST_ROUNDS, features: str = "x") -> DataFrame:
    """(k, rounds, inertia, silhouette) after Lloyd's updates from the given
    centers of each k, until no row moves (or ``most_rounds``); silhouettes are
    Euclidean and exact. One pass over the rows serves all k that still move: each
    task sums its rows by (k, cluster), and tells how many the last update moved by
    looking at the centers before it too, so that nothing is kept per row. A
    cluster that loses all its rows keeps its center. Null vectors take no part."""
    ks = sorted(starts)
    if not ks:
        return local_frame(df.sparkSession, [], "k int, rounds int, inertia double, silhouette double")
    centers = {k: np.array(starts[k], float) for k in ks}
    rows = df.select(F.col(id_col).alias("_id"), F.col(features).cast("array<double>").alias("_x")).where(F.col("_x").isNotNull())
    nearest = lambda x, k, at: _nearest(x, at[k])

    def summed(open_: list[int], before: dict) -> dict:
        at = {k: centers[k] for k in open_}

        def run(batches):
            total: dict = {}
            for pdf in batches:
                for a in range(0, len(pdf), 2048):
                    x = np.stack(pdf["_x"].iloc[a:a + 2048].to_numpy())
                    for k in open_:
                        own, d2 = nearest(x, k, at)
                        moved = own != nearest(x, k, before)[0] if k in before else np.ones(len(x), bool)
                        one = np.eye(len(at[k]))[own]
                        new = (one.sum(0), one.T @ d2, one.T @ moved, one.T @ x)
                        total[k] = tuple(p + q for p, q in zip(total[k], new)) if k in total else new
            out = [(k, c, int(n[c]), float(sse[c]), int(m[c]), s[c].tolist()) for k, (n, sse, m, s) in total.items() for c in range(len(n)) if n[c]]
            if out:
                yield pd.DataFrame(out, columns=["k", "c", "n", "sse", "moved", "s"])

        parts = rows.select("_x").mapInPandas(run, "k int, c int, n long, sse double, moved long, s array<double>")
        each = parts.select("k", "c", "n", "sse", "moved", F.posexplode("s").alias("i", "v"))
        cells = each.groupBy("k", "c", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("moved").alias("moved"))
        out: dict = {}
        for r in sorted(collect_small(cells, "cluster sums")):
            out.setdefault((r["k"], r["c"]), (r["n"], r["sse"], r["moved"], []))[3].append(r["v"])
        return out

    inertias, rounds, before, open_ = dict.fromkeys(ks, 0.0), dict.fromkeys(ks, 0), {}, list(ks)
    for _ in range(most_rounds + 1):
        sums = summed(open_, before)
        before = {}
        for k in list(open_):
            own = {c: v for (kk, c), v in sums.items() if kk == k}
            inertias[k] = sum(v[1] for _, v in sorted(own.items()))
            if not any(v[2] for v in own.values()) or rounds[k] == most_rounds:
                open_.remove(k)
                continue
            before[k], rounds[k] = centers[k], rounds[k] + 1
            centers[k] = centers[k].copy()
            for c, (n, _, _, s) in own.items():
                centers[k][c] = np.array(s) / n
        if not open_:
            break

    def label(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["_x"].to_numpy())
                yield pdf.assign(**{f"_c{k}": nearest(x, k, centers)[0].astype("int32") for k in ks})

    names = [f"_c{k}" for k in ks]
    assigned = rows.mapInPandas(label, T.StructType([*rows.schema.fields, *[T.StructField(c, T.IntegerType()) for c in names]]))
    sil = silhouettes_euclid(assigned, "_id", names, "_x")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("clustering") + 1)
    return sil.select(pick(ks).alias("k"), pick([rounds[k] for k in ks]).alias("rounds"), pick([inertias[k] for k in ks]).alias("inertia"), "silhouette")


def silhouette_euclid(df: DataFrame, id_col: str, features: str = "x", cluster: str = "cluster",
                      tile_rows: int = TILE_ROWS) -> DataFrame:
    """Mean silhouette with Euclidean distance, exact (blocked pair sums)."""
    return silhouettes_euclid(df, id_col, [cluster], features, tile_rows).select("silhouette")


def silhouettes_euclid(df: DataFrame, id_col: str, clusters: list[str], features: str = "x",
                       tile_rows: int = TILE_ROWS) -> DataFrame:
    """(clustering, silhouette) for several cluster columns at once: each pair
    of tiles of rows is one group, in one order only, whose distances serve
    both sides and all clusterings. A group holds two tiles at the most, and the
    distances of a strip of one to the other."""
    n = df.count()
    t = max(_tiles(n, tile_rows), min(LEAST_TILES, _tiles(n, STRIP_ROWS)))
    base = df.select(F.xxhash64(id_col).alias("_id"), F.col(features).cast("array<double>").alias("_x"),
                     F.array(*[F.col(c).cast("int") for c in clusters]).alias("_c"), F.pmod(F.xxhash64(id_col), F.lit(t)).cast("int").alias("_t"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(t - 1)),
                        lambda k: F.struct(F.least("_t", k).alias("i"), F.greatest("_t", k).alias("j")))
    rows = base.withColumn("_w", F.explode(pairs)).select("_id", "_x", "_c", "_t", "_w.i", "_w.j")
    schema = "_id long, clustering int, own int, other int, s double, n long"

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["i"].iat[0], pdf["j"].iat[0]
        tile = pdf["_t"].to_numpy()
        x, ids, cs = np.stack(pdf["_x"].to_numpy()), pdf["_id"].to_numpy(), np.stack(pdf["_c"].to_numpy())
        left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("_id", "clustering", "own", "other", "s", "n")})
        # a column for each cluster of each clustering
        seen = [[np.unique(cs[side, k], return_inverse=True) for k in range(cs.shape[1])] for side in (left, right)]
        one_left, one_right = (np.concatenate([np.eye(len(c))[at] for c, at in side], axis=1) for side in seen)
        A, B, square = x[left], x[right], (x * x).sum(1)
        sums = np.zeros((len(left), one_right.shape[1]))
        counts = np.tile(one_right.sum(0), (len(left), 1))
        back = np.zeros((len(right), one_left.shape[1]))
        for at in range(0, len(left), STRIP_ROWS):
            own = slice(at, at + STRIP_ROWS)
            D = A[own] @ B.T
            D *= -2.0
            D += square[left[own], None]
            D += square[None, right]
            np.sqrt(np.maximum(D, 0.0, out=D), out=D)
            if a == b:  # equal ids are in one tile
                same = ids[left[own], None] == ids[None, right]
                D[same] = 0.0
                i, j = np.nonzero(same)
                np.subtract.at(counts, i + at, one_right[j])
            else:
                back += D.T @ one_left[own]
            sums[own] = D @ one_right
        out = []
        sides = [(left, seen[1], sums, counts)] + ([(right, seen[0], back, np.tile(one_left.sum(0), (len(right), 1)))] if a != b else [])
        for rows, kinds, total, number in sides:
            first = 0
            for k, (names, _) in enumerate(kinds):
                last = first + len(names)
                out.append(pd.DataFrame({"_id": np.repeat(ids[rows], len(names)), "clustering": k, "own": np.repeat(cs[rows, k], len(names)),
                                         "other": np.tile(names, len(rows)), "s": total[:, first:last].ravel(), "n": number[:, first:last].ravel().astype("int64")}))
                first = last
        return pd.concat(out, ignore_index=True)

    sums = (rows.groupBy("i", "j").applyInPandas(block, schema)
            .groupBy("clustering", "_id", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    mean = F.col("s") / F.when(F.col("n") > 0, F.col("n"))
    is_own = F.col("own") == F.col("other")
    each = sums.groupBy("clustering", "_id").agg(F.max(F.when(is_own, mean)).alias("a"), F.min(F.when(~is_own, mean)).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.groupBy("clustering").agg(F.avg(s).alias("silhouette"))


def silhouette_sampled(df: DataFrame, id_col: str, features: str = "x", cluster: str = "cluster", per_cluster: int = SAMPLED_ROWS,
                       seed: int = 42) -> DataFrame:
    """(silhouette, low, high): the Euclidean silhouette estimated from the
    ``per_cluster`` rows of each cluster with the lowest seeded hash, and its 95 %
    interval. Each sampled row's distances are taken to all rows, in one pass that
    leaves a sum for each sampled row, cluster and task, so the work grows with
    the rows and not with their square; clusters weigh as many rows as they have. A cluster
    that is sampled whole adds nothing to the interval."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(features).cast("array<double>").alias("_x"), F.col(cluster).cast("int").alias("_c"))
    sizes = {r["_c"]: r["count"] for r in collect_small(rows.groupBy("_c").count(), "cluster sizes")}
    w = Window.partitionBy("_c").orderBy(hash_u60(seed, "_id"), "_id")
    picked = sorted(collect_small(rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_cluster).select("_id", "_c", "_x"), "sampled rows"))
    if not picked:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("silhouette", "low", "high")])
    clusters = sorted(sizes)
    x = np.array([r["_x"] for r in picked], float)
    own = np.array([clusters.index(r["_c"]) for r in picked])

    def run(batches):
        total = np.zeros((len(x), len(clusters)))
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a:a + 512]
                y = np.stack(part["_x"].to_numpy())
                one = np.eye(len(clusters))[np.searchsorted(clusters, part["_c"].to_numpy())]
                for b in range(0, len(x), 256):
                    # differences, not products: a row is at distance 0 from itself
                    total[b:b + 256] += np.sqrt(((x[b:b + 256, None, :] - y[None]) ** 2).sum(2)) @ one
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    sums = np.zeros((len(x), len(clusters)))
    for r in collect_small(rows.mapInPandas(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")), "distance sums"):
        sums[r["i"], r["j"]] = r["s"]
    n = np.array([sizes[c] for c in clusters], float)
    s = np.zeros(len(x))
    for i, c in enumerate(own):
        others = [sums[i, j] / n[j] for j in range(len(n)) if j != c]
        if n[c] > 1 and others:
            a, b = sums[i, c] / (n[c] - 1), min(others)
            s[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    mean, var = 0.0, 0.0
    for c in range(len(n)):
        mine, share = s[own == c], n[c] / n.sum()
        mean += share * mine.mean()
        if len(mine) > 1:
            var += share**2 * mine.var(ddof=1) / len(mine) * (1 - len(mine) / n[c])
    half = 1.96 * float(np.sqrt(var))
    return df.sparkSession.range(1).select(*[F.lit(float(v)).alias(c) for c, v in (("silhouette", mean), ("low", mean - half), ("high", mean + half))])
