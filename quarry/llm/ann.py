"""Approximate nearest neighbours on shifted space-filling curves.

Each of several curves projects the vectors on a few random directions, shifts
the grid by a random amount and sorts all vectors along the Hilbert curve
through it. What is near in space is near on most curves, so a query compares
itself with the vectors in a window around it on every curve, and the best of
all windows are merged. How wide the windows must be depends on the data: it is
read off a sample of vectors whose true neighbours are searched in full, so that
the wanted recall is met, on clustered and on structureless data alike.

Vectors that occur several times are indexed once, with their smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.operators.ordering import with_global_index
from quarry.operators.small import collect_small, local_frame

# Parameters. SAMPLE vectors (at most) tell the width of the windows; RECALL is
# aimed at above the 0.9 that is asked for, as a sample has an error.
CURVES, DIRECTIONS, GRID_BITS, SEED = 32, 8, 10, 9
NEIGHBOURS, SAMPLE, RECALL = 5, 256, 0.95
BLOCK, MOST_VISITS = 1024, 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid cells, as big-endian
    bytes (the transposed form of Skilling, AIP Conf. Proc. 707, 2004)."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in x:
            high = (axis >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(high, low, swap)
            axis ^= swap if axis is not x[0] else 0
    for a, b in zip(x[1:], x[:-1]):
        a ^= b
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1
    return np.packbits(planes.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)


def _curve(c: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions (orthonormal) and shifts of curve ``c``."""
    rng = np.random.default_rng([SEED, c, width])
    m = min(DIRECTIONS, width)
    return np.linalg.qr(rng.normal(size=(width, m)))[0], rng.uniform(0, 0.2, m)


def curve_keys(unit: np.ndarray, c: int, scale: float) -> list[bytes]:
    """Keys of unit vectors on curve ``c``; ``scale`` is the greatest projection
    that the grid tells apart."""
    directions, shift = _curve(c, unit.shape[1])
    at = (unit @ directions / scale + 1) / 2 * 0.8 + shift
    cells = np.clip(at * (1 << GRID_BITS), 0, (1 << GRID_BITS) - 1)
    return [k.tobytes() for k in hilbert_keys(cells, GRID_BITS)]


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 1))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; equal rows of
    any two calls give equal results, unlike those of a matrix product."""
    dot = lambda x, y: np.add.reduce(x * y, axis=1)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def _best(query_vids, queries, vids, ids, vectors, allowed, k: int):
    """(query, vector, its smallest id, cosine) of the ``k`` nearest allowed
    candidates of each query. A fast product finds somewhat more, whose cosines
    are then worked out alike."""
    unit = lambda x: x / np.sqrt(np.add.reduce(x * x, axis=1))[:, None]
    near = unit(queries) @ unit(vectors).T
    near[~allowed] = -np.inf
    out = []
    for i in range(len(queries)):
        row = near[i]
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            some = np.flatnonzero(row >= least - 1e-9)
        else:
            some = np.arange(len(row))
        some = some[np.isfinite(row[some])]
        exact = _cosine(np.repeat(queries[i:i + 1], len(some), axis=0), vectors[some])
        order = np.lexsort((vids[some], ids[some], -exact))[:k]
        out.append((np.full(len(order), query_vids[i]), vids[some][order], ids[some][order], exact[order]))
    kinds = (np.int64, np.int64, np.int64, np.float64)
    return [np.concatenate(x).astype(t) for x, t in zip(zip(*out), kinds)] if out else [np.zeros(0, t) for t in kinds]


_FOUND = "q long, vid long, id long, score double"


def _found(columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "vid", "id", "score"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query over all windows."""
    one = found.groupBy("q", "vid", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id", "vid"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k)


def _by_width(batch: pa.RecordBatch, col: int):
    """(width, row numbers, matrix) for each length of the vectors of a batch."""
    column = batch.column(col)
    widths = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(widths)])
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        for a in range(0, len(rows), 4096):
            some = rows[a:a + 4096]
            yield w, some, flat[starts[some][:, None] + np.arange(w)].astype(np.float64)


def _full_search(vectors: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Nearest neighbours of a bounded sample (vids and vectors, by length)
    among all rows of the same length."""
    def run(batches):
        for batch in batches:
            vids, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w, some, x in _by_width(batch, 2):
                if w in sample:
                    q, qx = sample[w]
                    yield _found(_best(q, qx, vids[some], ids[some], x, vids[some][None] != q[:, None], k))

    return _merged(vectors.select("vid", "id", "x").mapInArrow(run, _FOUND), k)


def _usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.col("x")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return (rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
            .where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(good, F.lit(False))))


def _of_width(values: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col("width"))


class CurveIndex:
    """The distinct vectors, sorted along every curve. Each length of vectors has
    curves, a scale and a window of its own."""

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", neighbours: int = NEIGHBOURS,
                 curves: int = CURVES, recall: float = RECALL, sample: int = SAMPLE) -> None:
        self.k, self.curves = neighbours + 1, curves  # one more, as a query finds itself
        self.rows = _usable(rows, id_col, vec_col)
        # of equal vectors the smallest ids: more can't be among the nearest
        few = F.row_number().over(Window.partitionBy("x").orderBy("id"))
        groups = (self.rows.distinct().withColumn("nth", few).where(F.col("nth") <= self.k)
                  .groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")))
        # an id may have several vectors, so vectors have numbers: as written, not as run
        self.vectors = written(groups.select(F.monotonically_increasing_id().alias("vid"), F.size("x").alias("width"), F.col("ids")[0].alias("id"),
                                             "ids", "x"), "vectors")
        self.sizes = dict(sorted(map(tuple, collect_small(self.vectors.groupBy("width").count(), "lengths of vectors"))))
        self.windows: dict[int, int] = {}
        if not self.sizes:
            return
        scales = self._scales()

        def keyed(batches):
            for batch in batches:
                vids = batch.column(0).to_numpy()
                for w, some, x in _by_width(batch, 1):
                    unit = x / np.sqrt(np.add.reduce(x * x, axis=1))[:, None]
                    for c in range(curves):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), w, np.int32)), pa.array(np.full(len(some), c, np.int32)),
                             pa.array(curve_keys(unit, c, scales[w]), pa.binary()), pa.array(vids[some])], names=["width", "curve", "key", "vid"])

        keys = self.vectors.select("vid", "x").mapInArrow(keyed, "width int, curve int, key binary, vid long")
        indexed = with_global_index(keys, ["width", "curve", "key", "vid"], "at")
        # every curve has all the vectors of its length, so places on it follow from the overall ones
        before = dict(zip(self.sizes, np.cumsum([0, *(n * curves for n in self.sizes.values())]).tolist()))
        self.places = indexed.select("width", "curve", "vid", (F.col("at") - _of_width(before) - F.col("curve") * _of_width(self.sizes)).alias("at"))
        self._set_windows(recall, sample)

    def _scales(self) -> dict[int, float]:
        """Four standard deviations of a projection, over all vectors of a length."""
        def squares(batches):
            for batch in batches:
                for w, _, x in _by_width(batch, 0):
                    unit = x / np.sqrt(np.add.reduce(x * x, axis=1))[:, None]
                    p = unit @ _curve(0, w)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([float((p * p).sum())]), pa.array([p.size])],
                                                     names=["width", "s", "n"])

        parts = self.vectors.select("x").mapInArrow(squares, "width int, s double, n long")
        total = collect_small(parts.groupBy("width").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "scales")
        return {w: max(1e-9, 4 * float(np.sqrt(s / n))) for w, s, n in total}

    def _set_windows(self, recall: float, sample: int) -> None:
        """Of each length, the window that holds the wanted share of the true
        neighbours of some vectors on one curve at least."""
        step = {w: max(1, n // sample) for w, n in self.sizes.items()}
        by_hash = F.xxhash64("vid")
        picked: dict[int, list] = {}
        for r in self.vectors.where(F.pmod(by_hash, _of_width(step)) == 0).select("width", by_hash.alias("h"), "vid", "x").orderBy("h", "vid").collect():
            if len(own := picked.setdefault(r["width"], [])) < sample:  # about as many as asked for come
                own.append((r["vid"], r["x"]))
        queries = {w: (np.array([v for v, _ in own], np.int64), np.array([x for _, x in own], np.float64)) for w, own in picked.items()}
        true = _full_search(self.vectors, queries, self.k - 1).select("q", "vid").collect()
        wanted = local_frame(self.vectors.sparkSession, sorted({(i,) for r in true for i in (r["q"], r["vid"])}), "vid long")
        places: dict[int, dict[int, int]] = {}
        for r in self.places.join(F.broadcast(wanted), "vid").collect():  # a few thousand at most, on each curve
            places.setdefault(r["vid"], {})[r["curve"]] = r["at"]
        width = {v: w for w, (vids, _) in queries.items() for v in vids.tolist()}
        apart: dict[int, list[int]] = {w: [0] for w in self.sizes}
        for r in true:
            apart[width[r["q"]]].append(min(abs(places[r["q"]][c] - places[r["vid"]][c]) for c in range(self.curves)))
        self.windows = {w: int(np.quantile(x, recall, method="higher")) + 1 for w, x in apart.items()}

    def search(self, queries: DataFrame) -> DataFrame:
        """(q, vid, id, score, rank): for each number in ``queries`` (column vid)
        its nearest distinct vectors, itself among them. A task's group is a block
        of BLOCK places and MOST_VISITS queries, about, that look into it; wider
        windows make a query look into more blocks."""
        k = self.k
        asked = queries.select("vid").distinct().withColumn("asks", F.lit(True))
        n_asked = asked.count()
        here = self.places.join(self.vectors.select("vid", "id", "x"), "vid").join(asked, "vid", "left")
        # the queries that look into one block are dealt over parts, each with the rows of the block
        share = {w: min(n, n_asked) / n for w, n in self.sizes.items()}
        parts = {w: max(1, round((2 * self.windows[w] + BLOCK) * share[w] / MOST_VISITS)) for w in self.sizes}
        here = here.withColumns({"window": _of_width(self.windows), "parts": _of_width(parts), "most": _of_width(self.sizes) - 1})
        rows = here.select("width", "curve", F.floor(F.col("at") / BLOCK).alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                           "at", "vid", "id", "x", F.lit(False).alias("asks"))
        reach = F.sequence(F.floor(F.greatest(F.col("at") - F.col("window"), F.lit(0)) / BLOCK),
                           F.floor(F.least(F.col("at") + F.col("window"), F.col("most")) / BLOCK))
        visits = here.where("asks").select("width", "curve", F.explode(reach).alias("block"), F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"),
                                           "at", "vid", "id", "x", "asks")
        windows = self.windows

        def run(group: pa.Table) -> pa.Table:
            asks, window = group["asks"].to_numpy(), windows[group["width"][0].as_py()]
            at, vids, ids = (group[c].to_numpy() for c in ("at", "vid", "id"))
            x = _matrix(group["x"].combine_chunks())
            found = []
            for a in range(0, int(asks.sum()), 256):
                q = np.flatnonzero(asks)[a:a + 256]
                allowed = np.abs(at[~asks][None] - at[q][:, None]) <= window
                found.append(_found(_best(vids[q], x[q], vids[~asks], ids[~asks], x[~asks], allowed, k)))
            return pa.Table.from_batches(found or [_found(_best([], x[:0], vids, ids, x, np.zeros((0, len(x)), bool), k))])

        found = rows.unionByName(visits).groupBy("width", "curve", "block", "part").applyInArrow(run, _FOUND)
        return _merged(found, k)

    def nearest(self, query_ids) -> DataFrame:
        """(query_id, rank, vec_id, score) for the rows whose id meets the
        condition ``query_ids`` (a Column over ``id``)."""
        none = "query_id long, rank int, vec_id long, score double"
        if not self.sizes:
            return local_frame(self.vectors.sparkSession, [], none)
        groups = self.vectors.select(F.col("vid").alias("rep"), "ids", F.col("x").alias("y"))
        asked = self.rows.where(query_ids).distinct().join(groups.select("rep", "y"), F.col("x") == F.col("y")).select("id", "rep")
        asked = written(asked, "queries")
        found = self.search(asked.select(F.col("rep").alias("vid")))
        hits = (found.select("q", F.col("vid").alias("hit"), "score").join(groups.select("rep", "ids"), F.col("hit") == F.col("rep"))
                .select("q", "score", F.explode("ids").alias("vec_id")))
        pairs = asked.join(hits, F.col("rep") == F.col("q")).where(F.col("vec_id") != F.col("id"))
        order = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "vec_id"))
        return (pairs.withColumn("rank", order).where(F.col("rank") < self.k)
                .select(F.col("id").alias("query_id"), "rank", "vec_id", "score"))


def curve_neighbours(rows: DataFrame, query_ids, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """The nearest vectors by cosine of every row whose id meets ``query_ids``.

    (query_id, rank, vec_id, score): candidates are all rows but the query's own
    whose vector is as long as the query's, nearest first, ties to the smaller
    id; all of them if there are fewer than asked. Null ids, and vectors that are
    null, empty, all zero or hold a null, NaN or infinite component, take no
    part. Rows repeated exactly count once; an id with several vectors has each
    of them, and its queries are merged under the one id. Very long vectors are
    held whole, 1,024 at a time. No usable rows: no rows.
    """
    return CurveIndex(rows, id_col, vec_col, **options).nearest(query_ids)
