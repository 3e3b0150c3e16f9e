"""Tree ensembles grown level by level, all trees in one pass over the rows.

Features are cut into bins at quantiles and the binned rows written once. For
each level every task sums its rows by (node, feature, bin), for the open nodes
of all trees together; Spark adds the sums up and finds the best split of each
node where its sums meet, and only the splits come to the driver. A pass costs as
much for a hundred trees as its sums do, and nobody holds the rows.

* Where a level of a forest has more open nodes than the driver should know of
  (``MOST_OPEN``), those with few rows are handed over: their rows are dealt to
  bounded groups, each of which grows its nodes to the end, and what they grew
  stays a table that votes are joined with. ``early`` hands over every node as soon
  as it has few rows: a row is then dealt once for each tree, where a level's sums
  of small nodes are about as many as the rows, so the work grows as the rows do.
* A forest bags by Poisson draws, kept with the row as weights, so that the rows
  that a tree has not seen are known and the out-of-bag votes are those of the
  very trees that predict.
* Boosting fits one tree per class and round to the softmax gradients; the
  margins are written with the rows every few rounds, so a pass looks at the
  trees since then only.
* Regression on few features needs the rows once: the bins make a bounded grid, each
  tree is grown to the end on what its draws add up to in the cells, and a row is
  predicted by its cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.hashing import hash_unit
from quarry.operators.sampling import poisson1_draw, poisson1_thresholds
from quarry.operators.small import collect_small
from quarry.session import drop_scratch, scratch_table

BINS = 32
PART_CELLS = 1 << 21    # sums that one group holds
_KEPT_CELLS = 1 << 21   # and a task, before it adds up what it has
MOST_OPEN = 1 << 15     # nodes of a level that come to the driver, before small ones are handed over
GROUP_ROWS = 1 << 14    # rows of a node that may be handed over, and of the nodes grown in one group
EARLY_ROWS = 1 << 19    # of all trees together: with more, nodes are handed over early unless said otherwise
GROUP_CELLS = 1 << 18   # and these times the features of a split, where they are handed over early
GRID_CELLS = 1 << 15    # that the bins of all features may make, where regression trees are grown on cells
_SALTS = 8              # tasks that may share the rows of a cell
_KEPT_ROWS = 1 << 12    # cells that a task keeps sums of
_ACCURACY = 10_000      # of the quantiles
ROUNDS_KEPT = 5         # of boosting, before the margins are written


def cut_points(df: DataFrame, features: str = "x", bins: int = BINS) -> list[np.ndarray]:
    """Where the bins of each feature end: its quantiles, by Spark's mergeable sketch."""
    width = df.agg(F.max(F.size(features))).first()[0] or 0
    probs = [i / bins for i in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.get(features, i), probs, _ACCURACY) for i in range(width)]).first() if width else ()
    return [np.unique(np.array(q or [], float)) for q in found]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A row goes left of a cut if its value isn't greater."""
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def _bytes(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)


class Trees:
    """Nodes of several trees in flat arrays. The children of a node stand side by side."""

    def __init__(self, n_trees: int, width: int) -> None:
        self.roots = np.arange(n_trees)
        self.feature, self.cut, self.left = np.full(n_trees, -1), np.zeros(n_trees, np.int64), np.zeros(n_trees, np.int64)
        self.tree = np.arange(n_trees)
        self.value = np.zeros((n_trees, width))

    def leaves(self, bins: np.ndarray, tree: int) -> np.ndarray:
        """The node that each row is in."""
        at = np.full(len(bins), self.roots[tree])
        open_ = np.flatnonzero(self.feature[at] >= 0)
        while len(open_):
            node = at[open_]
            at[open_] = self.left[node] + (bins[open_, self.feature[node]] > self.cut[node])
            open_ = open_[self.feature[at[open_]] >= 0]
        return at

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Give the nodes two children each with these sums; returns the children."""
        if not len(nodes):
            return np.zeros(0, np.int64)
        begin = len(self.feature)
        self.feature[nodes], self.cut[nodes], self.left[nodes] = feature, cut, begin + 2 * np.arange(len(nodes))
        m = 2 * len(nodes)
        self.feature = np.concatenate([self.feature, np.full(m, -1)])
        self.cut, self.left = (np.concatenate([x, np.zeros(m, np.int64)]) for x in (self.cut, self.left))
        self.tree = np.concatenate([self.tree, np.repeat(self.tree[nodes], 2)])
        self.value = np.concatenate([self.value, np.stack([left, right], axis=1).reshape(m, -1)])
        return np.arange(begin, begin + m)


def _added(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and what their rows add up to."""
    k, s = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(k, kind="stable")
    k = k[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[begin], np.add.reduceat(s[order], begin, axis=0)


def _score(sums: np.ndarray, kind: str, penalty: float) -> np.ndarray:
    """How good it is to have the rows of these sums together (last axis)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "gini":
            return (sums * sums).sum(-1) / sums.sum(-1)
        return sums[..., 0] ** 2 / (sums[..., 1] + penalty)


def best_splits(table: DataFrame, cells, n_nodes: int, slots: int, bins: int, width: int, kind: str, penalty: float = 0.0,
                least: float = 1e-9) -> dict[str, np.ndarray]:
    """The best (slot, bin) of each node: ``cells(batch)`` yields, for the rows of
    a batch, keys ((node * slots + slot) * bins + bin) and ``width`` sums, the last
    of them the weight of the rows; for gini keys (... * width + class) and one
    sum, as most cells of a small node hold one class."""
    per = max(1, PART_CELLS // (slots * bins * width))  # nodes of a group
    wide, own = (1, slots * bins * width) if kind == "gini" else (width, slots * bins)  # sums of a key, keys of a node

    def summed(batches):
        keys, sums, size = [], [], 0
        for batch in batches:
            for k, s in cells(batch):
                if not len(k):
                    continue
                k, s = _added([k], [s])
                keys.append(k)
                sums.append(s)
                size += len(k)
                if size >= _KEPT_CELLS:
                    k, s = _added(keys, sums)
                    if len(k) >= _KEPT_CELLS // 2:
                        yield parts(k, s)
                        keys, sums, size = [], [], 0
                    else:
                        keys, sums, size = [k], [s], len(k)
        if size:
            yield parts(*_added(keys, sums))

    def parts(k, s):
        part = k // (per * own)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
        ends = [*begin[1:], len(k)]
        return pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), pa.array([k[a:z].tobytes() for a, z in zip(begin, ends)], pa.binary()),
                                           pa.array([s[a:z].tobytes() for a, z in zip(begin, ends)], pa.binary())], names=["part", "keys", "sums"])

    def split(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        k, s = _added([np.frombuffer(x, np.int64) for x in group["keys"].to_pylist()],
                      [np.frombuffer(x, np.float64).reshape(-1, wide) for x in group["sums"].to_pylist()])
        m = min(per, n_nodes - part * per)
        dense = np.zeros((m * own, wide))
        dense[k - part * per * own] = s
        dense = dense.reshape(m, slots, bins, width)
        left = dense.cumsum(axis=2)
        total = left[:, :1, -1:, :]
        right = total - left
        weight = (lambda x: x.sum(-1)) if kind == "gini" else (lambda x: x[..., -1])
        gain = _score(left, kind, penalty) + _score(right, kind, penalty) - _score(total, kind, penalty)
        gain = np.where((weight(left) > 0.5) & (weight(right) > 0.5), gain, -np.inf).reshape(m, -1)
        best = np.argmax(gain >= gain.max(axis=1, keepdims=True) - 1e-12 * np.abs(total).sum((-1, -2, -3))[:, None], axis=1)  # the first of equally good ones
        rows = np.arange(m)
        here = weight(total)[:, 0, 0] > 0
        flat = left.reshape(m, -1, width)[rows, best]
        good = gain[rows, best] > least
        return pa.Table.from_arrays(
            [pa.array((rows + part * per)[here].astype(np.int64)), pa.array((best // bins)[here].astype(np.int32)), pa.array((best % bins)[here].astype(np.int32)),
             pa.array(good[here]), pa.array(total[:, 0, 0][here].tolist(), pa.list_(pa.float64())), pa.array(flat[here].tolist(), pa.list_(pa.float64()))],
            names=["node", "slot", "cut", "good", "total", "left"])

    found = (table.mapInArrow(summed, "part int, keys binary, sums binary").groupBy("part")
             .applyInArrow(split, "node long, slot int, cut int, good boolean, total array<double>, left array<double>"))
    rows = sorted(map(tuple, collect_small(found, "splits of a level")))
    out = dict(zip(("node", "slot", "cut", "good"), (np.array([r[i] for r in rows], np.int64) for i in range(4))))
    out["total"], out["left"] = (np.array([r[i] for r in rows], float).reshape(len(rows), width) for i in (4, 5))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grow_rest(root: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray, names: np.ndarray, levels: np.ndarray, slots: int, bins: int, k: int,
              seed: int, least: float = 1e-9, kind: str = "gini") -> Trees:
    """Trees below some nodes, to the end: ``root`` tells each row's node, ``names``
    and ``levels`` the nodes' numbers in the forest and how deep they may still grow.
    Only cuts between values that a node has are looked at, so small nodes cost little.
    With ``kind`` newton ``y`` are numbers, and the two sums of a node are w y and w."""
    def added(where, rows, times, size):
        ys, ws = np.repeat(y[rows], times), np.repeat(w[rows], times)
        if kind == "gini":
            return np.bincount(where * k + ys, ws, size * k).reshape(-1, k)
        return np.stack([np.bincount(where, ws * ys, size), np.bincount(where, ws, size)], axis=1)

    weight = (lambda s: s.sum(-1)) if kind == "gini" else (lambda s: s[..., -1])
    trees, at = Trees(len(names), k), root.copy()
    trees.value[:] = added(root, np.arange(len(root)), 1, len(names))
    path, open_ = _mix(names.astype(np.uint64) ^ _mix(np.array([seed]))), trees.roots.copy()
    for step in range(int(levels.max(initial=0))):
        open_ = open_[levels[trees.tree[open_]] > step]
        if not len(open_):
            break
        number = np.full(len(trees.feature), -1)
        number[open_] = np.arange(len(open_))
        rows = np.flatnonzero(number[at] >= 0)
        own = number[at[rows]]
        subset = np.argsort(_mix(path[open_][:, None] + np.arange(b.shape[1], dtype=np.uint64)), axis=1, kind="stable")[:, :slots]
        key = ((own[:, None] * slots + np.arange(slots)) * bins + b[rows[:, None], subset[own]]).ravel()
        cell, where = np.unique(key, return_inverse=True)
        sums = added(where, rows, slots, len(cell))
        upto = np.cumsum(sums, axis=0)
        slot = cell // bins
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        left = upto - np.repeat((upto - sums)[begin], np.diff([*begin, len(cell)]), axis=0)
        node = slot // slots
        total = trees.value[open_[node]]
        right = total - left
        gain = _score(left, kind, 0.0) + _score(right, kind, 0.0) - _score(total, kind, 0.0)
        gain = np.where((weight(left) > 0.5) & (weight(right) > 0.5), gain, -np.inf)
        top = np.maximum.reduceat(gain, np.searchsorted(node, np.arange(len(open_))))
        near = np.flatnonzero(gain >= top[node] - 1e-12 * weight(total))
        best = near[np.unique(node[near], return_index=True)[1]]  # the first of equally good ones
        best = best[gain[best] > least]
        parents = open_[node[best]]
        new = trees.split(parents, subset[node[best], slot[best] % slots], cell[best] % bins, left[best], right[best])
        path = np.concatenate([path, _mix(np.repeat(path[parents], 2) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), len(parents)))])
        moved = rows[trees.feature[at[rows]] >= 0]
        n = at[moved]
        at[moved] = trees.left[n] + (b[moved, trees.feature[n]] > trees.cut[n])
        open_ = new[(trees.value[new] > 0).sum(axis=1) > 1 if kind == "gini" else weight(trees.value[new]) > 1.5]
    return trees


def binned_rows(df: DataFrame, cuts: list[np.ndarray], id_col: str, label_col: str, features: str, classes: list, extra: dict | None = None) -> DataFrame:
    """(id, y, bins, ...) written once: the number of the class, a byte for each feature."""
    number, names = {c: i for i, c in enumerate(classes)}, ["id", "y", "bins", *(extra or {})]
    rows = df.where(F.col(features).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"), F.col(features).cast("array<double>").alias("x"),
        *[c.alias(n) for n, c in (extra or {}).items()])

    def run(batches):
        for batch in batches:
            bins = _binned(_matrix(batch.column(2), len(cuts)), cuts)
            y = [number[v] for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.int32()), pa.array([b.tobytes() for b in bins], pa.binary()),
                                              *[batch.column(i) for i in range(3, batch.num_columns)]], names=names)

    schema = T.StructType([rows.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("bins", T.BinaryType()), *rows.schema.fields[3:]])
    return scratch_table(rows.mapInArrow(run, schema), "tree-rows")


def _classes(df: DataFrame, label_col: str) -> list:
    return sorted(r[0] for r in collect_small(df.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("double")).distinct(), "classes"))


class Ensemble:
    """What predicts: bins, classes and trees. ``scores`` of the rows' bins are
    (rows, classes); the first of the largest wins."""

    def __init__(self, cuts: list[np.ndarray], classes: list, trees: Trees) -> None:
        self.cuts, self.classes, self.trees = cuts, classes, trees

    def __getstate__(self):  # what goes to the tasks
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, DataFrame)}

    def scores(self, bins: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def predict(self, df: DataFrame, id_col: str, label_col: str = "label", features: str = "x") -> DataFrame:
        """(id, label, pred); no prediction without a vector or without a class."""
        rows = df.where(F.col(features).isNotNull()).select(F.col(id_col), F.col(label_col), F.col(features).cast("array<double>").alias("_x"))
        classes = np.array(self.classes)

        def run(batches):
            for batch in batches:
                pred = classes[self.scores(_binned(_matrix(batch.column(2), len(self.cuts)), self.cuts)).argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred.astype(np.int32))], names=[id_col, label_col, "pred"])

        schema = T.StructType([*rows.schema.fields[:2], T.StructField("pred", T.IntegerType())])
        return rows.where(F.lit(bool(self.classes))).mapInArrow(run, schema)


class Forest(Ensemble):
    """Bagged trees; each votes with the shares of the classes in its leaf, or,
    with ``hard`` votes, for the most frequent."""

    hard = False
    rows: DataFrame  # the binned training rows, with their draws
    deep: DataFrame  # what was grown below the nodes that were handed over
    part = np.zeros(0, np.int64)  # of each node the group that it was handed to, or -1; empty if none was

    def hand_over(self, nodes: np.ndarray, levels: np.ndarray, slots: int, bins: int, seed: int, most: int) -> None:
        """Grow these nodes to the end, some of them in each group of ``most`` rows."""
        trees, k = self.trees, len(self.classes)
        weight = trees.value[nodes].sum(axis=1)
        part, filled, left = np.zeros(len(nodes), np.int64), 0, most
        for i, v in enumerate(weight.tolist()):
            if v > left and left < most:
                filled, left = filled + 1, most
            part[i], left = filled, left - v
        self.part = np.full(len(trees.feature), -1)
        self.part[nodes] = part
        deeper = np.zeros(len(trees.feature), np.int64)
        deeper[nodes] = levels

        def dealt(batches):
            for batch in batches:
                b, w = _bytes(batch.column(1)), _bytes(batch.column(2))
                for t in range(len(trees.roots)):
                    seen = np.flatnonzero(w[:, t])
                    node = trees.leaves(b[seen], t)
                    seen, node = seen[self.part[node] >= 0], node[self.part[node] >= 0]
                    if len(seen):
                        yield pa.RecordBatch.from_arrays([pa.array(self.part[node].astype(np.int32)), pa.array(node), batch.column(0).take(pa.array(seen)),
                                                          pa.array(w[seen, t].astype(np.int32)), batch.column(1).take(pa.array(seen))], names=["part", "node", "y", "w", "bins"])

        def grown(group: pa.Table) -> pa.Table:
            node, (y, w) = group["node"].to_numpy(), (group[c].to_numpy().astype(np.int64) for c in ("y", "w"))
            names, root = np.unique(node, return_inverse=True)
            own = grow_rest(root, y, w.astype(float), _bytes(group["bins"]), names, deeper[names], slots, bins, k, seed)
            return pa.Table.from_arrays([pa.array([group["part"][0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                names, own.feature.astype(np.int64), own.cut, own.left, own.value))], names=["part", "names", "feature", "cut", "left", "value"])

        rows = self.rows.select("y", "bins", "draws").mapInArrow(dealt, "part int, node long, y int, w int, bins binary")
        self.deep = scratch_table(rows.groupBy("part").applyInArrow(
            grown, "part int, names binary, feature binary, cut binary, left binary, value binary"), "forest-rest")

    def _shares(self, value: np.ndarray) -> np.ndarray:
        return np.eye(len(self.classes))[value.argmax(axis=1)] if self.hard else value / np.maximum(value.sum(axis=1, keepdims=True), 1e-300)

    def _winners(self, rows: DataFrame) -> DataFrame:
        """(rid, cls): the class with the most votes, see :meth:`_tally`."""
        return self._tally(rows).groupBy("rid").agg(F.max_by("cls", F.struct("v", -F.col("cls"))).alias("cls"))

    def _shares_of(self, rows: DataFrame) -> DataFrame:
        """(rid, shares): what part of its votes each class has, see :meth:`_tally`."""
        votes = self._tally(rows).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("cls", "v"))).alias("m"), F.sum("v").alias("all"))
        own = [F.coalesce(F.element_at("m", F.lit(c)), F.lit(0.0)) / F.col("all") for c in range(len(self.classes))]
        return votes.select("rid", F.array(*own).alias("shares"))

    def _tally(self, rows: DataFrame) -> DataFrame:
        """(rid, cls, v): what the trees vote for each of ``rows`` (rid, bins, draws: null
        for the votes of all trees, else of those that drew 0), joined with what
        was grown in the groups."""
        k, part = len(self.classes), self.part if len(self.part) else np.full(len(self.trees.feature), -1)

        def leaves(batch):
            b = _bytes(batch.column(1))
            draws = _bytes(batch.column(2)) if batch.column(2).null_count == 0 else None
            for t in range(len(self.trees.roots)):
                seen = np.arange(len(b)) if draws is None else np.flatnonzero(draws[:, t] == 0)
                yield seen, self.trees.leaves(b[seen], t)

        def long_form(rid, votes):
            i, c = np.nonzero(votes)
            return [pa.array(rid[i]), pa.array(c.astype(np.int32)), pa.array(votes[i, c])]

        def shallow(batches):
            for batch in batches:
                votes = np.zeros((batch.num_rows, k))
                for seen, node in leaves(batch):
                    here = part[node] < 0
                    votes[seen[here]] += self._shares(self.trees.value[node[here]])
                yield pa.RecordBatch.from_arrays(long_form(batch.column(0).to_numpy(), votes), names=["rid", "cls", "v"])

        def visits(batches):
            for batch in batches:
                for seen, node in leaves(batch):
                    there = part[node] >= 0
                    seen, node = pa.array(seen[there]), node[there]
                    yield pa.RecordBatch.from_arrays([pa.array(part[node].astype(np.int32)), pa.array(node), batch.column(0).take(seen),
                                                      batch.column(1).take(seen)], names=["part", "node", "rid", "bins"])

        def voted(key: tuple, go: pa.Table, rest: pa.Table) -> pa.Table:
            rid, votes = np.zeros(0, np.int64), np.zeros((0, k))
            if go.num_rows and rest.num_rows:
                names, feature, cut, left = (np.frombuffer(rest[c][0].as_py(), np.int64) for c in ("names", "feature", "cut", "left"))
                value, b = np.frombuffer(rest["value"][0].as_py(), np.float64).reshape(-1, k), _bytes(go["bins"])
                at = np.searchsorted(names, go["node"].to_numpy())
                open_ = np.flatnonzero(feature[at] >= 0)
                while len(open_):
                    n = at[open_]
                    at[open_] = left[n] + (b[open_, feature[n]] > cut[n])
                    open_ = open_[feature[at[open_]] >= 0]
                rid, row = np.unique(go["rid"].to_numpy(), return_inverse=True)
                votes = np.zeros((len(rid), k))
                np.add.at(votes, row, self._shares(value[at]))
            return pa.Table.from_arrays(long_form(rid, votes), names=["rid", "cls", "v"])

        rows, form = rows.select("rid", "bins", "draws"), "rid long, cls int, v double"
        each = rows.mapInArrow(shallow, form)
        if not len(self.part):
            return each.groupBy("rid", "cls").agg(F.round(F.sum("v"), 9).alias("v"))
        go = rows.mapInArrow(visits, "part int, node long, rid long, bins binary")
        tiles = scratch_table(go.groupBy("part").agg(F.ceil(F.count("*") / (4 * GROUP_ROWS)).cast("int").alias("tiles")), "forest-tiles")
        go = go.join(tiles, "part").withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int")).drop("tiles")
        rest = self.deep.join(tiles, "part").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
        each = each.unionByName(go.groupBy("part", "tile").cogroup(rest.groupBy("part", "tile")).applyInArrow(voted, form))
        return each.groupBy("rid", "cls").agg(F.round(F.sum("v"), 9).alias("v"))  # however the sums were added up

    def _asked(self, df: DataFrame, id_col: str, label_col: str, features: str) -> DataFrame:
        """(id, label, bins, rid) of the rows that have a vector, written once."""
        rows = df.where(F.col(features).isNotNull()).select(F.col(id_col), F.col(label_col), F.col(features).cast("array<double>").alias("_x"))

        def run(batches):
            for batch in batches:
                bins = _binned(_matrix(batch.column(2), len(self.cuts)), self.cuts)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bins], pa.binary())],
                                                 names=[id_col, label_col, "bins"])

        schema = T.StructType([*rows.schema.fields[:2], T.StructField("bins", T.BinaryType())])
        return scratch_table(rows.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "forest-asked")

    def class_shares(self, df: DataFrame, id_col: str, label_col: str = "label", features: str = "x", trees: list[int] | None = None) -> DataFrame:
        """(id, shares): the probabilities of the classes by all trees, or by some of them."""
        rows = self._asked(df, id_col, label_col, features)
        asked = None if trees is None else bytearray(int(t not in trees) for t in range(len(self.trees.roots)))
        return rows.join(self._shares_of(rows.withColumn("draws", F.lit(asked).cast("binary"))), "rid").select(id_col, "shares")

    def out_of_bag_shares(self) -> DataFrame:
        """(id, shares): of each training row that a tree hasn't seen, the probabilities by such trees."""
        rows = scratch_table(self.rows.withColumn("rid", F.monotonically_increasing_id()), "forest-bag")
        return rows.join(self._shares_of(rows), "rid").select("id", "shares")

    def predict(self, df: DataFrame, id_col: str, label_col: str = "label", features: str = "x") -> DataFrame:
        if not len(self.part):
            return super().predict(df, id_col, label_col, features)
        rows = self._asked(df, id_col, label_col, features)
        won = self._winners(rows.withColumn("draws", F.lit(None).cast("binary")))
        return rows.join(won, "rid").select(id_col, label_col, self._class("cls").alias("pred"))

    def _class(self, number: str) -> Column:
        return F.element_at(F.array(*[F.lit(int(c)) for c in self.classes]), F.col(number) + 1)

    def _votes(self, bins: np.ndarray, draws: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((len(bins), len(self.classes)))
        for t in range(len(self.trees.roots)):
            v = self.trees.value[self.trees.leaves(bins, t)]
            v = self._shares(v)
            out += v if draws is None else v * (draws[:, t] == 0)[:, None]
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self._votes(bins)

    def out_of_bag(self) -> DataFrame:
        """(id, y, pred): of each training row that a tree hasn't seen, the vote of such trees."""
        if len(self.part):
            rows = scratch_table(self.rows.withColumn("rid", F.monotonically_increasing_id()), "forest-bag")
            return rows.join(self._winners(rows), "rid").select("id", self._class("y").alias("y"), self._class("cls").alias("pred"))
        classes = np.array(self.classes)

        def run(batches):
            for batch in batches:
                draws = _bytes(batch.column(3))
                unseen = np.flatnonzero((draws == 0).any(axis=1))
                votes = self._votes(_bytes(batch.column(2)), draws)[unseen]
                y = batch.column(1).to_numpy()[unseen]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(unseen)), pa.array(classes[y].astype(np.int32)),
                                                  pa.array(classes[votes.argmax(axis=1)].astype(np.int32))], names=["id", "y", "pred"])

        rows = self.rows.select("id", "y", "bins", "draws")
        return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("pred", T.IntegerType())]))


def fit_forest(df: DataFrame, id_col: str, n_trees: int = 100, label_col: str = "label", features: str = "x", max_depth: int = 30,
               seed: int = 42, bins: int = BINS, per_split: int | None = None, draws: Column | None = None, early: bool | None = None) -> Forest:
    """A forest of ``n_trees`` on Poisson bootstrap bags (draws by a seeded hash
    of the id; or as the array ``draws`` tells), each split the best by Gini impurity
    among ``per_split`` random features of the node (the root of their number), until
    nodes are pure. ``early`` hands nodes over as soon as they have few rows, so that
    the driver and the tasks never hold more than the first levels; by itself it is
    done where the rows of all trees are more than ``EARLY_ROWS``."""
    classes = _classes(df, label_col)
    cuts = cut_points(df, features, bins)
    if draws is None:
        draws = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                            lambda b: poisson1_draw(hash_unit(seed, F.col(id_col), F.concat(F.lit("bag"), b.cast("string")))).cast("byte"))
    packed = F.unhex(F.concat_ws("", F.transform(draws, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0"))))
    rows = binned_rows(df, cuts, id_col, label_col, features, classes, {"draws": packed})
    d, k = len(cuts), len(classes)
    trees = Trees(n_trees, max(1, k))
    out = Forest(cuts, classes, trees)
    out.rows = rows
    if not k:
        return out
    slots = min(d, per_split or max(1, round(d ** 0.5)))
    table, open_, handed = rows.select("y", "bins", "draws"), trees.roots.copy(), []
    if early is None:
        early = rows.count() * n_trees > EARLY_ROWS
    most = max(1, GROUP_CELLS // max(1, slots)) if early else GROUP_ROWS
    for depth in range(max_depth):
        if not len(open_):
            break
        subset = np.argsort(np.random.default_rng([seed, depth]).random((len(open_), d)), axis=1)[:, :slots]
        number = np.full(len(trees.feature), -1)
        number[open_] = np.arange(len(open_))
        some = np.unique(trees.tree[open_])

        def cells(batch):
            y, b, w = batch.column(0).to_numpy(), _bytes(batch.column(1)), _bytes(batch.column(2))
            for t in some:
                seen = np.flatnonzero(w[:, t])
                at = number[trees.leaves(b[seen], t)]
                seen, at = seen[at >= 0], at[at >= 0]
                own = ((at[:, None] * slots + np.arange(slots)) * bins + b[seen[:, None], subset[at]]) * k + y[seen][:, None]
                yield own.ravel(), np.repeat(w[seen, t].astype(float), slots)[:, None]

        found = best_splits(table, cells, len(open_), slots, bins, k, "gini")
        if depth == 0:
            trees.value[open_[found["node"]]] = found["total"]
        good = np.flatnonzero(found["good"])
        nodes = open_[found["node"][good]]
        feature = subset[found["node"][good], found["slot"][good]]
        new = trees.split(nodes, feature, found["cut"][good], found["left"][good], (found["total"] - found["left"])[good])
        open_ = new[(trees.value[new] > 0).sum(axis=1) > 1]  # the others are pure
        if early or len(open_) > MOST_OPEN or handed:
            small = trees.value[open_].sum(axis=1) <= most
            handed.append(np.stack([open_[small], np.full(small.sum(), max_depth - depth - 1)]))
            open_ = open_[~small]
    if sum(h.shape[1] for h in handed):
        out.hand_over(*np.concatenate(handed, axis=1), slots, bins, seed, most)
    return out


def fit_tree(df: DataFrame, id_col: str, label_col: str = "label", features: str = "x", max_depth: int = 30, seed: int = 42) -> Forest:
    """One tree on every row, each split the best among all features."""
    return fit_forest(df, id_col, 1, label_col, features, max_depth, seed, per_split=1 << 30, draws=F.array(F.lit(1)), early=True)


def grid_cuts(df: DataFrame, features: str = "x", bins: int = BINS) -> list[np.ndarray]:
    """Where the bins of each feature end: between all of its values, or at its
    quantiles if it has more values than ``bins``."""
    cuts = cut_points(df, features, bins)
    if not cuts:
        return cuts
    about = df.agg(*[F.approx_count_distinct(F.get(features, i)) for i in range(len(cuts))]).first()
    few = [i for i, n in enumerate(about) if n <= 2 * bins]
    found = df.agg(*[F.collect_set(F.get(features, i)) for i in few]).first() if few else ()
    for i, values in zip(few, found):
        if len(values) <= bins:
            v = np.array(sorted(values), float)
            cuts[i] = (v[:-1] + v[1:]) / 2
    return cuts


class GridForest:
    """Regression trees on the cells that the bins of the features make: ``trees``
    has one a row, ``grid`` the mean of what they say of each cell."""

    def __init__(self, cuts: list[np.ndarray], trees: DataFrame) -> None:
        self.cuts, self.shape, self.trees = cuts, tuple(len(c) + 1 for c in cuts), trees
        shape, size = self.shape, int(np.prod(self.shape))

        def said(batches):
            total, n, bins = np.zeros(size), 0, np.stack(np.unravel_index(np.arange(size), shape), axis=1)
            for batch in batches:
                for r in batch.to_pylist():
                    tree = Trees(1, 1)
                    tree.feature, tree.cut, tree.left = (np.frombuffer(r[c], np.int64) for c in ("feature", "cut", "left"))
                    total += np.frombuffer(r["value"])[tree.leaves(bins, 0)]
                    n += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total), pa.array(np.full(size, n))], names=["cell", "v", "n"])

        sums = trees.mapInArrow(said, "cell long, v double, n long").groupBy("cell").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
        self.grid = scratch_table(sums.select("cell", (F.col("v") / F.col("n")).alias("prediction")), "forest-grid")

    def predict(self, df: DataFrame, id_col: str, label_col: str = "y", features: str = "x") -> DataFrame:
        """(id, label, prediction)"""
        return _in_cells(df, self.cuts, id_col, label_col, features).join(self.grid, "cell").select(id_col, label_col, "prediction")


def _in_cells(df: DataFrame, cuts: list[np.ndarray], id_col: str, label_col: str, features: str) -> DataFrame:
    """(id, label, cell) of the rows that have features."""
    rows = df.where(F.col(features).isNotNull()).select(id_col, label_col, F.col(features).cast("array<double>").alias("_x"))
    shape = tuple(len(c) + 1 for c in cuts)

    def run(batches):
        for batch in batches:
            bins = _binned(_matrix(batch.column(2), len(cuts)), cuts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.ravel_multi_index(tuple(bins.T), shape))],
                                             names=[id_col, label_col, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("cell", T.LongType())]))


def fit_grid_forest(df: DataFrame, id_col: str, n_trees: int = 100, label_col: str = "y", features: str = "x", max_depth: int = 20,
                    seed: int = 42, bins: int = BINS, per_split: int | None = None) -> GridForest | None:
    """Regression trees on Poisson bootstrap bags (draws by a seeded hash of each
    row), each split the one that leaves the least variance among ``per_split`` random
    features of the node (a third). None if the bins make more than ``GRID_CELLS``."""
    cuts = grid_cuts(df, features, bins)
    shape = tuple(len(c) + 1 for c in cuts)
    if not cuts or np.prod(shape, dtype=float) > GRID_CELLS:
        return None
    r = df.agg(F.avg(label_col), F.stddev_pop(label_col)).first()
    mean, unit = r[0], r[1] or 1.0
    slots = min(len(cuts), per_split or -(-len(cuts) // 3))
    rows = _in_cells(df, cuts, id_col, label_col, features).withColumn("salt", F.pmod(F.xxhash64(id_col, label_col), F.lit(_SALTS)))
    copy = F.row_number().over(Window.partitionBy("cell", "salt", id_col, label_col).orderBy("cell"))  # a row that comes twice is drawn twice
    rows = rows.repartition("cell", "salt").withColumn("copy", copy).select(
        "cell", ((F.col(label_col) - mean) / unit).alias("y"), F.xxhash64(F.lit(seed), id_col, label_col, "copy").alias("key"))
    own, steps = _mix(np.arange(n_trees)), [np.uint64(int(t * 2**64)) for t in poisson1_thresholds()]

    def drawn(batches):
        keys, sums, size = [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                cell, y, key = (c.to_numpy() for c in batch.slice(a, 1024).columns)
                u = _mix(key.view(np.uint64)[:, None] ^ own)
                w = np.zeros(u.shape)
                for step in steps:
                    w += u >= step
                k, s = _added([cell], [np.concatenate([w, w * y[:, None]], axis=1)])
                keys.append(k)
                sums.append(s)
                size += len(k)
                if size >= 2 * _KEPT_ROWS:
                    k, s = _added(keys, sums)
                    keys, sums, size = [k], [s], len(k)
                    if size >= _KEPT_ROWS:
                        yield by_tree(k, s)
                        keys, sums, size = [], [], 0
        if size:
            yield by_tree(*_added(keys, sums))

    def by_tree(k, s):
        seen = [s[:, t] > 0 for t in range(n_trees)]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n_trees, dtype=np.int32)), pa.array([k[i].tobytes() for i in seen], pa.binary()),
                                           pa.array([s[i][:, [t, n_trees + t]].tobytes() for t, i in enumerate(seen)], pa.binary())], names=["tree", "cells", "sums"])

    def grown(group: pa.Table) -> pa.Table:
        tree = group["tree"][0].as_py()
        cell, s = _added([np.frombuffer(x, np.int64) for x in group["cells"].to_pylist()], [np.frombuffer(x).reshape(-1, 2) for x in group["sums"].to_pylist()])
        b = np.stack(np.unravel_index(cell, shape), axis=1)
        out = grow_rest(np.zeros(len(cell), np.int64), s[:, 1] / s[:, 0], s[:, 0], b, np.array([tree]), np.array([max_depth]), slots, max(shape), 2, seed, kind="newton")
        value = out.value[:, 0] / out.value[:, 1] * unit + mean
        return pa.Table.from_arrays([pa.array([tree], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (out.feature.astype(np.int64), out.cut, out.left, value))],
                                    names=["tree", "feature", "cut", "left", "value"])

    trees = rows.mapInArrow(drawn, "tree int, cells binary, sums binary").where(F.length("cells") > 0).groupBy("tree").applyInArrow(
        grown, "tree int, feature binary, cut binary, left binary, value binary")
    return GridForest(cuts, scratch_table(trees, "forest-trees"))


class Boosted(Ensemble):
    """One tree per class and round; tree r * classes + c adds to class c."""

    rate = 0.1
    base: np.ndarray

    def margins(self, bins: np.ndarray, first: int = 0, start: np.ndarray | None = None) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1)) if start is None else start.copy()
        for t in range(first, len(self.trees.roots)):
            out[:, t % len(self.classes)] += self.rate * self.trees.value[self.trees.leaves(bins, t), 0]
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.margins(bins)


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_boosting(df: DataFrame, id_col: str, label_col: str = "label", features: str = "x", rounds: int = 20, max_depth: int = 5,
                 rate: float = 0.1, penalty: float = 1.0, bins: int = BINS) -> Boosted:
    """Multi-class gradient boosting: each round one tree per class, of
    ``max_depth`` levels, on the gradients and curvatures of the softmax loss; the
    trees of all classes grow in the same passes."""
    classes = _classes(df, label_col)
    cuts = cut_points(df, features, bins)
    d, k = len(cuts), len(classes)
    out = Boosted(cuts, classes, Trees(0, 1))
    out.rate, out.base = rate, np.zeros(k)
    if k < 2:
        return out
    rows = binned_rows(df, cuts, id_col, label_col, features, classes).drop("id")
    share = dict(map(tuple, rows.groupBy("y").count().collect()))
    out.base = np.log(np.array([share[c] for c in range(k)]) / sum(share.values()))
    table, written_to = rows.withColumn("m", F.lit(None).cast("binary")), 0

    def margins(batch):
        b = _bytes(batch.column(1))
        start = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(len(b), k) if written_to else None
        return b, out.margins(b, written_to, start)

    for r in range(rounds):
        if r and r % ROUNDS_KEPT == 0:  # the margins so far, beside the rows
            def kept(batches):
                for batch in batches:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in margins(batch)[1]], pa.binary())],
                                                     names=["y", "bins", "m"])

            new = scratch_table(table.mapInArrow(kept, table.schema), "boost-rows")
            if written_to:
                drop_scratch(table)
            table, written_to = new, len(out.trees.roots)
        grown = Trees(k, 1)  # of this round
        open_ = grown.roots.copy()
        for depth in range(max_depth):
            if not len(open_):
                break
            number = np.full(len(grown.feature), -1)
            number[open_] = np.arange(len(open_))
            some = np.unique(grown.tree[open_])

            def cells(batch):
                y = batch.column(0).to_numpy()
                b, m = margins(batch)
                p = _softmax(m)
                keys, sums = [np.zeros(0, np.int64)], [np.zeros((0, 3))]
                for t in some:
                    at = number[grown.leaves(b, t)]
                    seen = np.flatnonzero(at >= 0)
                    own = ((at[seen][:, None] * d + np.arange(d)) * bins + b[seen]).ravel()
                    gh = np.stack([(y[seen] == t) - p[seen, t], p[seen, t] * (1 - p[seen, t]), np.ones(len(seen))], axis=1)
                    first, last = int(at[seen].min(initial=0)) * d * bins, (int(at[seen].max(initial=-1)) + 1) * d * bins
                    # open nodes of a tree stand side by side, so their sums fit a dense array
                    dense = np.stack([np.bincount(own - first, np.repeat(v, d), max(0, last - first)) for v in gh.T], axis=1) if len(own) else np.zeros((0, 3))
                    has = np.flatnonzero(dense[:, 2])
                    keys.append(has + first)
                    sums.append(dense[has])
                yield np.concatenate(keys), np.concatenate(sums)

            found = best_splits(table.select("y", "bins", "m"), cells, len(open_), d, bins, 3, "newton", penalty)
            leaf = lambda s: (s[:, 0] / (s[:, 1] + penalty))[:, None] * (k - 1) / k
            if depth == 0:
                grown.value[open_[found["node"]]] = leaf(found["total"])
            good = np.flatnonzero(found["good"])
            left, right = found["left"][good], (found["total"] - found["left"])[good]
            open_ = grown.split(open_[found["node"][good]], found["slot"][good], found["cut"][good], leaf(left), leaf(right))
        out.trees = _joined(out.trees, grown)
    return out


def _joined(a: Trees, b: Trees) -> Trees:
    """The trees of ``a`` and then those of ``b``."""
    out, n = Trees(0, a.value.shape[1]), len(a.feature)
    out.roots = np.concatenate([a.roots, b.roots + n])
    out.tree = np.concatenate([a.tree, b.tree + len(a.roots)])
    out.feature, out.cut, out.left = np.concatenate([a.feature, b.feature]), np.concatenate([a.cut, b.cut]), np.concatenate([a.left, b.left + n])
    out.value = np.concatenate([a.value, b.value])
    return out
