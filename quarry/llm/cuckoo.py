"""Exact dedup by a cuckoo-filter index of live digests.

The index is dealt over shards by the SHA-256 of the texts. A shard holds a
cuckoo filter (16-bit fingerprints, two buckets of four slots for a key) and,
beside it, the stored keys: digest, number of rows and the row that stays. A
digest that the filter doesn't know is new and is stored at once; one that it
knows is only perhaps there, and is compared with the stored digests. A filter
that overflows is built again, twice as large, from the stored keys. A digest
whose last row is deleted leaves the filter and the keys.

Only digests move: a task first runs what it reads through a filter of its own,
so that a text sends one row for each task that has it, however many copies
there are. Every change gives a new index whose tables lie in the shared folder;
the old one stays as it was, so that a lost executor costs a task and no state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_names, utf8, written

# Parameters: keys of a shard (and of a task's own filter), the least number of shards.
SHARD_KEYS, LEAST_SHARDS = 1 << 17, 64
SLOTS, FINGERPRINT_BITS, MOST_KICKS = 4, 16, 500
FILLED = 0.85                      # of the slots, when a filter is made
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """A set of 64-bit hashes that may say yes wrongly, never no wrongly."""

    def __init__(self, keys: int) -> None:
        self.table = np.zeros((1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * FILLED))))), SLOTS), np.uint16)

    @classmethod
    def holding(cls, hashes: np.ndarray, keys: int = 0) -> CuckooFilter:
        """A filter with room for ``keys`` that holds ``hashes``; larger if they don't fit."""
        out = cls(max(keys, len(hashes)))
        while not out.insert(hashes):
            out.table = np.zeros((2 * len(out.table), SLOTS), np.uint16)
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls(1)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return out

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The other bucket of a fingerprint that may be in bucket ``at``."""
        return at ^ ((mark.astype(np.uint64) * _MIX >> np.uint64(20)).astype(np.int64) & (len(self.table) - 1))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(hashes >> np.uint64(64 - FINGERPRINT_BITS), np.uint64(1)).astype(np.uint16)
        at = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, at, self._other(at, mark)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, at, other = self._places(hashes)
        return (self.table[at] == mark[:, None]).any(axis=1) | (self.table[other] == mark[:, None]).any(axis=1)

    def _put(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Fill free slots of the buckets; says which fingerprints found one."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        nth = np.arange(len(at)) - np.searchsorted(sorted_at, sorted_at)
        taken = self.table[sorted_at] != 0
        fits = nth < SLOTS - taken.sum(axis=1)
        slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(at)), np.minimum(nth, SLOTS - 1)]
        self.table[sorted_at[fits], slot[fits]] = mark[order][fits]
        out = np.zeros(len(at), bool)
        out[order[fits]] = True
        return out

    def insert(self, hashes: np.ndarray) -> bool:
        """Add hashes that aren't in the set; False if the filter overflows,
        which leaves it without one of them: it must then be made anew."""
        mark, at, other = self._places(hashes)
        left = ~self._put(at, mark)
        left[left] = ~self._put(other[left], mark[left])
        for bucket, m in zip(other[left].tolist(), mark[left]):
            for kick in range(MOST_KICKS):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = m
                    break
                slot = (bucket + kick) % SLOTS
                m, self.table[bucket, slot] = self.table[bucket, slot], m
                bucket = int(self._other(np.array([bucket]), np.array([m]))[0])
            else:
                return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Take out hashes that are in the set, each once."""
        for m, *buckets in zip(*self._places(hashes)):
            for b in buckets:
                slots = np.flatnonzero(self.table[b] == m)
                if len(slots):
                    self.table[b, slots[0]] = 0
                    break


def _hashes(digests: np.ndarray) -> np.ndarray:
    """The first eight bytes of each digest (32 bytes, as numpy's S32 strips zeros: V32)."""
    return np.ascontiguousarray(digests).view(np.uint8).reshape(-1, 32)[:, :8].copy().view(np.uint64).ravel()


def _digests(col) -> np.ndarray:
    data = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(data.to_pylist()), "V32")


def _largest(group: np.ndarray, has: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Position of the row with the largest id in each group; a null id is the least."""
    order = np.lexsort((tags, ids, has, group))
    last = np.ones(len(order), bool)
    last[:-1] = group[order][1:] != group[order][:-1]
    return order[last]


class Shard:
    """The stored keys of a shard and their filter."""

    def __init__(self, keys: int = 0, table: bytes | None = None) -> None:
        self.filter = CuckooFilter.from_bytes(table) if table else CuckooFilter(keys)
        self.resized = 0
        self.places: dict[bytes, int] = {}  # of the digests in the columns
        self.columns = [np.zeros(0, "V32"), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def __len__(self) -> int:
        return len(self.columns[0])

    def load(self, digests, n, has, ids, tags, filtered: bool) -> None:
        """Take over stored keys, with the filter that has them or without."""
        self.columns = [digests, n, has, ids, tags]
        self.places = {d: i for i, d in enumerate(digests.tolist())}
        if not filtered:
            self.filter = CuckooFilter.holding(_hashes(digests), max(len(digests), 1))

    def add(self, digests, n, has, ids, tags) -> None:
        """Count rows to their texts."""
        if not len(digests):
            return
        digests, group = np.unique(digests, return_inverse=True)
        top = _largest(group, has, ids, tags)
        n = np.bincount(group, n, len(digests)).astype(np.int64)
        has, ids, tags = has[top], ids[top], tags[top]
        hashes = _hashes(digests)
        perhaps = np.flatnonzero(self.filter.contains(hashes))
        at = np.full(len(digests), -1, np.int64)
        at[perhaps] = [self.places.get(d, -1) for d in digests[perhaps].tolist()]  # the filter may be wrong
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        where = at[old]
        _, own_n, own_has, own_ids, own_tags = self.columns
        own_n[where] += n[old]
        ahead = np.zeros(len(old), bool)
        if len(old):
            twice = np.tile(np.arange(len(old)), 2)
            ahead[:] = _largest(twice, *(np.concatenate([own[where], some[old]]) for own, some in ((own_has, has), (own_ids, ids), (own_tags, tags)))) >= len(old)
        for own, some in ((own_has, has), (own_ids, ids), (own_tags, tags)):
            own[where[ahead]] = some[old][ahead]
        begin = len(self)
        self.places.update(zip(digests[new].tolist(), range(begin, begin + len(new))))
        self.columns = [np.concatenate([own, some[new]]) for own, some in zip(self.columns, (digests, n, has, ids, tags))]
        if not self.filter.insert(hashes[new]):
            self.resized += 1
            self.filter = CuckooFilter.holding(_hashes(self.columns[0]), 2 * len(self))

    def replace(self, digests, n, has, ids, tags) -> None:
        """Set what is left of texts that lost rows; those with none go."""
        at = np.array([self.places.get(d, -1) for d in digests.tolist()], np.int64)
        known = np.flatnonzero(at >= 0)
        for own, some in zip(self.columns[1:], (n, has, ids, tags)):
            own[at[known]] = some[known]
        gone = at[known][n[known] == 0]
        self.filter.delete(_hashes(self.columns[0][gone]))
        stay = np.ones(len(self), bool)
        stay[gone] = False
        self.columns = [c[stay] for c in self.columns]
        self.places = {d: i for i, d in enumerate(self.columns[0].tolist())}


_KEYS = "id long, tag long, sha binary"
_GROUPS = "shard int, sha binary, n long, id long, tag long"
_STATE = "kind int, shard int, sha binary, n long, id long, tag long"  # kind 0: sha holds the filter, n the keys
_FILTER, _STORED, _ADDED, _LEFT = range(4)


def _columns(table) -> list[np.ndarray]:
    ids = table.column("id")
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return [_digests(table.column("sha")), table.column("n").to_numpy().copy(), np.array(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False).copy(),
            table.column("tag").to_numpy().copy()]


def _shards_of(digests: np.ndarray, shards: int) -> np.ndarray:
    part = np.ascontiguousarray(digests).view(np.uint8).reshape(-1, 32)[:, 8:12].copy().view(">u4").ravel()
    return (part.astype(np.int64) * shards >> 32).astype(np.int32)


def _rows(shard: Shard, shards: int) -> list[pa.Array]:
    digests, n, has, ids, tags = shard.columns
    return [pa.array(_shards_of(digests, shards)), pa.array(digests.tolist(), pa.binary()), pa.array(n), pa.array(ids, mask=~has), pa.array(tags)]


def _gathered(keys: DataFrame, shards: int, limit: int = SHARD_KEYS) -> DataFrame:
    """One row per text and task (or more, where a task has over ``limit`` texts)."""
    names = ["shard", "sha", "n", "id", "tag"]

    def run(batches):
        own = Shard(1 << 10)
        for batch in batches:
            ids = batch.column(0)
            own.add(_digests(batch.column(2)), np.ones(len(batch), np.int64), np.array(ids.is_valid()),
                    ids.fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy())
            if len(own) >= limit:
                yield pa.RecordBatch.from_arrays(_rows(own, shards), names=names)
                own = Shard(1 << 10)
        if len(own):
            yield pa.RecordBatch.from_arrays(_rows(own, shards), names=names)

    return keys.select("id", "tag", "sha").mapInArrow(run, _GROUPS)


def digest_keys(docs: DataFrame, id_col: str, text_col: str, generation: int = 0) -> DataFrame:
    """(id, tag, sha) per row; the tag tells rows with the same id apart and is
    as written, not as run."""
    return written(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.lit(generation), F.monotonically_increasing_id()).alias("tag"),
                               F.unhex(F.sha2(utf8(text_col), 256)).alias("sha")), "cuckoo-keys")


class CuckooIndex:
    """Texts that are live, with the rows that have them. Immutable: ``insert``
    and ``delete`` return another index."""

    def __init__(self, members: DataFrame, state: DataFrame, shards: int, generation: int) -> None:
        self.members, self.state, self.shards, self.generation = members, state, shards, generation

    @property
    def groups(self) -> DataFrame:
        """(sha, n, id, tag): each text, the number of its rows and the one that stays."""
        return self.state.where(F.col("kind") == _STORED).select("sha", "n", "id", "tag")

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> CuckooIndex:
        keys = digest_keys(docs, id_col, text_col)
        shards = _enough(keys.count(), shard_keys)
        return cls(keys, _changed([_as(_gathered(keys, shards), _ADDED)], shards), shards, 0)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> CuckooIndex:
        """The index with the rows of ``docs`` too. Where it has outgrown its
        shards, the stored keys are dealt over more and the filters made anew."""
        keys = digest_keys(docs, id_col, text_col, self.generation + 1)
        shards = max(self.shards, _enough(keys.count() + self.groups.count(), shard_keys))
        state = self.state
        if shards > self.shards:
            deal = F.shiftright(F.conv(F.hex(F.substring("sha", 9, 4)), 16, 10).cast("long") * shards, 32).cast("int")
            state = state.where(F.col("kind") == _STORED).withColumn("shard", deal)
        state = _changed([state, _as(_gathered(keys, shards), _ADDED)], shards)
        return CuckooIndex(self.members.unionByName(keys), state, shards, self.generation + 1)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> CuckooIndex:
        """The index without the rows whose id is in ``ids``; null ids and ids that it doesn't have change nothing."""
        gone = ids.select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id IS NOT NULL").distinct()
        members = written(self.members.join(gone, "id", "left_anti").select("id", "tag", "sha"), "cuckoo-keys")
        lost = written(self.members.join(gone, "id", "left_semi").select("sha").distinct(), "cuckoo-lost")
        row = F.struct(F.col("id").isNotNull().alias("has"), "id", "tag")
        left = (members.join(lost, "sha", "left_semi").groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max(row).alias("top"))
                .select("sha", "n", "top.id", "top.tag"))
        left = (lost.join(left.withColumnRenamed("sha", "s"), F.col("sha") == F.col("s"), "left")
                .select("sha", F.coalesce("n", F.lit(0)).alias("n"), "id", F.coalesce("tag", F.lit(0)).alias("tag")))
        shards = self.shards
        deal = F.shiftright(F.conv(F.hex(F.substring("sha", 9, 4)), 16, 10).cast("long") * shards, 32).cast("int")
        state = _changed([self.state, _as(left.withColumn("shard", deal), _LEFT)], shards)
        return CuckooIndex(members, state, shards, self.generation + 1)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(id, tag, sha, n, keep, keep_tag) for the rows of ``keys`` (id, tag,
        sha) whose text is live."""
        found = self.groups.select(F.col("sha").alias("s"), "n", F.col("id").alias("keep"), F.col("tag").alias("keep_tag"))
        return keys.join(found, F.col("sha") == F.col("s")).select("id", "tag", "sha", "n", "keep", "keep_tag")


def _enough(keys: int, shard_keys: int) -> int:
    return max(LEAST_SHARDS, 1 << max(0, int(np.ceil(np.log2(max(1, keys) / shard_keys)))))


def _as(groups: DataFrame, kind: int) -> DataFrame:
    return groups.select(F.lit(kind).alias("kind"), F.col("shard").cast("int").alias("shard"), "sha", "n", "id", "tag")


def _changed(parts: list[DataFrame], shards: int) -> DataFrame:
    """The state after what is added and lost, shard by shard."""
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        of = lambda k: table.filter(pa.array(kind == k))
        made, stored, added, left = (of(k) for k in (_FILTER, _STORED, _ADDED, _LEFT))
        shard = Shard(max(1 << 10, len(stored)), made.column("sha")[0].as_py() if len(made) else None)
        shard.load(*_columns(stored), filtered=len(made) > 0)
        for a in range(0, len(added), 1 << 14):
            shard.add(*_columns(added.slice(a, 1 << 14)))
        if len(left):
            shard.replace(*_columns(left))
        number, rows = table.column("shard")[0].as_py(), _rows(shard, shards)
        own = [pa.array([_FILTER] + [_STORED] * len(shard), pa.int32()), pa.array([number] * (len(shard) + 1), pa.int32()),
               pa.array([shard.filter.to_bytes(), *rows[1].to_pylist()], pa.binary()),
               *(pa.concat_arrays([pa.array([x], pa.int64()), r.cast(pa.int64())]) for x, r in zip((len(shard), None, 0), rows[2:]))]
        return pa.Table.from_arrays(own, names=["kind", "shard", "sha", "n", "id", "tag"])

    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return written(whole.groupBy("shard").applyInArrow(run, _STATE), "cuckoo-state")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256``.

    Texts are equal if they are the same bytes of UTF-8; null counts as empty.
    Of the rows with equal texts the one with the largest id (a long) stays;
    null ids are the smallest, and where all are null ``keep_id`` is null. Of
    rows that are the same in id and text, one stays. Very long texts take part
    by their digest like any other. An empty table gives an empty result; other
    columns aren't read.
    """
    index = CuckooIndex.of(docs, id_col, text_col)
    found = index.lookup(index.members)
    return found.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("id").eqNullSafe(F.col("keep")) & (F.col("tag") == F.col("keep_tag"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their
    columns. Rows with equal texts and equal ids are kept once."""
    has, sha, n = free_names(docs, "has", "sha", "n")
    index = CuckooIndex.of(docs, id_col, text_col)
    stay = index.groups.select(F.col("sha").alias(sha), F.col("id").alias(has))
    keyed = docs.withColumn(n, F.unhex(F.sha2(utf8(text_col), 256)))
    kept = keyed.join(stay, (F.col(n) == F.col(sha)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(has)))
    return kept.dropDuplicates([n]).select(*[F.col(f"`{c}`") for c in docs.columns])
