"""A byte n-gram model with modified Kneser-Ney smoothing, counted by Spark.

Texts are read as the bytes of their UTF-8, nothing folded, so the model has as
many n-grams as the corpus has and grows with it; one model serves all languages,
as its contexts tell which one a text is in, also where it quotes another.

At the highest order an n-gram counts as often as it occurs (``raw``), at the lower
ones as often as different bytes come before it. A second form counts these at the
highest order too, so that a passage copied many times counts once; both forms have
the same n-grams, so one look-up gives both. A task keeps, for each n-gram that it
has read, how often it did and which bytes came before as 256 bits; Spark puts what
all tasks have together, and the lower orders, discounts and back-off weights follow
by grouping and joining on the n-grams. The result is written to the shared
folder as slices of one array sorted by hash; a task reads them slice by slice,
so neither the driver nor a task ever holds more than a slice of a large model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import same_bytes, utf8, written
from quarry.operators.small import collect_small

ORDER = 5                          # bytes of an n-gram; with the byte before it, 7 at most
SLICE_ROWS = 1 << 22               # entries of a slice, 12 bytes each (16 with both forms) and up to 8 for where they begin
_STEP, _CHUNK = 1 << 20, 1 << 20   # bytes of a piece of a long text, and worked on at once
_KEPT_KEYS = 1 << 22               # n-grams that a task holds before it passes them on
_HELD_TEXT = 1 << 26               # bytes of text that a task goes over once for each slice
_PAD = b" " * ORDER                # what comes before a text
_CONTEXT = 16                      # tells the hash of a context from that of an n-gram
_SUFFIX = np.uint64((1 << 8 * ORDER) - 1)


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some pieces of text at a time: the n-gram that ends at each byte with the byte before
    it (in the highest place), and of each piece its text, where it begins and ends.
    Long texts are cut, each piece with the bytes before it as context."""
    def flush(numbers, pieces):
        buffer = b"".join(pieces) + b"\0" * 8
        at = np.cumsum([0, *map(len, pieces)])
        # eight bytes from each place as one number, without copying; the wanted ones are the highest
        grams = np.ndarray(at[-1], ">u8", buffer, 0, (1,)).astype(np.uint64) >> np.uint64(8 * (7 - ORDER))
        # a number belongs to the byte that it ends with: the pad has none
        return grams, np.asarray(numbers), at[:-1], at[1:] - len(_PAD)

    numbers, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), _STEP):
            numbers.append(i)
            pieces.append(_PAD + t[:_STEP] if a == 0 else t[a - len(_PAD):a + _STEP])
            size += len(pieces[-1])
            if size >= _CHUNK:
                yield flush(numbers, pieces)
                numbers, pieces, size = [], [], 0
    if pieces:
        yield flush(numbers, pieces)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and what their counts add up to."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")  # of runs that are sorted already
    k = k[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[begin], np.add.reduceat(n[order], begin)


def _masks(keys: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """(gram, four masks, how often) of sorted keys that hold the byte before in the lowest place."""
    gram, byte = keys >> np.uint64(8), keys & np.uint64(255)
    first = np.concatenate([[True], gram[1:] != gram[:-1]])
    begin = np.flatnonzero(first)
    bit = np.uint64(1) << (byte & np.uint64(63))
    out = [pa.array(gram[begin].view(np.int64))]
    for word in range(4):
        out.append(pa.array(np.bitwise_or.reduceat(np.where(byte >> np.uint64(6) == word, bit, np.uint64(0)), begin).view(np.int64)))
    return [*out, pa.array(np.add.reduceat(counts, begin))]


def count_ngrams(docs: DataFrame, text_col: str = "text", raw: bool = False) -> DataFrame:
    """(gram long, n long): the n-grams of all texts and how many different bytes come before
    each; with ``raw`` also (raw long) how often each occurs."""
    names = ["gram", "m0", "m1", "m2", "m3", "raw"]

    def run(batches):
        kept, counts, size = [], [], 0
        for batch in batches:
            for grams, _, begins, ends in _chunks(same_bytes(batch.column(0))):
                inside = np.ones(len(grams), bool)
                pads = ends[:, None] + np.arange(len(_PAD))
                inside[pads[pads < len(grams)]] = False
                # n-grams of a piece begin one byte before its context, so they follow from the place after it
                own = grams[inside]
                keys, often = np.unique((own & _SUFFIX) << np.uint64(8) | own >> np.uint64(8 * ORDER), return_counts=True)
                kept.append(keys)
                counts.append(often)
                size += len(keys)
                if size >= _KEPT_KEYS:
                    keys, often = _summed(kept, counts)
                    kept, counts, size = [keys], [often], len(keys)
                    if size >= _KEPT_KEYS // 2:
                        yield pa.RecordBatch.from_arrays(_masks(keys, often), names=names)
                        kept, counts, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays(_masks(*_summed(kept, counts)), names=names)

    rows = docs.select(utf8(text_col).alias("text"))
    seen = rows.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("gram").agg(
        *[F.bit_or(m).alias(m) for m in names[1:5]], *([F.sum("raw").alias("raw")] if raw else []))
    return seen.select("gram", sum((F.bit_count(m) for m in names[2:5]), F.bit_count("m0")).cast("long").alias("n"), *(["raw"] if raw else []))


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a one-to-one hash of 64 bits."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(order: int | np.ndarray, gram: np.ndarray) -> np.ndarray:
    """63 bits, so that they sort alike as signed numbers."""
    return _mix(np.asarray(order).astype(np.uint64) << np.uint64(56) | gram.astype(np.uint64)) >> np.uint64(1)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2 and D3+ from the counts of counts; a half, one and three halves
    where these are too few to tell."""
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]


def estimate(counts: DataFrame) -> DataFrame:
    """(order, gram, value): the log probability of each n-gram of each order and,
    with ``_CONTEXT`` added to the order, the log back-off weight of each context;
    where the counts have ``raw``, also (raw) what these are by it."""
    forms = [c for c in ("n", "raw") if c in counts.columns]
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = tables[order + 1].groupBy(F.col("gram").bitwiseAND((1 << 8 * order) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    every = None
    for order, t in tables.items():  # raw: of the highest order; below it both forms are one
        t = t.select(F.lit(order).alias("order"), "gram", "n", *[F.col(c if order == ORDER else "n").alias(c) for c in forms[1:]])
        every = t if every is None else every.unionByName(t)
    every = written(every, "ngram-counts")
    few = {c: {(r["order"], r[c]): r["count"] for r in every.where(f"{c} <= 4").groupBy("order", c).count().collect()} for c in forms}
    out, lower = None, None
    for order in range(1, ORDER + 1):
        own = forms if order == ORDER else forms[:1]
        d = {c: [F.lit(x) for x in discounts(*(few[c].get((order, k), 0) for k in (1, 2, 3, 4)))] for c in own}
        t = (every.where(F.col("order") == order)
             .select("gram", *own, *[F.when(F.col(c) == 1, d[c][0]).when(F.col(c) == 2, d[c][1]).otherwise(d[c][2]).alias(f"d_{c}") for c in own],
                     F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND((1 << 8 * (order - 1)) - 1).alias("shorter")))
        total = t.groupBy("context").agg(*[x for c in own for x in (F.sum(c).alias(f"total_{c}"), (F.sum(f"d_{c}") / F.sum(c)).alias(f"weight_{c}"))])
        t = t.join(total, "context")
        t = t.withColumn("below", F.lit(1 / 256)) if lower is None else t.join(lower, "shorter")
        t = t.select("gram", "context", *[f"weight_{c}" for c in own], *[
            ((F.col(c) - F.col(f"d_{c}")) / F.col(f"total_{c}") + F.col(f"weight_{c}") * F.col("below")).alias(f"p_{c}") for c in own])
        t = written(t, "ngram-order")
        lower = t.select(F.col("gram").alias("shorter"), F.col("p_n").alias("below"))
        names = {"n": "value", "raw": "raw"}
        ps = [F.log(f"p_{c if c in own else 'n'}").cast("float").alias(names[c]) for c in forms]
        weights = [F.log(F.max(f"weight_{c if c in own else 'n'}")).cast("float").alias(names[c]) for c in forms]
        for part in (t.select(F.lit(order).alias("order"), "gram", *ps),
                     t.groupBy("context").agg(*weights).select(F.lit(order + _CONTEXT).alias("order"), F.col("context").alias("gram"), *[names[c] for c in forms])):
            out = part if out is None else out.unionByName(part)
    return out


class Slice:
    """Entries sorted by hash. As hashes are even, the first bits of one tell
    where it would stand, but for a place or a few."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        self.hashes, self.values = hashes.view(np.uint64), values
        self.low, self.high = (int(hashes[0]), int(hashes[-1])) if len(hashes) else (1, 0)
        span = max(1, self.high - self.low)
        self.shift = np.uint64(max(0, span.bit_length() - max(1, len(hashes).bit_length())))
        self.begin = np.searchsorted(self.hashes, (np.arange((span >> int(self.shift)) + 2, dtype=np.uint64) << self.shift) + np.uint64(max(0, self.low))).astype(np.int32)

    def find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands, and whether it does. All lie within the slice's bounds."""
        cell = (want - np.uint64(self.low)) >> self.shift
        at, end = self.begin[cell], self.begin[cell + np.uint64(1)]
        at = np.minimum(at, np.int32(len(self.hashes) - 1))
        seen = self.hashes[at] == want
        left = np.flatnonzero(~seen & (at + 1 < end))
        while len(left):
            at[left] += 1
            seen[left] = self.hashes[at[left]] == want[left]
            left = left[~seen[left] & (at[left] + 1 < end[left])]
        return at, seen


_HELD: dict[str, Slice] = {}  # of this worker process: the slice read last


def _read(path: str) -> Slice:
    if path not in _HELD:
        _HELD.clear()
        store, base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        table = pq.read_table(base, filesystem=store)
        values = [table.column(c).to_numpy() for c in table.column_names if c != "hash"]
        _HELD[path] = Slice(table.column("hash").to_numpy(), values[0] if len(values) == 1 else np.stack(values, axis=1))
    return _HELD[path]


class NgramModel:
    """The slices' paths; what a task needs to score texts. With both ``forms``
    every probability and score is a pair: by the different bytes, by raw counts."""

    def __init__(self, paths: list[str], forms: int = 1) -> None:
        self.paths, self.shape = paths, () if forms == 1 else (forms,)

    def _values(self, order: int, gram: np.ndarray, total: np.ndarray, where) -> np.ndarray:
        """Add what the model has for the n-grams to ``total`` by ``where``; says which it has."""
        want, out = _hash(order, gram), np.zeros(len(gram), bool)
        for path in self.paths:
            part = _read(path)
            some = np.flatnonzero((want >= np.uint64(part.low)) & (want <= np.uint64(max(part.high, 0)))) if len(self.paths) > 1 else slice(None)
            mine = want[some]
            if not len(mine) or not len(part.hashes):
                continue
            if len(self.paths) == 1:  # what lies beyond the ends isn't there
                mine = np.clip(mine, np.uint64(part.low), np.uint64(part.high))
            at, seen = part.find(mine)
            seen &= part.hashes[at] == want[some]
            where(total, some, np.where(seen.reshape(-1, *(1 for _ in self.shape)), part.values[at], 0))
            out[some] |= seen
        return out

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each n-gram of the highest order after the others."""
        out, left = np.zeros((len(grams), *self.shape)), np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            own = grams[left] & np.uint64((1 << 8 * order) - 1)

            def add(total, some, value):
                total[left[some]] += value

            seen = self._values(order, own, out, add)
            left, own = left[~seen], own[~seen]
            if not len(left):
                return out
            self._values(order + _CONTEXT, own >> np.uint64(8), out, add)
        out[left] -= np.log(256)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Of each text the negative log probability (0 for an empty text)."""
        out = np.zeros((len(texts), *self.shape))
        for grams, numbers, begins, ends in _chunks(texts):
            logs = np.concatenate([np.zeros((1, *self.shape)), np.cumsum(self.log_p(grams & _SUFFIX), axis=0)])
            np.add.at(out, numbers, logs[begins] - logs[ends])
        return out


def held(batches: Iterator[pa.RecordBatch], column: int, slices: int) -> Iterator[pa.RecordBatch]:
    """The batches, put together to about ``_HELD_TEXT`` bytes of text where the
    model has several slices, so that each is read once for as much text."""
    if slices < 2:
        yield from batches
        return
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.column(column).nbytes
        if size >= _HELD_TEXT:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, size = [], 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def fit(docs: DataFrame, text_col: str = "text", raw: bool = False) -> NgramModel:
    """Count, estimate, and write the slices; with ``raw`` in both forms."""
    counts = written(count_ngrams(docs, text_col, raw), "ngram-types")  # the texts are read once
    entries = written(estimate(counts), "ngram-entries")
    slices, names = max(1, -(-entries.count() // SLICE_ROWS)), ["value", "raw"] if raw else ["value"]

    def hashed(batches):
        for batch in batches:
            h = _hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), *batch.columns[2:]], names=["hash", *names])

    rows = entries.select("order", "gram", *names).mapInArrow(hashed, ", ".join(["hash long", *(f"{c} float" for c in names)]))
    model = written(rows.repartitionByRange(slices, "hash").sortWithinPartitions("hash"), "ngram-model")
    return NgramModel(sorted(model.inputFiles()), len(names))


def language_key(known: list[str], lang_col: str = "lang") -> Column:
    """The language if it is one of ``known``, else null."""
    lang = F.col(f"`{lang_col}`").cast("string")
    return F.when(lang.isin(known), lang) if known else F.lit(None).cast("string")


def languages(measures: DataFrame, least: int, lang_col: str = "lang") -> list[str]:
    """The languages that ``least`` rows or more have, as the table has them."""
    counts = measures.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().where(F.col("count") >= least)
    return sorted(r[0] for r in collect_small(counts.select(lang_col), "languages"))
