"""Sequences of tokens: vocabularies, encoding, padding and masks, the
bigram language model and byte-pair merges.

Design: a document stays one row; tokens are produced by JVM array
functions inside the scan stage. Vocabularies are tables, indexed by a
distributed sort; encoding looks tokens up in slices of them, at every size.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as TX
from quarry.functions.hashing import hash_unit
from quarry.operators.ordering import with_global_index
from quarry.operators.small import local_frame
from quarry.session import cut_lineage, drop_scratch, scratch_table

SLICE_TOKENS, HELD_SLICES = 1 << 20, 4   # of a vocabulary: tokens of a file, and files that a worker keeps

_COUNTED_TOKENS = 1 << 20  # whose pairs are counted at once
_WHOLE_PAIRS = 1 << 20     # pairs that a task holds before it adds up what it has
_FIRST_MERGED = 0x110000   # symbols below are characters


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, n) over all rows — a partial+final aggregation."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, tokens: Column, pad: str | None = TX.PAD) -> DataFrame:
    """Sorted distinct tokens -> 0-based index (binary string order); with
    ``pad`` the pad token takes index 0 and every other index shifts by 1."""
    d = df.select(F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    v = with_global_index(d, ["token"], "idx")
    if pad is None:
        return v.select("token", "idx")
    v = v.select("token", (F.col("idx") + 1).alias("idx"))
    return local_frame(df.sparkSession, [(pad, 0)], "token string, idx long").unionByName(v)


def encode_frame(df: DataFrame, tokens: Column, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """Add ``out`` = vocabulary indices of ``tokens`` (unknown -> null; no
    tokens -> empty array)."""
    return encode_frames(df, {out: (tokens, vocab)})


def _slices(vocab: DataFrame) -> list[str]:
    """The vocabulary in the shared folder, sorted by token and cut into files of
    about ``SLICE_TOKENS``."""
    parts = max(1, -(-vocab.count() // SLICE_TOKENS))
    rows = vocab.select(F.col("token").cast("string").alias("token"), F.col("idx").cast("int").alias("idx"))
    rows = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, "token").sortWithinPartitions("token")
    return sorted(scratch_table(rows, "vocabulary").inputFiles())


_READ: dict[str, pa.Table] = {}  # of this worker process: the slices read last, ``HELD_SLICES`` at most


def _slice(path: str) -> pa.Table:
    if path not in _READ:
        while len(_READ) >= HELD_SLICES:
            del _READ[next(iter(_READ))]
        store, base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        _READ[path] = pq.read_table(base, filesystem=store).combine_chunks()
    return _READ[path]


def _indices(tokens: pa.Array, paths: list[str]) -> pa.Array:
    """The index of each token: the distinct ones are looked up, slice by slice."""
    coded = tokens.dictionary_encode()
    words, found = coded.dictionary, np.full(len(coded.dictionary), -1, np.int64)
    for path in paths:
        part = _slice(path)
        if part.num_rows:
            at = pc.index_in(words, value_set=part.column("token").combine_chunks())
            has = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            found[has] = part.column("idx").to_numpy()[at.drop_null().to_numpy()]
    known = pa.array(found.astype(np.int32), mask=found < 0)
    return known.take(coded.indices)


def encode_frames(df: DataFrame, columns: dict[str, tuple[Column, DataFrame]]) -> DataFrame:
    """Add several index arrays, {name: (tokens, vocabulary)}, side by side.

    A vocabulary, of any size, lies in the shared folder in slices; a task looks
    the distinct tokens of a batch up slice by slice. So encoding is a narrow
    step: no join, no row for a token, and no vocabulary that a task must hold
    whole. Null tokens and null arrays: null and empty."""
    paths = {out: _slices(vocab) for out, (_, vocab) in columns.items()}
    names, n = df.columns, len(df.columns)
    rows = df.select(*[F.col(f"`{c}`") for c in names], *[F.coalesce(t, F.array().cast("array<string>")).alias(f"_t_{out}") for out, (t, _) in columns.items()])
    schema = T.StructType([*df.schema.fields, *[T.StructField(out, T.ArrayType(T.IntegerType())) for out in columns]])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = []
            for i, out in enumerate(paths):
                arrays = batch.column(n + i)
                offsets = arrays.offsets.to_numpy() - arrays.offsets[0].as_py()
                made.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _indices(arrays.flatten(), paths[out])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def pad_batch(df: DataFrame, ids: str, labels: str, batch: str, pad_idx: int = 0,
              ignore_index: int = TX.IGNORE_INDEX) -> DataFrame:
    """Pad ids with ``pad_idx`` and labels with ``ignore_index`` up to the
    longest sequence of the batch; mask is True on padding. The batch max
    is a window over the batch (a handful of rows)."""
    L = F.size(ids)
    m = F.max(L).over(Window.partitionBy(batch))
    df = df.withColumn("_len", L).withColumn("_max", m)
    k = F.col("_max") - F.col("_len")
    return (df.withColumn("input_ids", F.concat(F.col(ids), F.array_repeat(F.lit(pad_idx), k)))
            .withColumn("label_ids", F.concat(F.col(labels), F.array_repeat(F.lit(ignore_index), k)))
            .withColumn("pad_mask", F.concat(F.array_repeat(F.lit(False), F.col("_len")), F.array_repeat(F.lit(True), k)))
            .drop("_len", "_max"))


def mlm_mask(ids: Column, key_cols: Sequence[str], p: float, mask_idx: int, seed=42,
             ignore_index: int = TX.IGNORE_INDEX) -> tuple[Column, Column]:
    """Hide a seeded share p of positions: input gets ``mask_idx``, label
    keeps the original index; other positions get label ``ignore_index``."""
    hidden = lambda t, i: hash_unit(seed, *key_cols, i) < F.lit(p)
    inp = F.transform(ids, lambda t, i: F.when(hidden(t, i), F.lit(mask_idx)).otherwise(t))
    lab = F.transform(ids, lambda t, i: F.when(hidden(t, i), t).otherwise(F.lit(ignore_index)))
    return inp, lab


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of a token array as structs (a, b) — two slices
    zipped, so no per-element lambda runs."""
    n = F.size(tokens)
    return F.arrays_zip(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                        F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))).alias("b"))


def pair_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, a, b, n): adjacent pairs of every row, counted per row within its batch
    and written once, without a shuffle (rows with equal keys have lines of their
    own); a row without a pair has one line with b (and, without tokens, a) null, so
    that no row and no lone token is lost."""
    t = df.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("_t"))
    schema = T.StructType([t.schema[key], T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])

    def counted(keys, tokens, lens):
        coded = tokens.dictionary_encode()
        words, v = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)]), len(coded.dictionary) + 1
        codes = coded.indices.fill_null(v - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lens)), lens)
        pairs, n = np.unique(((row[:-1] * v + codes[:-1]) * v + codes[1:])[row[1:] == row[:-1]], return_counts=True)
        lone, end = np.flatnonzero(lens < 2), np.cumsum(lens)
        first = np.where(lens[lone] == 1, codes[np.minimum(end[lone] - 1, len(codes) - 1)] if len(codes) else v - 1, v - 1)
        at = np.concatenate([pairs // (v * v), lone])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), words.take(pa.array(np.concatenate([pairs // v % v, first]))),
                                           words.take(pa.array(np.concatenate([pairs % v, np.full(len(lone), v - 1)]))),
                                           pa.array(np.concatenate([n, np.ones(len(lone), np.int64)]))], names=schema.names)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = batch.column(1)
            offsets, flat = arrays.offsets.to_numpy() - arrays.offsets[0].as_py(), arrays.flatten()
            begin = 0
            while begin < batch.num_rows:  # some rows at a time, of _COUNTED_TOKENS if not of one row
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + _COUNTED_TOKENS, side="right")) - 1)
                yield counted(batch.column(0)[begin:end], flat[int(offsets[begin]):int(offsets[end])], np.diff(offsets[begin:end + 1]))
                begin = end

    return scratch_table(t.mapInArrow(run, schema), "pairs")


def bigram_model(pairs: DataFrame) -> DataFrame:
    """(a, b, n, p) from :func:`pair_counts`: add-one smoothed P(b | a) =
    (n_ab + 1) / (n_a + V) for every seen bigram (unseen: 1 / (n_a + V)), V =
    distinct tokens. The model stays a table; only V reaches the driver."""
    seen = cut_lineage(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")))
    V = (seen.select(F.explode(F.array("a", "b")).alias("t")).where(F.col("t").isNotNull()).distinct().count())
    both = seen.filter(F.col("b").isNotNull())
    na = both.groupBy("a").agg(F.sum("n").alias("na"))
    return both.join(na, "a").select("a", "b", "n", ((F.col("n") + 1) / (F.col("na") + F.lit(V))).alias("p"))


def bigram_loglik(pairs: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """(key, n_bigrams, loglik) per row of the counted texts: 0 and null for a
    row without a pair. The counted pairs, not the texts, are joined."""
    j = pairs.join(model.select("a", "b", "p"), ["a", "b"], "left")
    n = F.when(F.col("b").isNotNull(), F.col("n")).otherwise(0)
    return j.groupBy(key).agg(F.sum(n).alias("n_bigrams"), F.sum(F.col("n") * F.log("p")).alias("loglik"))


class _Symbols:
    """Numbers of symbols: the code point of a character, and from ``_FIRST_MERGED``
    on those that merges made; a text has one number, however it was merged."""

    def __init__(self) -> None:
        self.made: list[str] = []

    def number(self, text: str) -> int:
        if len(text) == 1:
            return ord(text)
        if text not in self.made:
            self.made.append(text)
        return _FIRST_MERGED + self.made.index(text)

    def text(self, number: int) -> str:
        return chr(number) if number < _FIRST_MERGED else self.made[number - _FIRST_MERGED]

    def steps(self, merges: Sequence[tuple]) -> list[tuple[int, int, int]]:
        return [(self.number(a), self.number(b), self.number(a + b)) for a, b, *_ in merges]


def _split_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, and of each symbol the word that it is in."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.int32), np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])


def _merged(sym: np.ndarray, word: np.ndarray, steps: Sequence[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Left-to-right merges of adjacent symbols of a word, one step after another."""
    for a, b, ab in steps:
        at = np.flatnonzero((sym[:-1] == a) & (sym[1:] == b) & (word[:-1] == word[1:]))
        if not len(at):
            continue
        if a == b:  # of a run of matches every second is taken
            begin = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - at[begin][np.cumsum(begin) - 1]) % 2 == 0]
        sym = sym.copy()
        sym[at] = ab
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, word = sym[keep], word[keep]
    return sym, word


def bpe_learn(word_counts: DataFrame, n_merges: int, word: str = "word", count: str = "n",
              checkpoint_every: int = 10) -> list[tuple[str, str, int]]:
    """Learn byte-pair merges from a (word, n) table.

    Per round: adjacent symbol pairs of every word, weighted by the word
    count (added up in each task, then by Spark), the most frequent pair wins (ties:
    smallest pair). Words stay distributed, as numbers of symbols in arrays of a
    batch's words; a task applies the merges since they were last written, left to
    right, and they are written to the shared folder every ``checkpoint_every``
    rounds. Only the winning pair reaches the driver.
    """
    names = _Symbols()

    def split(batches):
        for batch in batches:
            sym, at = _split_words(batch.column(0).to_pylist())
            yield row(sym, at, batch.column(1).to_numpy())

    def row(sym, at, n):
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sym, at, n.astype(np.int64))], names=["sym", "at", "n"])

    def words(batches):
        for batch in batches:
            for sym, at, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield *_merged(np.frombuffer(sym, np.int32), np.frombuffer(at, np.int32), since), np.frombuffer(n, np.int64)

    def rewritten(batches):
        for sym, at, n in words(batches):
            several = np.bincount(at, minlength=len(n))[at] > 1  # single-symbol words yield no pairs
            yield row(sym[several], at[several], n)

    def added(keys, counts):
        k, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(k), np.int64)
        np.add.at(total, where, np.concatenate(counts))
        return [k], [total]

    def pairs(batches):
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for sym, at, n in words(batches):
            inside = at[:-1] == at[1:]
            keys.append((sym[:-1].astype(np.int64) << 32 | sym[1:])[inside])
            counts.append(n[at[:-1][inside]])
            if sum(map(len, keys)) >= _WHOLE_PAIRS:
                keys, counts = added(keys, counts)
        (k,), (c,) = added(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array([names.text(x) for x in (k >> 32).tolist()], pa.string()),
                                          pa.array([names.text(x) for x in (k & 0xFFFFFFFF).tolist()], pa.string()), pa.array(c)], names=["a", "b", "c"])

    form, merges, since = "sym binary, at binary, n binary", [], []
    rows = word_counts.where(F.length(word) > 1).select(F.col(word).cast("string"), F.col(count).cast("long"))
    w = scratch_table(rows.mapInArrow(split, form), "bpe-words")
    for r in range(n_merges):
        best = (w.mapInArrow(pairs, "a string, b string, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
                .orderBy(F.desc("c"), "a", "b").limit(1).collect())
        if not best:
            break
        merges.append((best[0]["a"], best[0]["b"], int(best[0]["c"])))
        since = since + names.steps(merges[-1:])
        if checkpoint_every and (r + 1) % checkpoint_every == 0:
            new = scratch_table(w.mapInArrow(rewritten, form), "bpe-words")
            drop_scratch(w)
            w, since = new, []
    drop_scratch(w)
    return merges


def bpe_apply(word: Column, merges: list[tuple]) -> Column:
    """The pieces of each word by the merges, in their order (null: null)."""
    names = _Symbols()
    steps = names.steps(merges)

    def cut(words: pa.Array) -> pa.Array:
        texts = words.fill_null("").to_pylist()
        sym, at = _merged(*_split_words(texts), steps)
        empty = np.setdiff1d(np.arange(len(texts)), at)  # the empty text is a piece
        at, sym = np.concatenate([at, empty]), np.concatenate([sym, np.full(len(empty), -1)])
        order = np.argsort(at, kind="stable")
        known, code = np.unique(sym[order], return_inverse=True)
        pieces = pa.array(["" if x < 0 else names.text(x) for x in known.tolist()], pa.string()).take(pa.array(code))
        ends = np.cumsum(np.bincount(at, minlength=len(texts)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pieces, mask=words.is_null())

    return F.arrow_udf(cut, T.ArrayType(T.StringType()))(word)
