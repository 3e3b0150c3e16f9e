"""Best-fit packing into sequences of several permitted lengths.

Documents become pieces of at most the greatest length; equal shards of pieces
are packed side by side. In a shard the pieces go by length, longest first, each
into the open bin with the least room that holds it. Where none does, a bin of
the length with the least cost for what it is going to hold is opened. In the end
each bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_schema, written

# Parameters. A bin costs its length and, besides, as much as OVERHEAD tokens.
LENGTHS, OVERHEAD = (512, 1024, 2048, 4096), 16
SHARD_PIECES = 4096


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, int, int]]:
    """(bin, offset, bin length) of each size, all at most the greatest length.
    Ties go by position."""
    lengths = sorted(lengths)
    order = np.argsort(-sizes, kind="stable")
    spare: list[tuple[int, int]] = []      # (room, bin) of the open bins, sorted
    filled: list[int] = []
    out = [(0, 0)] * len(sizes)
    # what is left to pack that fits a room: sums by size, as a prefix-sum tree
    top = lengths[-1]
    tree = [0] * (top + 2)

    def add(at: int, value: int) -> None:
        at += 1
        while at < len(tree):
            tree[at] += value
            at += at & -at

    def fitting(room: int) -> int:
        at, total = room + 1, 0
        while at:
            total += tree[at]
            at -= at & -at
        return total

    for size, n in zip(*np.unique(sizes, return_counts=True)):
        add(int(size), int(size) * int(n))
    for i in order.tolist():
        size = int(sizes[i])
        add(size, -size)
        at = bisect_left(spare, (size, -1))
        if at < len(spare):
            room, b = spare.pop(at)
        else:
            room, b = min((c for c in lengths if c >= size),
                          key=lambda c: ((c + overhead) / (size + min(c - size, fitting(c - size))), c)), len(filled)
            filled.append(0)
        out[i] = (b, filled[b])
        filled[b] += size
        if room > size:
            insort(spare, (room - size, b))
    final = [lengths[bisect_left(lengths, x)] for x in filled]
    return [(b, offset, final[b]) for b, offset in out]


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS,
                  overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(id, piece, start, n_tokens, shard, bin, offset, bin_length) per piece.

    A document's tokens are its words and an end mark (so null, empty and blank
    texts have one); ``start`` counts them from 0, and consecutive pieces cover
    all. Bins are numbered within shards. Repeated rows are packed each for
    themselves; null ids are packed like others. No rows: no pieces.

    Pieces are dealt over shards by hash, each row of a group of equal rows
    apart from the others, so a shard holds about ``shard_pieces`` whatever the data.
    """
    top = max(lengths)
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"),
                        (word_count(F.col(f"`{text_col}`")) + 1).alias("size"))
    # equal rows are counted, then told apart by number
    rows = sized.groupBy("id", "mark", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("id", "mark", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    pieces = rows.select("id", "mark", "copy", "size", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / top))).alias("piece")).select(
        "id", "mark", "copy", "piece", (F.col("piece") * top).alias("start"),
        F.least(F.lit(top).cast("long"), F.col("size") - F.col("piece") * top).alias("n_tokens"))
    pieces = written(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "mark", "copy", "piece"), F.lit(shards)).cast("int"))

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("n_tokens", "descending"), *((c, "ascending") for c in ("id", "mark", "copy", "piece"))])
        placed = np.array(pack(shard["n_tokens"].to_numpy(), lengths, overhead), np.int64).reshape(-1, 3)
        for k, name in enumerate(("bin", "offset", "bin_length")):
            shard = shard.append_column(name, pa.array(placed[:, k].copy()))
        return shard.select(names)

    schema = id_schema(rows, "piece long, start long, n_tokens long, shard int, bin long, offset long, bin_length long")
    names = schema.names
    return dealt.groupBy("shard").applyInArrow(run, schema).withColumnRenamed("id", id_col)
