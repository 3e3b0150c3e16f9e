"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two fingerprints of 64 bits that differ in at most 3 bits agree in at least
8 - 3 = 5 of their 8 bytes. The index has posting lists for bytes at given
positions: a list is named by four positions and the bytes there, and the 14
sets of positions are those of the Steiner system S(3, 4, 8), of which every
five positions contain one. So each pair that agrees in five bytes meets in a
list, and a list of 32 given bits stays short. Within a list the agreeing bytes
of each pair are tallied, pairs with fewer than the guaranteed number dropped, and
the rest verified bit by bit.

Only distinct fingerprints are indexed. A list that is long all the same (many
near copies) is cut into blocks, and each pair of blocks is a task's work of
bounded size. What a block emits is a spanning forest of its links: as many rows
as fingerprints at most, and enough for the components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_names, id_schema, same_bytes, utf8, written
from quarry.llm.components import components

SHINGLE_WORDS, MOST_BITS, SEED = 3, 3, 42
BLOCK = 1024

_ODD_BYTES = 3  # bytes in which a linked pair may differ
#: Sets of four positions that add up to nothing, position by position: S(3, 4, 8).
POSITIONS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprint(data: bytes, size: int = SHINGLE_WORDS) -> int:
    """SimHash of a text (UTF-8, A-Z taken as a-z); 0 without a word."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest = max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(line, SEED)
    last = ends[size - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # so that memory stays small for long texts
        some = range(at, min(n, at + (1 << 16)))
        first = starts[some.start:some.stop].tolist()
        h = np.fromiter([digest(line[a:z], SEED) for a, z in zip(first, last[some.start:some.stop])], np.uint64, len(some))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, mark, fp long) per row; fp holds the 64 bits, mark is a hash of the text."""
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x, size) for x in same_bytes(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["id", "mark", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _mark(text_col).alias("mark"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, id_schema(rows, "mark long, fp long"))


def _mark(text_col: str):
    return F.xxhash64(utf8(text_col))


def _postings(fps: DataFrame) -> DataFrame:
    """(list long, fp): the number of the set of positions above the 32 bits
    found there."""
    def bits(q):
        out = F.lit(0).cast("long")
        for p in q:
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        return out

    keys = [F.lit(i << 32).cast("long").bitwiseOR(bits(q)) for i, q in enumerate(POSITIONS)]
    return fps.select(F.explode(F.array(*keys)).alias("list"), "fp")


def _near(a: np.ndarray, b: np.ndarray, most_bits: int) -> np.ndarray:
    """Which fingerprints of ``a`` link to ``b``: bytes tallied, then verified."""
    odd = a ^ b
    same = np.zeros(len(odd), np.int8)
    for p in range(8):
        same += (odd & np.uint64(255 << (8 * p))) == 0
    found = same >= 8 - most_bits
    found[found] = np.bitwise_count(odd[found]) <= most_bits
    return found


def _forest(fps: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """Links that join what is linked within a bounded set, and no cycle."""
    out, left = [], fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = _near(left, at, most_bits)
            if near.any():
                new = left[near]
                left = left[~near]
                out += [(int(at), int(x)) for x in new]
                todo += list(new)
    return out


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` that join all that
    is within ``most_bits`` (3 at most) of each other, directly or in steps."""
    if not 0 <= most_bits <= _ODD_BYTES:
        raise ValueError("the index finds pairs of at most 3 differing bits")
    posted = written(_postings(fps), "postings")
    long = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("list", "name")
    rows = posted.join(long, F.col("list") == F.col("name"))
    # a list of n goes to blocks; (i, j) is the work on blocks i <= j
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    work = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = rows.select("list", "fp", F.explode(work).alias("w")).select("list", "w.i", "w.j", "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j")

    def run(batches):
        def forest(group):
            return _forest(np.unique(np.concatenate(group)).view(np.uint64), most_bits)

        def batch_of(found):
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

        key, group, found = None, [], []
        for batch in batches:
            names = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            fp = batch.column(3).to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if key != (here := tuple(names[a].tolist())):
                    if key is not None:
                        found += forest(group)
                    key, group = here, []
                group.append(fp[a:z])
            if len(found) >= 50_000:
                yield batch_of(found)
                found = []
        if key is not None:
            found += forest(group)
        if found:
            yield batch_of(found)

    return rows.mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, most_bits: int) -> DataFrame:
    """(id, mark, fp, root, component_id) per row."""
    rows = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    least = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(least.select("fp"), most_bits))
    classes = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = written(classes, "classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    ids = written(ids, "ids")  # so that Spark can split a component with very many fingerprints in the join
    named = classes.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return rows.join(named, F.col("fp") == F.col("f")).drop("f")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                   most_bits: int = MOST_BITS) -> DataFrame:
    """(id, fingerprint hex, component_id) per row of ``docs``.

    ``component_id`` is the smallest id that links reach, its own included.
    Texts with fewer than ``size`` words hash as they are; null, empty and blank
    ones have fingerprint 0, which links like any other. Repeated rows each get a
    row. A null id is smallest only where no other is reached. A very long text
    is hashed whole, 65,536 shingles at a time. Empty in, empty out; other columns
    aren't read.
    """
    return _grouped(docs, id_col, text_col, size, most_bits).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
             most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` without near copies: of each component one row stays, with the
    smallest id (null ids last; with the least hash of the text among rows of
    that id, and any one of rows that agree in both)."""
    groups = _grouped(docs, id_col, text_col, size, most_bits)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("r"))
    row, mark, kept_row, kept_mark = free_names(docs, "row", "mark", "kept_row", "kept_mark")
    keep = first.select(F.xxhash64("r.id", "r.mark").alias(kept_row), F.col("r.mark").alias(kept_mark))
    marked = docs.withColumn(mark, _mark(text_col)).withColumn(row, F.xxhash64(F.col(f"`{id_col}`"), F.col(mark)))
    kept = marked.join(keep, (F.col(row) == F.col(kept_row)) & (F.col(mark) == F.col(kept_mark)), "left_semi")
    return kept.dropDuplicates([row, mark]).select(*[f"`{c}`" for c in docs.columns])
