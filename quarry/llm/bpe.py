"""Byte-level BPE by a rank queue.

Within a pre-token the pair of neighbours with the lowest merge rank, leftmost
first, is merged until none is left. Each rank has a bucket of the places where
such a pair stands; a bitmap has one bit for each bucket with places, and a
bitmap over its words one bit for each word that isn't 0, so the lowest rank is
two find-first-set steps away. The tokens form a linked list. A place whose pair
has changed since it was put in is skipped when it comes up.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_schema, same_bytes, utf8

_WORD = 8                    # a bitmap word has 2 ** 8 bits
_MASK = (1 << _WORD) - 1
REMEMBERED = 600_000         # pre-tokens, in each of two generations


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    rank = ranks.get
    if (whole := rank(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))        # of the token at a place: the place of the next one
    before = list(range(-1, n - 1))
    pair: list[int | None] = [rank(piece[i:i + 2]) for i in range(n - 1)]  # of the token and the next
    pair.append(None)
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}         # the bitmap, but for words that have been 0 all along
    summary = 0
    for i, r in enumerate(pair):
        if r is not None:
            if r in buckets:
                buckets[r].append(i)   # places rise, so the list is a heap
            else:
                buckets[r] = [i]
                w = r >> _WORD
                words[w] = words.get(w, 0) | 1 << (r & _MASK)
                summary |= 1 << w
    while summary:
        w = (summary & -summary).bit_length() - 1
        bits = words[w]
        r = (w << _WORD) | ((bits & -bits).bit_length() - 1)
        bucket = buckets[r]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[r]
            words[w] = bits = bits & (bits - 1)
            if not bits:
                summary &= summary - 1
        if pair[i] != r:
            continue                   # stale: merged away, or another pair by now
        j = end[i]
        end[i] = z = end[j]
        pair[j] = None
        if z < n:
            before[z] = i
            pair[i] = new = rank(piece[i:end[z]])
        else:
            pair[i] = new = None
        a = before[i]
        left = None
        if a >= 0:
            pair[a] = left = rank(piece[a:z])
        for at, r in ((i, new), (a, left)):
            if r is not None:
                if r in buckets:
                    heappush(buckets[r], at)
                else:
                    buckets[r] = [at]
                    w = r >> _WORD
                    words[w] = words.get(w, 0) | 1 << (r & _MASK)
                    summary |= 1 << w
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Encoder:
    """Texts to ids and back. The ids of pre-tokens met lately are remembered,
    packed, in two generations, so that the memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _look(self, word: str) -> bytes:
        ids = self.young.get(word) or self.old.get(word)
        if ids is None:
            ids = np.array(merge(word.encode("utf-8", "replace"), self.ranks), "<u4").tobytes()
        if len(word) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        words = self.find(text)
        found = list(map(self.young.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._look(words[i])
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_encoders: dict[tuple, Encoder] = {}


def encoder_of(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The encoder of this worker process for a vocabulary: what one task
    remembers helps the next. Only the last one asked for is held."""
    key = (id(ranks), pattern)  # the encoder holds the ranks, so the id stays theirs
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) per row.

    ``ids`` are the text's token ids; the digests are those of the ids as
    little-endian 32-bit integers and of the bytes that the ids decode to. Null
    and empty texts have no ids. Rows are encoded one by one, without a shuffle;
    the ranks (one vocabulary, whatever the data) go to the tasks as a broadcast.
    A very long text, or pre-token, is encoded whole: the queue's work grows with
    its length times the logarithm. Repeated rows give equal rows, null ids stay
    null, an empty table gives an empty result; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), utf8(text_col).alias("text"))
    schema = id_schema(rows, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

    def run(batches):
        encoder = encoder_of(shared.value, pattern)
        for batch in batches:
            n, digests, decoded, lists = [], [], [], []
            for data in same_bytes(batch.column(1)):
                packed = encoder.packed(data.decode("utf-8", "replace"))
                ids = np.frombuffer(packed, "<u4")
                n.append(len(ids))
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids.tolist())).hexdigest())
                if with_ids:
                    lists.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text binary): the bytes of each list of ids; null as none."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    def run(batches):
        for batch in batches:
            texts = [b"".join([shared.value[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["id", "text"])

    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return rows.mapInArrow(run, id_schema(rows, "text binary")).withColumnRenamed("id", id_col)
