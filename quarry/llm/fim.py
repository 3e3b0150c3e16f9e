"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over immutable
buffers: its text, and one buffer with the sentinels. Cutting splits a
descriptor in two, arranging permutes them with the sentinels between, and the
inverse permutation restores the text. No step copies text: hashes and lengths
are streamed off the descriptors, and the text is put together once, where it is
wanted.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import BLANKS, id_schema, same_bytes, utf8

# Parameters: of a hundred documents, how many are rearranged, and how many of those begin with the suffix.
RATE, SPM_RATE, SEED = 50, 80, 42
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE

TEXT, MARKS = 0, 1  # the buffers
#: Order of prefix (0), middle (1) and suffix (2), each after its sentinel.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
_SENTINEL = (PREFIX, MIDDLE, SUFFIX)  # of each part

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_FOLLOW = bytes(range(0x80, 0xC0))


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over buffers that nobody changes."""

    def __init__(self, text: bytes, pieces: list[Piece] | None = None) -> None:
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [Piece(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *places: int) -> PieceTable:
        """Split the descriptors so that one begins at each of the rising places; a
        place met twice, or at an end, leaves an empty one."""
        out, at, left = [], 0, list(places)
        for p in self.pieces:
            while left and left[0] <= at + p.length:
                k = left.pop(0) - at
                out.append(Piece(p.buffer, p.start, k))
                at, p = at + k, Piece(p.buffer, p.start + k, p.length - k)
            out.append(p)
            at += p.length
        return PieceTable(self.buffers[TEXT], out)

    def arrange(self, order: tuple[int, ...], sentinels: tuple[bytes, ...]) -> PieceTable:
        """The descriptors in another order, each after its sentinel."""
        out = []
        for k in order:
            out += [Piece(MARKS, SENTINELS.index(sentinels[k]), len(sentinels[k])), self.pieces[k]]
        return PieceTable(self.buffers[TEXT], out)

    def restore(self, order: tuple[int, ...]) -> PieceTable:
        """Undo :meth:`arrange`: drop the sentinels, put each descriptor back."""
        out = [Piece(TEXT, 0, 0)] * len(order)
        for k, p in zip(order, self.pieces[1::2]):
            out[k] = p
        return PieceTable(self.buffers[TEXT], out)

    def parts(self):
        """The bytes, piece by piece, without copying them."""
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start:start + length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.parts():
            h.update(part)
        return h.hexdigest()

    def to_bytes(self) -> bytes:
        return b"".join(self.parts())


def parse(output: bytes, form: str) -> PieceTable:
    """Descriptors of a rearranged text, found by its sentinels alone. A document
    that holds a sentinel is never rearranged, so each stands there once."""
    if form == "plain":
        return PieceTable(output)
    pieces, ends = [], []
    for k in ORDERS[form]:
        ends.append(output.index(_SENTINEL[k], ends[-1] + 3 if ends else 0))
    for k, a, z in zip(ORDERS[form], ends, [*ends[1:], len(output)]):
        pieces += [Piece(MARKS, SENTINELS.index(_SENTINEL[k]), 3), Piece(TEXT, a + 3, z - a - 3)]
    return PieceTable(output, pieces)


def restored(output: bytes, form: str) -> PieceTable:
    """The document of an output, as descriptors over the output."""
    table = parse(output, form)
    return table if form == "plain" else table.restore(ORDERS[form])


def token_ends(data: bytes) -> np.ndarray:
    """Where each token ends: a word with the white space before it, and what white
    space is left at the end."""
    if not data:
        return np.zeros(0, np.int64)
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    last = ~blank
    last[:-1] &= blank[1:]
    last[-1] = True
    return np.flatnonzero(last) + 1


def code_points(data) -> int:
    return len(bytes(data).translate(None, _FOLLOW))


def transform(data: bytes, h: tuple[int, int, int, int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[PieceTable, str, int, int | None, int | None]:
    """(descriptors, form, tokens, characters of the prefix and of the middle) of a text by four hashes."""
    ends = token_ends(data)
    n = len(ends)
    if not n or h[2] % 100 >= rate or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return PieceTable(data), "plain", n, None, None
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    table = PieceTable(data).cut(a, b)
    prefix, middle, _ = map(code_points, table.parts())
    return table.arrange(ORDERS[form], _SENTINEL), form, n, prefix, middle


def _groups(id_col: str, seed: int) -> Column:
    """The first four 8-digit groups of the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def fim_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE,
                  seed: int = SEED, with_output: bool = True) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)
    per row, and ``output`` unless it isn't wanted.

    Null counts as empty. Empty texts and those that hold a sentinel are plain,
    as are those that the hash leaves out; a text of white space is one token.
    Prefix, middle and suffix may be empty where the cuts meet or lie at an end.
    ``restored_sha256`` is taken of the text that the output alone gives back.
    A null id is hashed as no digits. Very long texts are cut like any other, in
    memory of a few times their size. Repeated rows give equal rows, an empty
    table an empty result; other columns aren't read. ``output`` isn't valid text
    only where the text wasn't.
    """
    def run(batches):
        for batch in batches:
            out = []
            for data, h in zip(same_bytes(batch.column(1)), batch.column(2).to_pylist()):
                table, form, n, prefix, middle = transform(data, h, rate, spm_rate)
                whole = table.to_bytes()
                out.append((n, form, prefix, middle, table.sha256(), restored(whole, form).sha256(), whole if with_output else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=names)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), utf8(text_col).alias("text"), _groups(id_col, seed).alias("h"))
    schema = id_schema(rows, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output binary")
    out = rows.mapInArrow(run, T.StructType(schema.fields)).withColumnRenamed("id", id_col)
    return out.withColumn("output", F.decode("output", "UTF-8")) if with_output else out.drop("output")
