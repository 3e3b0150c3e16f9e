"""Secret scan: every rule in one byte pass per text (see ``automaton``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.automaton import Rule, Scanner
from quarry.llm.common import id_schema, utf8

# The forms of the secrets. The letters of `assign` come in
# either case. The class of `hex` repeats 32 times in the expression itself:
# a run is found whole or not at all, so shorter runs need no look.
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = [
    Rule("assign", "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in _ASSIGN[:_ASSIGN.index(")")])
         + _ASSIGN[_ASSIGN.index(")"):], min_tail=8),
    Rule("access", r"AKIA[A-Z0-9]+", min_chars=16),
    Rule("hex", r"[0-9a-f]{32,}", min_chars=32),
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", min_chars=40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", min_chars=15),
]
BASE = ("assign", "access", "hex")

_SPANS = "secrets array<struct<kind:string,start:bigint,end:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_FOLLOW = bytes(range(0x80, 0xC0))  # the bytes of UTF-8 that begin no code point


def _code_points(data: bytes, cuts: set[int]) -> dict[int, int]:
    """Byte offsets to code points, one walk over the text."""
    if data.isascii():
        return {c: c for c in cuts}
    out, at, n = {}, 0, 0
    for c in sorted(cuts):
        n += len(data[at:c].translate(None, _FOLLOW))
        out[c], at = n, c
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rules: list[Rule] = RULES) -> DataFrame:
    """One row per row of ``docs``: (id_col, secrets array of kind, start, end).

    Spans are in code points, end exclusive, by start and then rule order;
    within a kind they are leftmost, longest and do not overlap, across kinds
    they may. Null or empty text: no spans. A null id, repeated rows and extra
    columns change nothing: rows are scanned one by one, without a shuffle. A
    very long text is scanned whole, in memory of a few times its bytes. An
    empty table gives an empty result.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    def run(batches):
        for batch in batches:
            spans = []
            for data in batch.column(1).to_pylist():
                found = scanner.scan(data)
                at = _code_points(data, {c for a, _, z in found for c in (a, z)}) if found else {}
                spans.append([{"kind": kinds[k], "start": at[a], "end": at[z]} for a, k, z in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], names=["id", "secrets"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, id_schema(rows, _SPANS)).select(F.col("id").alias(id_col), "secrets")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None,
                   rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``, all columns kept.

    Spans of different kinds that overlap are replaced together, under the kind
    that starts first. ``length_col``, where given, is set to the new length in
    code points. Rows without a span, null texts among them, stay as they are.
    """
    scanner = Scanner(rules)
    marks = [f"[{r.kind}]".encode() for r in rules]
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            col, out, changed = batch.column(at), [], False
            for text in col.to_pylist():
                data = b"" if text is None else text.encode("utf-8", "replace")
                found = scanner.scan(data)
                if found:
                    parts, end = [], 0
                    for a, k, z in found:
                        if a >= end:
                            parts += [data[end:a], marks[k]]
                        end = max(end, z)
                    text, changed = (b"".join(parts) + data[end:]).decode("utf-8", "replace"), True
                out.append(text)
            if changed:
                new = pa.array(out, col.type)
                batch = pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)],
                                                   schema=batch.schema)
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if length_col:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(f"`{text_col}`").isNull(), F.col(f"`{length_col}`"))
                             .otherwise(F.char_length(F.col(f"`{text_col}`"))).cast(kind))
    return out
