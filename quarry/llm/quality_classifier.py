"""Quality classifier: boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import boosting
from quarry.llm.common import id_schema, same_bytes, utf8, written

#: At most this many labelled rows are learnt from: those whose id hashes
#: lowest, so the choice is the same on every run. Scoring covers all rows.
MOST_TRAINING_ROWS = 60_000

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".!?", "pause": b",;:",
    "quote": b"'\"()-", "symbol": b"#*$%&|<>~^_=+@\\/{}[]`", "space": b" \t", "line": b"\n", "high": range(128, 256),
    "bang": b"!", "bar": b"|",
}
_SHARES = np.array([[b in set(c) for b in range(256)] for c in _CLASSES.values()], np.float64)
_SYMBOLS = tuple(bytes([b]) for b in _CLASSES["symbol"])
N_FEATURES = len(_CLASSES) + 15


def features(data: bytes) -> list[float]:
    """Statistics of one text; of an empty one all 0."""
    if not data:
        return [0.0] * N_FEATURES
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / len(data)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, m = len(words), max(len(lines), 1)
    often = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    runs = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    repeats = [1 - len(np.unique(x)) / len(x) if len(x) else 0.0 for x in (pairs, runs)]
    k = max(n, 1)
    return [
        *(_SHARES @ counts / len(data)), float(-(share * np.log2(share)).sum()), np.log1p(len(data)), np.log1p(n), np.log1p(len(lines)),
        n / m, float(lengths.mean()) if n else 0.0, float(lengths.std()) if n else 0.0, len(often) / k,
        often.most_common(1)[0][1] / k if n else 0.0, *repeats, 1 - len(set(lines)) / m,
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / m,
        sum(c for w, c in often.items() if w.endswith(_SYMBOLS)) / k,
        sum(c for w, c in often.items() if len(w) > 1 and w.isupper()) / k,
    ]


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features array<double>) per row of ``docs``."""
    def run(batches):
        for batch in batches:
            x = np.array([features(d) for d in same_bytes(batch.column(1))], np.float64).reshape(-1, N_FEATURES)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "features"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, id_schema(rows, "features array<double>"))


def held_out(id_col: str | Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, mod 4, is 2."""
    c = F.col(f"`{id_col}`") if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(id, y) of the rows to learn from, ``most`` at the most."""
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    return (marks.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
            .groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most))


def train(feature_rows: DataFrame, marks: DataFrame, settings: boosting.Settings = boosting.Settings()) -> boosting.Trees:
    """Fit on the rows of features that have a mark, in the order of their ids.

    An id with several labels counts with the lowest; one with several texts
    counts with one of them (that with the least features). Null ids and labels
    are left out.
    """
    rows = (feature_rows.join(marks, "id").groupBy("id").agg(F.min(F.struct("features", "y")).alias("r"))
            .select("id", "r.features", "r.y").orderBy("id").toPandas())
    x = np.array(rows["features"].tolist(), np.float64).reshape(-1, N_FEATURES)
    return boosting.fit(x, rows["y"].to_numpy(np.float64), settings)


def score(feature_rows: DataFrame, trees: boosting.Trees) -> DataFrame:
    """(id, score) of each row of features."""
    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x))], names=["id", "score"])

    return feature_rows.mapInArrow(run, id_schema(feature_rows, "score double"))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``.

    Only the text is scored: null and empty texts are, as a text without
    characters. Repeated rows get equal scores. Without labels, or with one kind
    only, every row scores the share of 1 (a half without any). A null id is
    scored and isn't held out. The statistics of a very long text are taken over
    all of it. An empty table gives an empty result; other columns aren't read.
    """
    rows = written(document_features(docs, id_col, text_col), "features")
    trees = train(rows, training_labels(labels, id_col, label_col, MOST_TRAINING_ROWS))
    return score(rows, trees).select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, unchanged; scores
    and edge cases as in :func:`classify_quality`."""
    marks = written(training_labels(labels, id_col, label_col, MOST_TRAINING_ROWS), "marks")
    # the marks are bounded by a parameter, so they can be sent to every task
    asked = F.broadcast(marks.select(F.col("id").alias("_id")))
    labelled = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    labelled = labelled.join(asked, F.col("id") == F.col("_id"), "left_semi")
    trees = train(document_features(labelled, "id", "text"), marks)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            x = [features(b"" if t is None else t.encode("utf-8", "replace")) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(trees.score(np.array(x, np.float64).reshape(-1, N_FEATURES)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
