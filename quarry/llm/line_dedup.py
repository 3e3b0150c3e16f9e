"""Lines that many documents share are dropped (DataFrame operations only).

Normalised lines are exploded and hashed, the distinct documents of each hash
counted, and the places of the lines over the threshold brought back to their
rows; there the other lines are joined again in their order. Only hashes and
places are shuffled for the counts, the texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, LOWER, UPPER, free_names, written

MOST_DOCUMENTS, LEAST_CHARS = 10, 1


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z as a-z."""
    line = F.btrim(line, F.lit(BLANKS))
    # lower() means more than A-Z for other scripts, and is faster for ASCII
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits that stand for a row's id and text; equal rows share them."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(i, t), F.xxhash64(t, i, F.lit(1))]


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = MOST_DOCUMENTS,
                      least_chars: int = LEAST_CHARS, length_col: str | None = None, counts: bool = False) -> DataFrame:
    """``docs`` with the lines gone whose key stands in ``threshold`` documents
    or more, in every document; all other columns and rows stay.

    Keys shorter than ``least_chars`` never go. A null text stays null where
    nothing else is asked (it counts as one empty line); one that loses all its
    lines becomes empty. Documents are told apart by id (null ids count as one
    document); repeated rows are treated alike. With ``counts``, the result is
    (id, n_lines, n_dropped, text) instead. ``length_col`` gets the new length.
    A very long text is split in its own row; its lines are spread over tasks for
    the counts. An empty table gives an empty result; names of other columns may
    clash with any used here.
    """
    ids, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    a, b = _row_key(id_col, text_col)
    rows = docs.select(ids.alias("id"), a.alias("a"), b.alias("b"), F.posexplode(_lines(text)).alias("pos", "line"))
    key = line_key(F.col("line"))
    hashed = written(rows.select("id", "a", "b", "pos", key.alias("key")).where(F.char_length("key") >= least_chars)
                     .select("id", "a", "b", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g")), "lines")
    often = hashed.select("h", "g", "id").distinct().groupBy("h", "g").count().where(F.col("count") >= threshold)
    # a table of its own, so that the join below deals out both its sides anew and Spark can split a very common line
    often = written(often.select(F.col("h").alias("oh"), F.col("g").alias("og")), "often")
    names = docs.columns
    row = dict(zip(("a", "b", "ga", "gb", "gone", "lines"), free_names(docs, "a", "b", "ga", "gb", "gone", "lines")))
    gone = (hashed.join(often, (F.col("h") == F.col("oh")) & (F.col("g") == F.col("og")), "left_semi")
            .groupBy(F.col("a").alias(row["ga"]), F.col("b").alias(row["gb"])).agg(F.collect_set("pos").alias(row["gone"])))
    gone = written(gone, "gone")  # so that Spark can split a row that is repeated very often
    here = docs.withColumns({row["a"]: a, row["b"]: b}).join(
        gone, (F.col(row["a"]) == F.col(row["ga"])) & (F.col(row["b"]) == F.col(row["gb"])), "left")
    # split once a row: inside the lambda below only the column is looked up
    here = here.withColumn(row["lines"], _lines(F.col(f"`{text_col}`")))
    gone_at, lines = F.col(row["gone"]), F.col(row["lines"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_at)
    left = F.when(gone_at.isNull(), F.col(f"`{text_col}`")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    if counts:
        return here.select(F.col(f"`{id_col}`"), F.size(lines).cast("long").alias("n_lines"),
                           F.coalesce(F.size(gone_at), F.lit(0)).cast("long").alias("n_dropped"),
                           F.coalesce(left, F.lit("")).alias("text"))
    out = {c: F.col(f"`{c}`") for c in names} | {text_col: left}
    if length_col:
        out[length_col] = F.when(gone_at.isNull(), F.col(f"`{length_col}`")).otherwise(
            F.char_length(left).cast(docs.schema[length_col].dataType))
    return here.select(*[c.alias(n) for n, c in out.items()])
