"""Chat formatting (DataFrame operations only).

Logs often hold a conversation several times, each snapshot with some more
turns. Every turn gets a rolling hash of the conversation up to it; a
conversation whose last hash stands inside another one is a prefix of that and
goes, by anti-join. The conversations left are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

# The marks of the rendered form.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SEGMENT = 128   # turns of one conversation that are handled together


#: A conversation is told by 128 bits of its id, so that null ids join too.
CONV = ["c1", "c2"]


def _narrow(turns: DataFrame) -> DataFrame:
    """The distinct turns with hashes in place of ids and texts."""
    return turns.select(*CONV, "turn", "role", F.xxhash64("text").alias("t1"), F.xxhash64(F.isnull("text"), "text", F.lit(1)).alias("t2")).distinct()


def _with(rows: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """Join ``more`` on the conversation and ``keys``. It is a table of its own,
    so Spark can split a very long conversation in the join."""
    return rows.join(written(more, "carry"), [*CONV, *keys])


def _numbered(narrow: DataFrame) -> DataFrame:
    """(conversation, i, p, q): the turns of each conversation numbered from 0,
    with the 128-bit hash (p, q) of all turns up to each.

    The hash is the xor of hashes of (number, role, text), so it can be summed
    up: first within segments of turns, then over the segments. The work on a
    conversation of any length is thus shared out between tasks.
    """
    seg = written(narrow.withColumn("seg", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))).cast("long")), "segments")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "t1", "t2"]
    inner = Window.partitionBy(*CONV, "seg").orderBy(*order)
    sizes = seg.groupBy(*CONV, "seg").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(*CONV, "seg", (F.sum("n").over(Window.partitionBy(*CONV).orderBy("seg")) - F.col("n")).alias("first"))
    placed = _with(seg.withColumn("k", F.row_number().over(inner) - 1), before, "seg")
    i, role = (F.col("first") + F.col("k")).alias("i"), F.col("role")
    marked = written(placed.select(*CONV, "seg", i, "role", "t1", "t2").select(
        *CONV, "seg", "i", F.xxhash64("i", F.isnull(role), role, "t1", "t2").alias("p"),
        F.xxhash64("t2", "t1", role, F.isnull(role), "i", F.lit(1)).alias("q")), "marks")
    parts = marked.groupBy(*CONV, "seg").agg(F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
    outer = Window.partitionBy(*CONV).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*CONV, "seg", *[F.coalesce(F.bit_xor(c).over(outer), F.lit(0)).cast("long").alias(f"{c}0") for c in "pq"])
    rolling = Window.partitionBy(*CONV, "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return _with(marked.withColumns({c: F.bit_xor(c).over(rolling) for c in "pq"}), carry, "seg").select(
        *CONV, "i", *[F.col(c).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "pq"])


def collapse(turns: DataFrame) -> DataFrame:
    """(conversation, n_turns, n_copies) of the maximal conversations: of equal
    ones that with the smallest id. Only hashes are shuffled."""
    marked = written(_numbered(_narrow(turns)), "rolling")
    last = marked.groupBy(*CONV).agg(F.max("i").alias("last"))
    rolled = written(_with(marked, last).withColumn("whole", F.col("i") == F.col("last")), "rolled")
    inside = rolled.where(~F.col("whole")).select("i", "p", "q").distinct()
    ids = turns.select(*CONV, "conv").distinct()
    whole = (_with(rolled.where("whole").select(*CONV, "i", "p", "q"), ids).groupBy("i", "p", "q")
             .agg(F.min(F.struct(F.isnull("conv").alias("none"), "conv", *CONV)).alias("first"), F.count(F.lit(1)).alias("n_copies")))
    kept = whole.join(inside, ["i", "p", "q"], "left_anti")
    return written(kept.select("first.c1", "first.c2", "first.conv", (F.col("i") + 1).alias("n_turns"), "n_copies"), "conversations")


def chat_formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of each maximal conversation.

    A conversation goes if its turns (role and text, in order) are the first ones
    of a longer one; of equal ones that with the smallest id stays (null last),
    and ``n_copies`` says how many there were. Turns go by number (null first),
    then role (null first) and a hash of the text; repeated rows count once. Null
    roles are rendered as ``unknown``, null texts as empty; both differ from any
    other value when conversations are compared. Rows with a null id form one
    conversation. Marks of the rendered form inside a text lose their bar, so
    they can't be read as marks. No rows: no conversations.

    The texts are shuffled once, for the rendering; a conversation becomes one
    row, so its own text is what a task must hold.
    """
    conv, text = F.col(f"`{conv_col}`"), F.col(f"`{text_col}`").cast("string")
    turns = conversations.select(F.xxhash64(conv).alias("c1"), F.xxhash64(F.isnull(conv), conv, F.lit(1)).alias("c2"), conv.alias("conv"),
                                 F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"),
                                 text.alias("text"))
    kept = collapse(turns)
    plain = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<")), F.lit("|>"), F.lit(">"))
    one = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), plain, F.lit(f"{CLOSE}\n"))
    place = F.struct("turn", "role", F.xxhash64("text").alias("t1"), F.xxhash64(F.isnull("text"), "text", F.lit(1)).alias("t2"), one.alias("one"))
    rows = turns.drop("conv").join(kept, CONV).select(*CONV, "conv", "n_turns", "n_copies", place.alias("x"))
    return rows.groupBy(*CONV, "conv", "n_turns", "n_copies").agg(F.array_sort(F.collect_set("x")).alias("xs")).select(
        F.col("conv").alias(conv_col), "n_turns", "n_copies",
        F.array_join(F.transform("xs", lambda x: x["one"]), "").alias("rendered"))
