"""Quality rules: repetition and length rules, and perplexity bands.

The perplexity of a text is that of a word by a byte n-gram model of the whole
corpus with modified Kneser-Ney smoothing (``ngram``). Each language has a lower and
an upper bound around the middle of its documents; a text below the lower one repeats
what is usual, one above the upper one isn't prose. Short texts scatter more, so the
bounds widen for them. Junk that many documents share is frequent, and so usual by
raw counts: a text must keep within the bounds of the model's second form too, where
a passage copied many times counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import ngram
from quarry.llm.common import BLANKS, id_schema, same_bytes, utf8, written

# Parameters.
WINDOW = 8                     # words of a window that may repeat
LEAST_WORDS, MOST_REPEATED = 20, 30
WIDTH = 3.0                    # half a band, in deviations of a text of its length (README: junk rejected, clean text kept)
MARGIN = 0.03                  # and, besides, as much log perplexity
LEAST_TEXTS = 100              # a language with fewer texts that pass the base rules shares a band with the others, and with null
_ACCURACY = 10_000             # of the medians: their rank is off by a 10,000th at most

_BLANK_BYTES, _SYMBOL_BYTES = BLANKS.encode(), b"#*$%&|<>"
_FOLLOW = bytes(range(0x80, 0xC0))
_ODD = np.array([int(x) | 1 for x in np.random.default_rng(8).integers(0, 2**63, WINDOW)], np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for i in range(window):
        sums += h[i:n + i] * _ODD[i]
    order = np.argsort(sums, kind="stable")
    twin = np.zeros(n + 1, bool)
    np.equal(sums[order][1:], sums[order][:-1], out=twin[1:n])
    if not twin.any():
        return 0
    # equal sums only suggest it: compare the words
    places: dict[tuple, list[int]] = {}
    for i in order[twin[:n] | twin[1:]].tolist():
        places.setdefault(tuple(words[i:i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for at in places.values():
        if len(at) > 1:
            np.add.at(edge, at, 1)
            np.add.at(edge, np.array(at) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = data.split()  # at exactly the white space of the rule
    chars = len(data.translate(None, _FOLLOW + _BLANK_BYTES))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), chars, len(data) - len(data.translate(None, _SYMBOL_BYTES)),
            len(lines) - len(set(lines)), repeated_words(words))


def quality_measures(docs: DataFrame, model: ngram.NgramModel, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """(id, lang, the five counts, log_ppl: that of a word, and log_types: by the
    model's second form) per row, for a model with both forms."""
    def run(batches):
        for batch in ngram.held(batches, 2, len(model.paths)):
            data = same_bytes(batch.column(2))
            counts = np.array([measure(x) for x in data], np.int64).reshape(-1, 5)
            log_types, log_ppl = (model.score(data) / np.maximum(counts[:, :1], 1)).T.copy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in counts.T.copy()), pa.array(log_ppl), pa.array(log_types)],
                                             names=["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl", "log_types"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, id_schema(rows, "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double, log_types double"))


def _medians(rows: DataFrame, value: Column) -> dict[str | None, float]:
    """Median of ``value`` by language over all rows, by Spark's mergeable sketch."""
    return dict(map(tuple, rows.groupBy("key").agg(F.percentile_approx(value, 0.5, _ACCURACY).alias("m")).collect()))


def _by_language(values: dict[str | None, float]) -> Column:
    own = [F.lit(x) for lang, v in values.items() if lang is not None for x in (lang, v)]
    other = F.lit(values.get(None, 0.0)).cast("double")
    return F.coalesce(F.element_at(F.create_map(*own), F.col("key")), other) if own else other


def perplexity_bands(measures: DataFrame) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """The measures with the ``key`` of their band, and for each of their log
    perplexities the middle of a row's language and half the width of its band: the
    distance from the middle falls with the root of the length, so its median times
    that root tells how a language scatters."""
    passed = measures.where(~base_failed())
    measures = measures.withColumn("key", ngram.language_key(ngram.languages(passed, LEAST_TEXTS)))
    passed = measures.where(~base_failed())
    root, bands = F.sqrt(F.greatest(F.col("n_words"), F.lit(1))), {}
    for c in ("log_ppl", "log_types"):
        centre = _by_language(_medians(passed, F.col(c)))
        scatter = _by_language({k: 1.4826 * v for k, v in _medians(passed, F.abs(F.col(c) - centre) * root).items()})
        bands[c] = centre, WIDTH * scatter / root + MARGIN
    return measures, bands


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``perplexity``
    (of a word), its bounds, and ``kept``.

    ``perplexity`` and its bounds are those of raw counts at the highest order; ``kept``
    asks for the bounds of the second form too. ``base_failed``: under 20 words, or over 30 % of them in repeated windows of
    eight words. Null or empty text: counts 0, perplexity 1, so it fails. Null
    and languages with few texts (``LEAST_TEXTS``) share a band. A very long text
    is read in pieces that overlap by a context, whole. Repeated rows are judged
    one by one (and alike); an empty table gives an empty result.
    """
    model = ngram.fit(docs, text_col, raw=True)
    measures = written(quality_measures(docs, model, id_col, text_col, lang_col), "quality")
    measures, bands = perplexity_bands(measures)
    centre, half = bands["log_ppl"]
    inside = [F.coalesce(F.abs(F.col(c) - m) <= h, F.lit(False)) for c, (m, h) in bands.items()]
    return measures.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & inside[0] & inside[1]).alias("kept"), F.exp("log_ppl").alias("perplexity"),
        F.exp(centre - half).alias("lower_bound"), F.exp(centre + half).alias("upper_bound"))
