"""Edge cases of the text operators: accents, newlines, length-1 and empty
sequences, one-token rows in the bigram model."""

import math

from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import text as T


def test_chars_keep_accents_and_newlines(spark):
    df = spark.createDataFrame([("é\nA b",), ("",)], "t string")
    rows = [r[0] for r in df.select(TX.chars("t")).collect()]
    assert rows == [["é", "\n", "A", " ", "b"], []]
    cls = [r[0] for r in df.select(TX.char_classes("t")).collect()]
    assert cls == ["LSLSL", ""]


def test_words_and_sentences(spark):
    df = spark.createDataFrame([("Ça va? Oui. très bien! Fin",)], "t string")
    r = df.select(TX.words("t").alias("w"), TX.sentences("t").alias("s")).first()
    assert r["w"] == ["Ça", "va", "?", "Oui", ".", "très", "bien", "!", "Fin"]
    assert r["s"] == ["Ça va?", "Oui. très bien!", "Fin"]


def test_vocabulary_pad_first_and_sorted(spark):
    df = spark.createDataFrame([("ba",), ("c",)], "t string")
    v = sorted((r["idx"], r["token"]) for r in T.vocabulary(df, TX.chars("t")).collect())
    assert v == [(0, "<PAD>"), (1, "a"), (2, "b"), (3, "c")]


def test_padding_length_one_and_all_padding(spark):
    df = spark.createDataFrame([(0, [5], [1], 0), (1, [], [], 0), (2, [1, 2, 3], [0, 0, 2], 0)],
                               "k int, ids array<int>, labs array<int>, batch int")
    out = {r["k"]: r for r in T.pad_batch(df, "ids", "labs", "batch").collect()}
    assert out[0]["input_ids"] == [5, 0, 0] and out[0]["label_ids"] == [1, -100, -100]
    assert out[1]["pad_mask"] == [True, True, True]  # an all-padding row
    assert out[2]["pad_mask"] == [False, False, False]


def test_bigram_model_counts_one_token_rows_in_vocabulary(spark):
    df = spark.createDataFrame([(1, "abab"), (2, "z")], "id int, t string")
    pairs = T.pair_counts(df, "id", TX.chars("t"))
    m = {(r["a"], r["b"]): r["p"] for r in T.bigram_model(pairs).collect()}
    # V = {a, b, z} = 3; n(a)=2 bigrams (ab, ab), n(b)=1 (ba)
    assert math.isclose(m[("a", "b")], (2 + 1) / (2 + 3))
    assert math.isclose(m[("b", "a")], (1 + 1) / (1 + 3))
    ll = {r["id"]: r for r in T.bigram_loglik(pairs, "id", T.bigram_model(pairs)).collect()}
    assert ll[1]["n_bigrams"] == 3 and ll[2]["n_bigrams"] == 0 and ll[2]["loglik"] is None


def test_mlm_mask_is_seeded_and_consistent(spark):
    df = spark.createDataFrame([(1, 1, list(range(1, 200)))], "conv_id long, turn long, ids array<int>")
    inp, lab = T.mlm_mask(F.col("ids"), ["conv_id", "turn"], 0.15, 999)
    r = df.select(inp.alias("i"), lab.alias("l")).first()
    hidden = [k for k, v in enumerate(r["i"]) if v == 999]
    assert 10 < len(hidden) < 60
    assert all(r["l"][k] == k + 1 for k in hidden)
    assert all(r["l"][k] == -100 for k in range(199) if k not in hidden)


def test_pairs_are_counted_in_pieces_without_a_shuffle(spark, monkeypatch):
    from collections import Counter
    from quarry.operators import text as T
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scratch(df, name)

    scratch = T.scratch_table
    monkeypatch.setattr(T, "scratch_table", kept)
    monkeypatch.setattr(T, "_COUNTED_TOKENS", 5)
    texts = ["abab", "", None, "x", "é漢漢漢漢漢漢漢", "ab", "abab", "zz"]
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    got = Counter()
    for r in T.pair_counts(df, "id", TX.chars("text")).collect():
        got[r["id"], r["a"], r["b"]] += r["n"]
    want = Counter()
    for i, t in enumerate(texts):
        for a, b in zip(t or "", (t or "")[1:]):
            want[i % 7, a, b] += 1
        if len(t or "") < 2:
            want[i % 7, t or None, None] += 1
    assert got == want
    assert plans and not any("Exchange hash" in p for p in plans)


def test_merges_of_words_in_batches(spark, monkeypatch):
    from quarry.operators import text as T
    monkeypatch.setattr(T, "_WHOLE_PAIRS", 3)
    sym, at = T._split_words(["aaaaa", "aab", "b", "abcab"])
    names = T._Symbols()
    steps = names.steps([("a", "a"), ("aa", "a"), ("b", "c"), ("a", "bc"), ("a", "b"), ("ab", "c")])
    assert steps[3][2] == steps[5][2]  # a text is one symbol, however it was merged
    sym, at = T._merged(sym, at, steps)
    assert [[names.text(x) for x in sym[at == w].tolist()] for w in range(4)] == [["aa", "aaa"], ["aa", "b"], ["b"], ["abc", "ab"]]
    words = spark.createDataFrame([("aaaaa",), (None,), ("",), ("aab",), ("漢😀aa",)], "w string").coalesce(1)
    got = words.select("w", T.bpe_apply(words["w"], [("a", "a"), ("漢", "😀"), ("漢😀", "aa")]).alias("p")).collect()
    assert [r["p"] for r in got] == [["aa", "aa", "a"], None, [""], ["aa", "b"], ["漢😀aa"]]
    counts = spark.createDataFrame([("abab", 3), ("aab", 2), ("c", 9), ("bbbb", 1)], "word string, n long")
    assert T.bpe_learn(counts, 3, checkpoint_every=1) == T.bpe_learn(counts, 3) == [("a", "b", 8), ("ab", "ab", 3), ("b", "b", 3)]
