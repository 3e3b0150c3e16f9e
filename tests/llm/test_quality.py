import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import boosting, ngram, quality_classifier, quality_rules
from quarry.llm.queries import QUERIES
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.helpers import DOCS, WORD, documents


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    lines, earlier = 0, set()
    for line in text.split("\n"):
        lines += bool(WORD.search(line)) and line in earlier
        earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def test_measures():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab #é\n\t\x0b\x1c "), p=[.2, .15, .3, .05, .1, .1, .025, .025, .025, .025], size=n))
             for n in rng.integers(0, 300, 300)] + [t for _, t, _, _ in DOCS]
    for t in texts:
        assert quality_rules.measure((t or "").encode()) == plain_measures(t)


def plain_model(texts, order=5):
    """Modified Kneser-Ney with dictionaries, over bytes; everything counts the different bytes before it."""
    before = {}
    for t in set(texts):
        s = b" " * order + t
        for i in range(order, len(s)):
            before.setdefault(tuple(s[i - order + 1:i + 1]), set()).add(s[i - order])
    counts = {order: {g: len(b) for g, b in before.items()}}
    for n in range(order - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    ds = {n: [0, *ngram.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4)))] for n, c in counts.items()}

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        below = {h: c for h, c in counts[n].items() if h[:-1] == g[:-1]}
        if not below:
            return p(g[1:])
        total = sum(below.values())
        rest = sum(ds[n][min(c, 3)] for c in below.values()) / total
        c = counts[n].get(g, 0)
        return (c - ds[n][min(c, 3)] if c else 0) / total + rest * p(g[1:])

    return p, counts[order]


TEXTS = ["hello there, the old bridge\nand 12 more", "the mill and the river", "", "Élan vital — the end", "漢字 the", "the mill and the river"]


@pytest.mark.parametrize("slice_rows", [None, 40])
def test_model_equals_plain_version(spark, monkeypatch, slice_rows):
    if slice_rows:
        monkeypatch.setattr(ngram, "SLICE_ROWS", slice_rows)
    model = ngram.fit(documents(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)] + [(9, None, "en", "a")]))
    assert (len(model.paths) > 5) == bool(slice_rows)
    data = [t.encode() for t in TEXTS]
    p, seen = plain_model(data)
    rng = np.random.default_rng(3)
    grams = [*seen, *(tuple(rng.choice(list(b" themiln\xc3z"), 5)) for _ in range(200)), (0,) * 5, (255,) * 5]
    codes = np.array([int.from_bytes(bytes(map(int, g)), "big") for g in grams], np.uint64)
    assert np.allclose(np.exp(model.log_p(codes)), [p(tuple(map(int, g))) for g in grams], rtol=1e-5)
    everything = model.log_p((codes[:1] >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64))
    assert abs(np.exp(everything).sum() - 1) < 1e-5
    padded = [b" " * 4 + t for t in data]
    want = [-sum(math.log(p(tuple(s[i - 4:i + 1]))) for i in range(4, len(s))) for s in padded]
    assert np.allclose(model.score(data), want, rtol=1e-5)


@pytest.mark.parametrize("small", [False, True])
def test_highest_order_counts_occurrences(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ngram, "SLICE_ROWS", 40)
        monkeypatch.setattr(ngram, "_KEPT_KEYS", 20)
    texts = TEXTS + ["the mill " * 9] * 3  # copies count as often as they occur
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)] + [(19, None, "en", "a")])
    data, raw = [t.encode() for t in texts], {}
    for s in (b" " * 4 + t for t in data):
        for i in range(4, len(s)):
            raw[tuple(s[i - 4:i + 1])] = raw.get(tuple(s[i - 4:i + 1]), 0) + 1
    types, seen = plain_model(data)
    d = [0, *ngram.discounts(*(sum(v == k for v in raw.values()) for k in (1, 2, 3, 4)))]

    def p(g):
        after = {h: c for h, c in raw.items() if h[:-1] == g[:-1]}
        if not after:
            return types(g[1:])
        total, c = sum(after.values()), raw.get(g, 0)
        return (c - d[min(c, 3)]) / total + sum(d[min(c, 3)] for c in after.values()) / total * types(g[1:])

    rows = {r["gram"]: r["raw"] for r in ngram.count_ngrams(docs, raw=True).collect()}
    assert rows == {int.from_bytes(bytes(g), "big"): c for g, c in raw.items()} and set(seen) == set(raw)
    model = ngram.fit(docs, raw=True)
    grams = [*raw, (0,) * 5, tuple(b" the!"), tuple(b"millx")]
    got = np.exp(model.log_p(np.array([int.from_bytes(bytes(g), "big") for g in grams], np.uint64)))
    assert np.allclose(got[:, 0], [types(g) for g in grams], rtol=1e-5) and np.allclose(got[:, 1], [p(g) for g in grams], rtol=1e-5)
    want = [-sum(math.log(p(tuple(s[i - 4:i + 1]))) for i in range(4, len(s))) for s in (b" " * 4 + t for t in data)]
    assert np.allclose(model.score(data)[:, 1], want, rtol=1e-5)
    # the perplexity of a text is by raw counts
    got = {r["doc_id"]: r["perplexity"] for r in quality_rules.quality_rules(docs).collect()}
    assert np.allclose([got[i] for i in range(len(data))], np.exp(want / np.maximum([len(t.split()) for t in data], 1)), rtol=1e-4)


def test_copies_count_once(spark):
    one, many = (ngram.count_ngrams(documents(spark, [(i, t, "en", "a") for i, t in enumerate(x)])) for x in (TEXTS, TEXTS * 30))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.repartition(3).collect()))


def test_long_texts_are_cut_without_a_seam(spark, monkeypatch):
    texts = [b"abc def " * 50, b"", b"x", "yz漢".encode() * 40]
    docs = documents(spark, [(i, t.decode(), "en", "a") for i, t in enumerate(texts)])
    model = ngram.fit(docs)
    join = lambda: [np.concatenate([g[a:z] for a, z in zip(begins, ends)]) for g, _, begins, ends in ngram._chunks(texts)]
    whole, scores, counts = np.concatenate(join()), model.score(texts), sorted(map(tuple, ngram.count_ngrams(docs).collect()))
    monkeypatch.setattr(ngram, "_STEP", 7)
    monkeypatch.setattr(ngram, "_CHUNK", 300)
    monkeypatch.setattr(ngram, "_KEPT_KEYS", 50)
    assert np.array_equal(np.concatenate(join()), whole) and np.allclose(scores, model.score(texts))
    assert sorted(map(tuple, ngram.count_ngrams(docs).collect())) == counts


def test_slices_find_what_they_have():
    rng = np.random.default_rng(4)
    for n in (1, 2, 1000):
        h = np.sort(rng.integers(0, 2**63, n))
        part = ngram.Slice(h, np.arange(n, dtype=np.float32))
        at, seen = part.find(h.view(np.uint64))
        assert seen.all() and (at == np.arange(n)).all()
        other = np.clip(rng.integers(0, 2**63, 500), h[0], h[-1])
        assert (part.find(other.view(np.uint64))[1] == np.isin(other, h)).all()


def test_bands_reject_both_sides(spark):
    rng = np.random.default_rng(5)
    words = "river mill bridge child mother light wind north supper home water stone field summer road".split()
    rows = [(i, " ".join(rng.choice(words, 150)), "en", "a") for i in range(80)]
    noise = "".join(chr(c) for c in rng.integers(33, 127, 900))
    rows += [(900, " ".join(noise[i:i + 9] for i in range(0, 900, 9)), "en", "a"), (901, "e ee eee eeee " * 4 + "e " * 300, "en", "a")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(80))
    assert got[900]["perplexity"] > got[900]["upper_bound"] and not got[900]["base_failed"] and not got[900]["kept"]
    assert got[901]["perplexity"] < got[901]["lower_bound"] and not got[901]["kept"]


def test_rules_edge_cases(spark):
    got = {}
    for r in quality_rules.quality_rules(documents(spark, clashing=True)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(DOCS)
    assert got[4][0]["n_words"] == 0 and got[4][0]["base_failed"] and got[4][0]["perplexity"] == 1
    assert got[9][0]["base_failed"] and got[9][0]["n_repeat_words"] == plain_measures(DOCS[8][1])[4]
    assert quality_rules.quality_rules(documents(spark, [])).collect() == []


def test_clean_documents_stay(spark):
    got = QUERIES["op3_perplexity_rules"](spark, SF_MID).where("NOT base_failed")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    share = {r["quality"]: r["k"] for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.98 and share[0] < share[1]


def test_languages_come_from_the_table(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LEAST_TEXTS", 20)
    rng = np.random.default_rng(9)
    few, many = ([x + y for x in "so ma ven ca pon stra lu".split() for y in "le re to sa te da".split()], ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(400)])
    rows = [(i, " ".join(rng.choice(few, 150)), "it", "a") for i in range(80)]
    rows += [(100 + i, " ".join(rng.choice(many, 150)), "pl", "a") for i in range(30)] + [(200, " ".join(few * 2), "xx", "a"), (201, " ".join(few * 2), None, "a")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert sum(got[100 + i]["kept"] for i in range(30)) >= 28 and sum(got[i]["kept"] for i in range(80)) >= 76
    assert got[0]["upper_bound"] < got[100]["perplexity"]
    assert got[200]["upper_bound"] == got[201]["upper_bound"] != got[0]["upper_bound"]


def test_most_junk_goes(spark):
    got = QUERIES["op3_perplexity_rules"](spark, SF_MID).where("NOT base_failed")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").where("quality = 0")
    assert got.join(labels, "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.2


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97

    def walk(row):  # one row, one node at a time
        total = trees.base
        for node in trees.roots:
            while not trees.leaf[node]:
                node = trees.left[node] + (row[trees.feature[node]] > trees.cut[node])
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:200]), [walk(r) for r in x[:200]])


def test_trees_without_two_labels():
    assert np.allclose(boosting.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))), 0.5)
    assert boosting.fit(np.ones((9, 3)), np.ones(9)).score(np.ones((1, 3)))[0] > 0.9
    same = boosting.fit(np.ones((40, 3)), np.arange(40) % 2.0)
    assert np.allclose(same.score(np.ones((1, 3))), 0.5)


def test_classifier_on_held_out_rows(spark):
    got = QUERIES["op4_boosted_quality"](spark, SF_MID)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())
    seen = got.where("held_out").join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id")
    assert seen.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_classifier_learns_only_from_its_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r["doc_id"]: r["score"] for r in quality_classifier.classify_quality(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_classifier_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (None, 1), (12, None)], "doc_id long, quality int")
    docs = documents(spark, clashing=True)
    got = quality_classifier.classify_quality(docs, labels).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify_quality(documents(spark, []), labels).collect() == []
    none = quality_classifier.classify_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    kept = quality_classifier.keep_quality(docs, labels, threshold=0.0)
    assert kept.schema == docs.schema and kept.count() == len(DOCS)
