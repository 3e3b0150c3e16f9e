from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import packing
from quarry.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, WORD, documents


def plain_pack(sizes, lengths, overhead):
    """The same rule, looking at every bin each time."""
    bins, out = [], [None] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for n, i in enumerate(order):
        size = sizes[i]
        fits = [(c - used, b) for b, (c, used) in enumerate(bins) if c - used >= size and c > used]
        if fits:
            b = min(fits)[1]
        else:
            rest = [sizes[k] for k in order[n + 1:]]
            cost = lambda c: ((c + overhead) / (size + min(c - size, sum(x for x in rest if x <= c - size))), c)
            bins.append((min((c for c in lengths if c >= size), key=cost), 0))
            b = len(bins) - 1
        c, used = bins[b]
        out[i], bins[b] = (b, used), (c, used + size)
    return [(b, at, min(c for c in lengths if c >= bins[b][1])) for b, at in out]


def test_equals_plain_version():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = tuple(sorted(rng.choice(np.arange(8, 80), 3, replace=False).tolist()))
        sizes = rng.integers(1, lengths[-1] + 1, rng.integers(1, 80))
        assert packing.pack(sizes, lengths, 4) == plain_pack(sizes.tolist(), lengths, 4)
    assert packing.pack(np.zeros(0, np.int64)) == []


def sound(rows, docs, lengths=packing.LENGTHS):
    """Every token of every row is packed once, and no two overlap."""
    want = sorted(((i, len(WORD.findall(t or "")) + 1) for i, t in docs), key=repr)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
        bins[r["shard"], r["bin"]].append((r["offset"], r["n_tokens"], r["bin_length"]))
    assert sorted(((i, n) for i, x in pieces.items() for n in [sum(k for _, k in x)]), key=repr) == sorted(
        {i: (i, sum(n for j, n in want if j == i)) for i, _ in want}.values(), key=repr)
    for x in bins.values():
        at = 0
        for offset, n, _ in sorted(x):
            assert offset == at
            at += n
        assert {c for _, _, c in x} == {min(c for c in lengths if c >= at)}


def test_edge_cases(spark):
    docs = documents(spark, clashing=True)
    for lengths in (packing.LENGTHS, (8, 32)):
        rows = packing.best_fit_pack(docs, lengths=lengths, shard_pieces=10).collect()
        sound(rows, [(i, t) for i, t, _, _ in DOCS], lengths)
    assert packing.best_fit_pack(documents(spark, [])).collect() == []


def test_repeated_rows_are_dealt_over_shards(spark):
    docs = documents(spark, [(1, "a b c", "en", "a")]).crossJoin(spark.range(400)).drop("id")
    rows = packing.best_fit_pack(docs, shard_pieces=50)
    assert rows.count() == 400 and max(r["count"] for r in rows.groupBy("shard").count().collect()) < 100


def test_query_fills_its_bins(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = QUERIES["op10_best_fit_packing"](spark, SF_SMALL)
    sound(rows.collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    used = rows.groupBy("shard", "bin", "bin_length").agg(F.sum("n_tokens").alias("n")).agg(F.sum("n") / F.sum("bin_length")).first()[0]
    assert used > 0.95
