import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import cuckoo
from tests.llm.helpers import DOCS, documents, rows_of


def hashes_of(n, seed=0):
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64, endpoint=False)


def test_filter_never_says_no_wrongly_and_forgets_what_is_deleted():
    h = hashes_of(20_000)
    f = cuckoo.CuckooFilter(len(h))
    assert f.insert(h[:10_000]) and f.insert(h[10_000:]) and f.contains(h).all()
    assert f.contains(hashes_of(20_000, 1)).mean() < 0.01
    f.delete(h[::2])
    assert f.contains(h[1::2]).all() and f.contains(h[::2]).mean() < 0.01
    assert f.insert(h[::2]) and f.contains(h).all()
    assert (f.table != 0).sum() == len(h)
    again = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    assert again.contains(h).all()


def test_overflow_is_told_and_resizing_holds_all():
    h = hashes_of(5000)
    f = cuckoo.CuckooFilter(100)
    assert not f.insert(h)
    assert cuckoo.CuckooFilter.holding(h, 100).contains(h).all()


def test_shard_resizes_from_stored_keys_and_tells_wrong_hits():
    shard = cuckoo.Shard(4)
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(3000)), "V32")
    for a in range(0, 3000, 100):
        part = digests[a:a + 100]
        shard.add(part, np.ones(100, np.int64), np.ones(100, bool), np.arange(a, a + 100), np.zeros(100, np.int64))
    assert shard.resized > 0 and len(shard) == 3000
    # the same filter bits, but another content
    twin = digests[0].tobytes()[:8] + b"\0" * 24
    shard.add(np.frombuffer(twin, "V32"), np.ones(1, np.int64), np.ones(1, bool), np.array([7]), np.zeros(1, np.int64))
    assert len(shard) == 3001


def plain(rows):
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[t or ""].append(i)
    top = {t: max((i for i in x if i is not None), default=None) for t, x in ids.items()}
    return sorted(((i, top[t or ""], len(ids[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=repr)


def same(got, rows):
    got = got.collect()
    assert sorted(((r[0], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == plain(rows)
    for sha in {r["text_sha256"] for r in got}:
        kept = [r for r in got if r["text_sha256"] == sha and r["kept"]]
        assert len(kept) == 1 and kept[0][0] == kept[0]["keep_id"]


def test_edge_cases(spark):
    same(cuckoo.exact_dedup(documents(spark, clashing=True)), DOCS)
    assert cuckoo.exact_dedup(documents(spark, [])).collect() == []
    kept = cuckoo.keep_one(documents(spark, clashing=True))
    assert kept.columns == documents(spark, clashing=True).columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted({t or "" for _, t, *_ in DOCS})


@pytest.mark.parametrize("limit", [None, 5])
def test_many_copies(spark, monkeypatch, limit):
    if limit:
        monkeypatch.setattr(cuckoo._gathered, "__defaults__", (limit,))
    rows = [(i, "the same" if i % 3 == 0 else f"text {i % 200}", "en", "a") for i in range(900)]
    same(cuckoo.exact_dedup(documents(spark, rows).repartition(7)), rows)


def test_insert_and_delete(spark):
    first = [(i, f"text {i % 40}", "en", "a") for i in range(100)]
    more = [(100 + i, f"text {30 + i}", "en", "a") for i in range(30)] + [(None, "text 1", None, None)]
    index = cuckoo.CuckooIndex.of(documents(spark, first)).insert(documents(spark, more))
    found = lambda index: {r["sha"].hex(): (r["n"], r["id"]) for r in index.groups.collect()}
    want = lambda rows: {x[3]: (x[2], x[1]) for x in plain(rows)}
    assert found(index) == want(first + more)
    gone = {0, 40, 80, 99, 129, 77}  # all rows of one text, the largest of another, a text with one row
    rest = [r for r in first + more if r[0] not in gone]
    smaller = index.delete(spark.createDataFrame([(i,) for i in gone] + [(None,), (9999,)], "doc_id long"))
    assert found(smaller) == want(rest)
    assert smaller.lookup(index.members).where(F.col("sha") == F.unhex(F.sha2(F.lit("text 0").cast("binary"), 256))).count() == 0
    filters = {r["shard"]: cuckoo.CuckooFilter.from_bytes(bytes(r["sha"])) for r in smaller.state.where("kind = 0").collect()}
    assert sum((f.table != 0).sum() for f in filters.values()) == len(want(rest))  # the deleted left the filters
    new = [(500 + i, f"new {i}", "en", "a") for i in range(80)]
    again = smaller.insert(documents(spark, [r for r in first + more if r[0] in gone] + new), shard_keys=1)  # deals anew over more shards
    assert again.shards > smaller.shards and found(again) == want(first + more + new)
    assert found(index) == want(first + more)  # the old one is as it was
    assert rows_of(again.lookup(again.members).groupBy("n").count())
