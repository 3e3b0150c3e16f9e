from itertools import combinations

import numpy as np
import pytest

from quarry.llm import simhash
from quarry.llm.components import components
from quarry.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, classes, documents, fingerprint


def test_positions_cover_all_agreements():
    assert all(any(set(q) <= set(five) for q in simhash.POSITIONS) for five in combinations(range(8), 5))


def test_fingerprints():
    for _, text, _, _ in DOCS:
        assert simhash.fingerprint((text or "").encode()) == fingerprint(text)


def groups_of(spark, values, block=None, monkeypatch=None):
    if block:
        monkeypatch.setattr(simhash, "BLOCK", block)
    fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in set(values)], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(fps)).collect()}
    return {v: roots.get(int(np.uint64(v).view(np.int64)), int(np.uint64(v).view(np.int64))) for v in values}


@pytest.mark.parametrize("block", [None, 4])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    values = []
    for _ in range(25):
        centre = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 14))):  # random walks: groups that hold together in steps
            values.append(centre)
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                centre ^= 1 << int(b)
    values = sorted(set(values))
    got, want = groups_of(spark, values, block, monkeypatch), classes(values)
    for i, j in combinations(range(len(values)), 2):
        assert (got[values[i]] == got[values[j]]) == (want[i] == want[j])


def test_dense_list_is_joined_across_blocks(spark, monkeypatch):
    values = [0xABCD000000000000 + i for i in range(300)]  # one long list of near copies
    assert len(set(groups_of(spark, values, 16, monkeypatch).values())) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(-5, -9), (7, 7), (3, 1), (1, 3), (500, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {-5: -9, -9: -9}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_and_edge_cases(spark):
    rows = simhash.simhash_groups(documents(spark, clashing=True)).collect()
    fps = [fingerprint(t) for _, t, _, _ in DOCS]
    of = classes(fps)
    least = {c: min((DOCS[i][0] for i in range(len(DOCS)) if of[i] == c and DOCS[i][0] is not None), default=None) for c in of}
    want = sorted(((d[0], f"{f:016x}", least[c]) for d, f, c in zip(DOCS, fps, of)), key=repr)
    assert sorted((tuple(r) for r in rows), key=repr) == want
    assert simhash.simhash_groups(documents(spark, [])).collect() == []


def test_one_of_each_group_stays(spark):
    docs = documents(spark, clashing=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fps = [fingerprint(t) for _, t, _, _ in DOCS]
    of = classes(fps)
    want = []
    for c in set(of):
        ids = [DOCS[i][0] for i in range(len(DOCS)) if of[i] == c]
        want.append(min((i for i in ids if i is not None), default=None))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    fps = [fingerprint(r["text"]) for r in docs]
    want = {r["doc_id"]: (f"{f:016x}", docs[c]["doc_id"]) for r, f, c in zip(docs, fps, classes(fps))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash_groups"](spark, SF_SMALL).collect()} == want
