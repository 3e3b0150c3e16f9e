import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quarry.llm import bpe
from quarry.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, documents


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    ranks = bpe.load_ranks(public_tokenizers.path(request.param))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), plain


def test_random_texts(pair):
    encoder, plain = pair
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("aabbethinr \n'sß漢😀12.,\t ") for _ in range(rng.randint(0, 80)))
        ids = encoder.encode(text)
        assert ids == plain.encode_ordinary(text) and encoder.decode(ids) == text.encode()


def test_very_long_pre_token(pair):
    encoder, plain = pair
    rng = random.Random(1)
    for text in ("a" * 100_000, "".join(rng.choice("theinrsao") for _ in range(100_000))):
        assert encoder.encode(text) == plain.encode_ordinary(text)


def test_memory_of_pre_tokens_is_bounded(pair, monkeypatch):
    encoder, plain = pair
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = " ".join(f"wordy{i % 9}x" for i in range(60))
    assert encoder.encode(text) == plain.encode_ordinary(text)
    few = bpe.Encoder(encoder.ranks, public_tokenizers.PATTERN)
    few.encode(" ".join(f"w{i}q" for i in range(50)))
    assert len(few.young) <= 3 and len(few.old) <= 3


def test_edge_cases_and_round_trip(spark, pair):
    encoder, plain = pair
    docs = documents(spark, clashing=True)
    out = bpe.encode_texts(docs, encoder.ranks, public_tokenizers.PATTERN)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text, _, _ in DOCS:
        ids = plain.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert any((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want and r["ids"] == ids for r in got[i])
    back = bpe.decode_ids(out, encoder.ranks)
    assert sorted(bytes(r["text"]) for r in back.collect()) == sorted((t or "").encode() for _, t, _, _ in DOCS)
    assert bpe.encode_texts(documents(spark, []), encoder.ranks, public_tokenizers.PATTERN).collect() == []


def test_query(spark):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op5_rank_queue_bpe"](spark, SF_SMALL).collect():
        ids = plain.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
