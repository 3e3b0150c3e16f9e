import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import automaton, secrets
from quarry.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, documents

PLAIN = [(re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
         (re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def plain(data):
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(PLAIN) for m in p.finditer(data) if good(m))


@pytest.fixture(scope="module")
def scanner():
    return automaton.Scanner(secrets.RULES)


def test_random_texts_match_the_expressions(scanner):
    rng = random.Random(3)
    parts = ["password", "passwd", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123",
             "abcdef0123456789", "0a1b", "x", "-", "é", "ſecret", "\n", ".", "gh", "p_", "eyJ"]
    for _ in range(5000):
        data = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))).encode()
        assert plain(data) == [x for x in scanner.scan(data) if x[1] < 3]


def test_general_rules_are_leftmost_longest():
    rules = [automaton.Rule("k", p) for p in (r"ab*c|b", r"(x|xy)z?", r"[^a]a{2,3}")]
    scan = automaton.Scanner(rules).scan
    assert [s for s in scan(b"abbbc bb") if s[1] == 0] == [(0, 0, 5), (6, 0, 7), (7, 0, 8)]
    assert [s for s in scan(b"xyxyzx") if s[1] == 1] == [(0, 1, 2), (2, 1, 5), (5, 1, 6)]
    assert [s for s in scan(b"caaaa baa") if s[1] == 2] == [(0, 2, 4), (6, 2, 9)]


def test_minimised(scanner):
    one = automaton.Scanner([automaton.Rule("k", "ab|cb")])
    assert one.n_states == 3  # the start, one letter read, both


def test_long_runs_take_linear_time(scanner):
    data = b"a1" * 500_000
    assert scanner.scan(data) == [(0, 2, len(data))]


def test_spans_and_edge_cases(spark):
    got = {}
    for r in secrets.scan_secrets(documents(spark, clashing=True)).collect():
        got.setdefault(r["doc_id"], []).append([tuple(s) for s in r["secrets"]])
    assert got[4] == got[5] == got[6] == [[]]
    assert got[13] == [[("assign", 0, 22), ("access", 24, 44), ("hex", 45, 93)]] * 2
    assert len(got[None]) == 2 and sum(map(len, got.values())) == len(DOCS)
    assert secrets.scan_secrets(documents(spark, [])).collect() == []


def test_code_points(spark):
    docs = documents(spark, [(1, "é😀 token=abcdefgh1 ü", "en", "a")])
    assert [tuple(s) for s in secrets.scan_secrets(docs).first()["secrets"]] == [("assign", 3, 18)]


def test_redaction(spark):
    out = secrets.redact_secrets(documents(spark, clashing=True), length_col="n_chars")
    assert out.columns == documents(spark, clashing=True).columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[13]["text"] == '[assign]" [access] [hex]' and rows[13]["n_chars"] == 24
    assert rows[4]["text"] is None and rows[4]["n_chars"] is None and rows[1]["text"] == DOCS[0][1]


def test_query_equals_plain_version(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for r in QUERIES["op1_secret_scan"](spark, SF_SMALL).collect():
        want = plain(docs[r["doc_id"]].encode())
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in want) for k in range(3))
    assert QUERIES["op1_secret_scan"](spark, SF_SMALL).agg(F.sum("n_assign")).first()[0] >= 0
