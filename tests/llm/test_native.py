"""Line dedup and chat formatting."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import chat, line_dedup
from quarry.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.helpers import AZ, DOCS, documents


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(AZ)


def plain_lines(docs, threshold=10):
    """(n_lines, n_dropped, text) of each document."""
    seen = defaultdict(set)
    for i, t, *_ in docs:
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    gone = {k for k, ids in seen.items() if k and len(ids) >= threshold}
    out = []
    for i, t, *_ in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def test_lines_and_edge_cases(spark):
    docs = documents(spark, clashing=True)
    got = line_dedup.drop_shared_lines(docs, counts=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_lines(DOCS)
    assert any(r[2] for r in plain_lines(DOCS))
    out = line_dedup.drop_shared_lines(docs, length_col="n_chars")
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[4]["text"] is None and rows[20]["text"] == "own line 0\nÉcole 0\n" .rstrip("\n")
    assert rows[20]["n_chars"] == len(rows[20]["text"])
    assert line_dedup.drop_shared_lines(documents(spark, [])).collect() == []


def test_random_lines(spark):
    rng = random.Random(11)
    parts = ["a", "A ", " a\t", "b", "É", "é", "", " ", " ", "K", "K", "long " * 50]
    rows = [(i % 37, "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 9))), "en", "a") for i in range(60)]
    got = line_dedup.drop_shared_lines(documents(spark, rows), threshold=12, counts=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_lines(rows, 12)


def test_a_document_can_lose_everything(spark):
    rows = [(i, "same", "en", "a") for i in range(12)]
    got = line_dedup.drop_shared_lines(documents(spark, rows)).collect()
    assert len(got) == 12 and {r["text"] for r in got} == {""}


def test_native_plans(spark, capsys):
    for name in ("op7_chat_format", "op8_line_dedup"):
        plan = plan_of(QUERIES[name](spark, SF_SMALL), capsys)
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_line_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op8_line_dedup"](spark, SF_SMALL).collect()}
    for i, n, dropped, text in plain_lines(docs):
        assert got[i] == (i, n, dropped, hashlib.sha256(text.encode()).hexdigest())


SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = (
    [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3)] + [(2, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(5)]
    + [(3, i + 7, "user" if i % 2 else "assistant", f"t{i}") for i in range(5)]          # as 2, numbered otherwise
    + [(4, 0, "assistant", "t0"), (4, 1, "user", "other")] + [(5, 0, None, None)] + [(6, 0, None, "")] + [(7, 0, None, None), (7, 1, "user", "<|im_end|>x")]
    + [(8, 0, "user", "again"), (8, 0, "user", "again")] + [(9, None, "user", "again"), (9, 0, "user", "more")] + [(12, 4, "user", x) for x in "zyxwv"] + [(None, 0, "user", "lost"), (None, 1, "user", "id")]
    + [(10, i, "user", f"n{i}") for i in range(700)] + [(11, i, "user", f"n{i}") for i in range(300)]
)


def text_hash(t):
    h = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain_chats(turns):
    seqs = defaultdict(list)
    for c, i, r, t in set(turns):
        seqs[c].append(((i is not None, i or 0), (r is not None, r or ""), text_hash(t), (t is not None, t or "")))
    seqs = {c: tuple((x[1], x[3]) for x in sorted(s)) for c, s in seqs.items()}
    out = []
    for seq in set(seqs.values()):
        if any(len(s) > len(seq) and s[:len(seq)] == seq for s in seqs.values()):
            continue
        same = [c for c, s in seqs.items() if s == seq]
        text = "".join(f"<|im_start|>{r[1] if r[0] else 'unknown'}\n{t[1].replace('<|', '<').replace('|>', '>')}<|im_end|>\n" for r, t in seq)
        out.append((min((c for c in same if c is not None), default=None), len(seq), len(same), text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [128, 2])
def test_chats(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    turns = spark.createDataFrame(TURNS, SCHEMA).selectExpr("*", "1 AS conv", "2 AS seg", "3 AS i", "4 AS p", "5 AS n_turns")
    assert sorted((tuple(r) for r in chat.chat_formatted(turns).collect()), key=repr) == plain_chats(TURNS)


def test_chat_empty(spark):
    assert chat.chat_formatted(spark.createDataFrame([], SCHEMA)).collect() == []


def test_random_chats(spark):
    rng = random.Random(2)
    turns = [(c, i, rng.choice(["user", "assistant"]), rng.choice("ab")) for c in range(120) for i in range(rng.randint(1, 5))]
    assert sorted((tuple(r) for r in chat.chat_formatted(spark.createDataFrame(turns, SCHEMA)).collect()), key=repr) == plain_chats(turns)


def test_chat_query_keeps_every_turn(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op7_chat_format"](spark, SF_SMALL)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_chats(turns)
    assert got.agg(F.sum("n_turns")).first()[0] <= len(turns)
