import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import fim
from tests.llm.helpers import DOCS, documents, rows_of

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    units = TOKEN.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out, chars = "plain", text, (None, None)
    else:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "spm" if h[3] % 100 < 80 else "psm"
        out, chars = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    return doc_id, n, form, *chars, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), out


EXTRA = [(k, t, "en", "a") for k, t in enumerate([" lead and trail \n\t", "has <S> inside", "no<P", "x<M", "\x0b\x0c", "é😀 漢字\r\nend", "a " * 50_000], 100)] + \
        [(1000 + i, f"one two three <{i} four\n\nfive 六 ", "en", "a") for i in range(60)]


@pytest.mark.parametrize("rows", [DOCS + EXTRA, []])
def test_documents(spark, rows):
    got = rows_of(fim.fim_documents(documents(spark, rows, clashing=True)))
    assert got == sorted((plain(r[0], r[1]) for r in rows), key=repr)
    if rows:
        assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_without_output(spark):
    got = fim.fim_documents(documents(spark), with_output=False)
    assert "output" not in got.columns and rows_of(got) == sorted((plain(r[0], r[1])[:-1] for r in DOCS), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab<>PSM é漢 \n\t\x0b"), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_round_trip(text, h):
    data = text.encode()
    assert [text.encode()[a:b].decode() for a, b in zip([0, *fim.token_ends(data)], fim.token_ends(data))] == TOKEN.findall(text)
    table, form, *_ = fim.transform(data, h, rate=100)
    assert fim.restored(table.to_bytes(), form).to_bytes() == data
    if form != "plain":
        assert table.restore(fim.ORDERS[form]).to_bytes() == data
        assert table.sha256() == hashlib.sha256(table.to_bytes()).hexdigest()


def test_cuts_split_descriptors():
    table = fim.PieceTable(b"abcdef").cut(2, 4).cut(0, 3, 6)
    assert b"".join(table.parts()) == b"abcdef" and [p.length for p in table.pieces] == [0, 2, 1, 1, 2, 0]
