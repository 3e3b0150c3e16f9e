import gzip
import hashlib
import os

import pytest
from pyspark.sql import types as T

from quarry.llm import warc
from quarry.session import scratch_path

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("html", T.StringType()), T.StructField("digest", T.StringType())])
LONG = "<p>é" * 400
PAGES = [(1, "http://a/1", LONG, "x"), (5, "http://a/5", LONG, "x"), (3, "http://a/3\r\nWARC-Type: x", LONG, "x"), (9, None, "short", "x"),
         (8, "http://a/8", "short", None), (7, "http://a/7", None, None), (6, "http://a/6", "", None), (None, "http://a/n", LONG, None),
         (5, "http://a/5", LONG, "x"), (12, "http://a/%41 b", "\r\n\r\nWARC/1.1\r\n" * 200, None), (-4, "u", "n" * 1000, None),
         (-3, "u", "n" * 1000, None), (30, "u", "m" * 999, None), (31, "u", "m" * 999, None)]


def local(folder):
    return folder.removeprefix("file:")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA)


def plain(rows):
    """What is read back, but for the urls."""
    by = {}
    for p, _, h, _ in rows:
        by.setdefault(h or "", []).append(p)
    want, held = [], set()
    for page, _, html, _ in rows:
        data = (html or "").encode()
        top = max((p for p in by[html or ""] if p is not None), default=None)
        revisit = len(data) >= 1000 and len(by[html or ""]) > 1 and top is not None and (page != top or (page, data) in held)
        held.add((page, data))
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(want, key=repr)


def test_round_trip(spark, pages):
    assert sorted(map(tuple, warc.archive(pages).drop("url").collect()), key=repr) == plain(PAGES)


def test_large_ids_beside_a_null(spark):
    rows = [(2**60 + 7 * i, f"u{i}", f"payload {i % 50} " * 200, None) for i in range(400)] + [(None, "n", "payload 3 " * 200, None), (-2**63, "l", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.archive(df, shard_bytes=5000).drop("url").collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("common", [None, 77])
def test_an_id_that_a_third_of_the_rows_have(spark, common):
    rows = [(common if i % 3 == 0 else i, f"u{i}", f"payload {i % 90} " * 100, None) for i in range(600)]
    folder = scratch_path(spark, "warc-hot")
    manifest = warc.write_warc(spark.createDataFrame(rows, SCHEMA), folder, shard_bytes=20_000).collect()
    got = warc.read_warc(spark, folder).collect()
    assert sorted((r["page_id"] or 0, r["payload_digest"]) for r in got) == sorted((p or 0, hashlib.sha1(h.encode()).hexdigest()) for p, _, h, _ in rows)
    if common is None:
        assert sorted(map(tuple, (r[:1] + r[2:] for r in got)), key=repr) == plain(rows)
    by_shard = {}
    for r in manifest:
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["records"]
    assert max(by_shard.values()) < 60  # of 600, though 200 rows have one id
    ids = [h for n, d in files(local(folder)).items() for h in gzip.decompress(d).split(b"\r\n") if h.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == 600


def test_urls_survive(spark, pages):
    urls = {r["page_id"]: r["url"] for r in warc.archive(pages).collect()}
    assert urls[12] == "http://a/%41 b" and urls[3] == "http://a/3\r\nWARC-Type: x"


def files(folder):
    return {f: open(os.path.join(folder, f), "rb").read() for f in sorted(os.listdir(folder)) if f.endswith(".gz")}


def test_same_files_however_dealt(spark, pages):
    found = []
    for n in (1, 7):
        folder = scratch_path(spark, "warc-test")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        manifest = warc.write_warc(pages.repartition(n), folder, shard_bytes=1000, roll_bytes=300)
        assert {r["name"] for r in manifest.collect()} == set(files(local(folder)))
        assert not os.path.exists(f"{local(folder)}/_temporary")
        found.append(files(local(folder)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] and len(found[0]) > 3


def test_files_roll_by_compressed_size(spark):
    rows = [(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 20, None) for i in range(200)]
    folder = scratch_path(spark, "warc-roll")
    for r in warc.write_warc(spark.createDataFrame(rows, SCHEMA), folder, roll_bytes=500).collect():
        data = open(f"{local(folder)}/{r['name']}", "rb").read()
        assert len(data) == r["bytes"] and hashlib.sha1(data).hexdigest() == r["sha1"]
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == r["records"]


def test_damage_is_noticed(spark, pages):
    folder = scratch_path(spark, "warc-damage")
    warc.write_warc(pages, folder)
    name, data = next((n, d) for n, d in files(local(folder)).items() if len(gzip.decompress(d)) > 3000)
    plain = gzip.decompress(data)
    at = plain.index(b"<p>") if b"<p>" in plain else plain.rindex(b"n")
    with open(f"{local(folder)}/{name}", "wb") as f:
        f.write(gzip.compress(plain[:at] + b"#" + plain[at + 1:]))
    with pytest.raises(Exception, match="damaged"):
        warc.read_warc(spark, folder).collect()


def test_empty_and_extra_columns(spark, pages):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).collect() == []
    more = pages.selectExpr("*", "1 AS page", "2 AS shard", "3 AS tag", "4 AS n_bytes", "5 AS refers", "6 AS holds")
    assert warc.archive(more).count() == len(PAGES)
