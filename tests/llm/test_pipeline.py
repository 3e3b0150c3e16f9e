import corpus_pipeline
from quarry.llm import packing, secrets
from quarry.llm.automaton import Scanner
from quarry.llm.common import read, written
from tests.conftest import SF_SMALL
from tests.llm.helpers import classes, documents, fingerprint
from tests.llm.test_native import plain_lines
from tests.llm.test_packing import sound
from tests.llm.test_secrets import plain


def test_stages_against_plain_versions(spark):
    docs = read(spark, SF_SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = written(stage(spark, docs, SF_SMALL), "stage")
        rows = out.collect()
        if name != "best-fit packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r for r in rows}
            assert len(after) == len(rows) and set(after) <= set(before)
        if name == "quality classifier":
            quality = {r["doc_id"]: r["quality"] for r in read(spark, SF_SMALL, "labels").collect()}
            good, bad = ([i for i in before if quality.get(i) == k] for k in (1, 0))
            assert sum(i in after for i in good) >= 0.97 * len(good) and sum(i in after for i in bad) <= 0.2 * len(bad)
            assert all(after[i] == before[i] for i in after)
        elif name == "line dedup":
            assert {i: t for i, _, _, t in plain_lines([(i, r["text"]) for i, r in before.items()])} == {i: r["text"] for i, r in after.items()}
        elif name == "simhash near-dedup":
            ids = sorted(before)
            of = classes([fingerprint(before[i]["text"]) for i in ids])
            assert set(after) == {ids[c] for c in of}
        elif name == "secret scan":
            scanner = Scanner(secrets.RULES)
            assert set(after) == set(before)
            for i, r in after.items():
                assert not [x for x in plain(r["text"].encode())] and r["n_chars"] == len(r["text"])
                if not scanner.scan(before[i]["text"].encode()):
                    assert r == before[i]
        else:
            sound(rows, [(i, r["text"]) for i, r in before.items()])
        docs = out


def test_stages_take_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1), (9, 1)], "doc_id long, quality int")
    for rows in (None, []):
        docs = documents(spark) if rows is None else documents(spark, rows)
        folder = str(tmp_path / str(rows is None))
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == packing.best_fit_pack(docs).columns and bool(out.count()) == (rows is None)
