"""Registered plans against their DuckDB twins on the smallest tables."""

import duckdb
import pytest

from tests.conftest import SF_SMALL

from tools.oracle_check import TABLES, rows_of

import __spark_entry__ as E
from quarry.plans import registry

registry.load_all()
NAMES = sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, cur.fetchall())


def test_every_query_has_a_plan_and_sql_keys_subset():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "pred" in df.columns


@pytest.mark.parametrize("name", ["mdl_class_average", "agg_confusion", "agg_class_report", "agg_describe", "agg_basic_stats", "agg_covariance", "join_knn",
                                  "join_matmul", "join_similarity_matrix", "agg_silhouette", "str_pad_mask", "att_scaled_dot", "img_conv3x3",
                                  "prep_split_stratified", "win_best_so_far", "join_embedding_lookup", "str_embed_lookup"])
def test_plan_has_no_cross_join(spark, name):
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, SF_SMALL).explain()
    plan = buf.getvalue()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
