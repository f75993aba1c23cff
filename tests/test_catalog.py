"""Every query against its SQL on the smallest tables, as the driver does on larger ones."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lodestrata.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got
    if sql := catalog.oracle_sql().get(name):
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """Top-k stays bounded, filters and columns reach the scan, caps are pushed below the exchange."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    knn = plan(catalog.knn_l2(spark, SF))
    assert "TakeOrderedAndProject" in knn and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in knn
    assert "WindowGroupLimit" in plan(catalog.cap_chunks(spark, SF))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,5)]" in plan(catalog.vector_delete(spark, SF))
    assert "Exchange" not in plan(catalog.chunk_plain_text(spark, SF))


def test_steps_run_once(spark):
    """Code is cut once, not again for a filter; trimming tests no pattern on whole texts; runs are shuffled once and joined with nothing."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    code = plan(catalog.code_sections(spark, SF))
    assert code.count("ArrowEvalPython") == 1 and code.count("regexp_replace") < 10
    pages = plan(catalog.pdf_sections(spark, SF))
    assert "Join" not in pages and pages.count("Exchange hashpartitioning") == 2  # the other is of the query's own running heads
