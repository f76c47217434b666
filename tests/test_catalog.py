"""Every core query runs over the smallest tables and agrees with its SQL."""

import decimal
import glob
import os

import pytest

from chaptermill.plans import catalog


def shown(v):
    return "∅" if v is None else str(v) if isinstance(v, bool) else f"{float(v):.9g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def test_each_query_has_sql_or_a_reason():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) >= 40


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name in catalog.oracle_sql():
        result = duck.sql(catalog.oracle_sql()[name])
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        assert got == sorted(tuple(shown(r[i]) for i in at) for r in result.fetchall())


def test_row_wise_queries_do_not_shuffle(spark, data):
    for name in ("renumbered_documents", "chapter_pages", "all_warnings", "image_paths", "heading_numbers"):
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan, name


def test_whole_jobs(spark, data):
    run = lambda name: catalog.queries()[name](spark, data)
    assert run("parsed_both_ways").count() == 2 * run("parsed_answers").count()
    chapters = spark.read.parquet(f"{data}/chapter.parquet").filter("chapter_html is not null")
    assert run("page_fold").count() == chapters.select("chapter_id").distinct().count() > run("anchor_fold").count()
