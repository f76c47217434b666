"""Every query of the training-data operators runs over the smallest tables; those with SQL agree with it."""

import glob
import os

import pytest

from chaptermill.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, data, name):
    if name == "p6_ids" and not os.path.isdir("/opt/tokenizers"):
        pytest.skip("no vocabulary files here")
    df = q.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    if name in q.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for path in glob.glob(f"{data}/*.parquet"):
            con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
        result = con.sql(q.oracle_sql()[name])
        assert list(result.columns) == df.columns and sorted(rows) == sorted(result.fetchall())


def test_schemas(spark, data):
    want = {
        "p1_found": "heading_id bigint, title_id int", "p2_found": "chapter_id bigint", "p3_found": "response_id bigint, defect string", "p4_found": "response_id bigint", "p5_found": "manifest_id bigint, field string",
        "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "doc_id bigint, item_id int", "p8_found": "doc_id bigint, lang string",
    }
    for name, schema in want.items():
        assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.queries()[name](spark, data).schema) == schema


def test_core_does_not_need_this_package():
    core = [p for p in glob.glob(os.path.join(os.path.dirname(q.__file__), "..", "**", "*.py"), recursive=True) if f"{os.sep}llm{os.sep}" not in os.path.normpath(p)]
    assert core and not any("llm" in line and "import" in line for p in core for line in open(p, encoding="utf-8"))
