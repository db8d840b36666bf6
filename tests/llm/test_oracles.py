"""Queries with SQL give the rows that DuckDB gives; all queries run and give the columns asked for."""

import pytest

from tests.oracle import rows_of, rows_of_sql
from wardflow.llm import queries

COLUMNS = {
    "p1_found": ["first_id", "copy_id"], "p2_found": ["first_id", "member_id"], "p3_found": ["content_id"], "p4_found": ["tbl", "id_a", "id_b"], "p5_found": ["id_a", "id_b"],
    "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    columns, expected = rows_of_sql(sf, queries.SQL[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    assert df.count() > 0
