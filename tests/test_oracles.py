"""All queries that have SQL, against it; and what every registered query must be."""

import pytest

import __spark_entry__ as entry_point
from docquarry.plans.catalogue import ORACLE_SQL, QUERIES
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 8 and [f.name for f in entry_point.entry(spark).schema] == ["document_id", "filename", "score", "vec_rank", "text_rank", "snippet"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
