"""Every query that has one against its DuckDB equivalent; every other query runs."""

import pytest

from conftest import SF, rows_of
from docquarry.plans import answer_queries, catalogue, table_queries, text_queries

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows_of(got) == rows_of(duck.execute(ORACLES[name]).df())
    else:
        assert len(got.columns)


FIXTURES = {name: (q, m.FIXTURE_ORACLES[name]) for m in (answer_queries, table_queries, text_queries) for name, q in m.FIXTURE_QUERIES.items()}


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_typed_in_cases(spark, duck, name):
    query, oracle = FIXTURES[name]
    assert rows_of(query(spark, SF).toPandas()) == rows_of(duck.execute(oracle).df())


def test_entry(spark):
    import __spark_entry__

    assert {"question_id", "answer", "answer_route"} <= set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
