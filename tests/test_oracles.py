"""Every query of the library against its SQL, and those without SQL for a stable schema."""

import pytest

from tests.support import assert_same
from tidemark.plans import fencing, filing, reading, relational, repair, spending, storing, streams

FAMILIES = (fencing, repair, reading, storing, spending, relational, streams, filing)
QUERIES = {n: q for f in FAMILIES for n, q in f.R.queries.items()}
SQL = {n: s for f in FAMILIES for n, s in f.R.sql.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, data, name):
    assert_same(QUERIES[name](spark, data).toPandas(), duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, data, name):
    frame = QUERIES[name](spark, data).toPandas()
    assert len(frame.columns) and len(frame), "the query gives no rows"


def test_names_are_unique():
    assert len(QUERIES) == sum(len(f.R.queries) for f in FAMILIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
