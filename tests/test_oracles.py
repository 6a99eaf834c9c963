"""Every core query against its SQL."""

import pytest

from fogline import queries as core
from tests.conftest import SMALL, same_as_sql


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    same_as_sql(core.QUERIES[name](spark, SMALL), duck(SMALL).sql(core.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql_agrees_with_itself(spark, name):
    runs = [sorted(map(str, core.QUERIES[name](spark, SMALL).collect())) for _ in range(2)]
    assert runs[0] and runs[0] == runs[1]


def test_entry_point_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5


def test_entry_point_works_without_the_corpus_operators(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_corpus", lambda: None)
    assert set(entry.queries()) == set(core.QUERIES)
