"""Every registered query that has SQL gives the same rows as the SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from matrella.operators import core
from tests.oracle import connection, rows

Q, SQL = entry.queries(), entry.oracle_sql()
#: queries of the optional subpackage are tested beside it
HERE = sorted(n for n in SQL if Q[n].__module__ != "matrella.llm.queries")


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", HERE)
def test_query_equals_sql(spark, sf, duck, name):
    got, want = Q[name](spark, sf).toPandas(), duck.execute(SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["result_order_row_whole", "result_order_column_whole"])
def test_result_order_of_the_whole_matrix(spark, sf, duck, monkeypatch, name):
    """Numbered in several ranges, no task sorts all cells; rows come in the order of their places."""
    monkeypatch.setattr(core, "NUMBERING_STEP", 1000)
    got = Q[name](spark, sf).toPandas()
    assert len(got) > 5000 and got["place"].tolist() == list(range(1, len(got) + 1))
    assert rows(got) == rows(duck.execute(SQL[name]).fetch_df())


@pytest.mark.parametrize("name", ["stored_coos", "stored_series", "stored_sparse_ordered"])
def test_no_cells_come_to_the_driver(spark, sf, duck, monkeypatch, name):
    """The whole matrix stays in tasks: a driver that can't fetch rows makes the same result."""

    def refused(*_: object, **__: object) -> None:
        raise MemoryError("rows fetched by the driver")

    with monkeypatch.context() as m:
        for way in ("toArrow", "toPandas", "toLocalIterator"):
            m.setattr(type(spark.range(1)), way, refused)
        got = Q[name](spark, sf)
    got = got.toPandas()
    assert len(got) > 5000 and rows(got) == rows(duck.execute(SQL[name]).fetch_df())


def test_sql_only_for_queries():
    assert set(SQL) <= set(Q)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() >= 0
