"""Queries that SQL can express, against it, on the smallest tables."""

import pytest

from millrace.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, same):
    same(queries.queries()[name], SQL[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.NAMES) == list(range(1, 11))
