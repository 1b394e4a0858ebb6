"""Every linkage query agrees with its SQL on the small tables; queries without SQL run and have stable columns."""

from __future__ import annotations

import pytest

from matchloom.queries import QUERIES, SQL

from .conftest import SF

# Long model fits are covered by test_models.
SLOW = {"flagship_link", "stacked_model", "filter_model"}


def _rows(columns, rows):
    return sorted((tuple(r) for r in rows), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
