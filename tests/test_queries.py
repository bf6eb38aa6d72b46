"""Every query with SQL against DuckDB on the smallest tables; the others have rows."""

from __future__ import annotations

import pytest

from lodestone.plans import catalogue
from tests.oracle import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    assert difference(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_cer_by_plain_loop(spark, con):
    heads = dict(con.execute("SELECT item_id, text FROM benchmark").fetchall())
    expected = {(i, edits(t, heads[i + 1]), round(edits(t, heads[i + 1]) / max(1, len(t)), 4)) for i, t in heads.items() if i + 1 in heads}
    assert {(x.item_id, x.edits, x.cer) for x in catalogue.QUERIES["cer"](spark, SF).collect()} == expected
