"""Every registered query runs, and equals its SQL where there is one."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
EVERY, ORACLES = entry.queries(), entry.oracle_sql()
# the corpus operators have tests of their own
QUERIES = {k: v for k, v in EVERY.items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_inventory_is_covered():
    sizes = {"src": 15, "fn": 20, "agg": 23, "det": 28, "fnd": 20, "rul": 21, "ctx": 11, "win": 4, "his": 8, "snk": 4, "aud": 7}
    assert set(QUERIES) == {f"{k}_{i:02d}" for k, n in sizes.items() for i in range(1, n + 1)}
    assert set(ORACLES) <= set(EVERY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
