"""Every query against its SQL on the smallest tables, and entry()."""

import os
from decimal import Decimal

import duckdb
import pytest

from kerf.registry import FLAGSHIP, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(table):
    names = sorted(table.column_names)

    def value(x):
        if isinstance(x, Decimal):
            x = float(x)
        if isinstance(x, float):
            return int(x) if x == int(x) else round(x, 6)
        return x

    return names, sorted((tuple(value(r[n]) for n in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).arrow()
        assert normal(got) == normal(want.read_all() if hasattr(want, "read_all") else want)


def test_flagship(spark):
    assert FLAGSHIP(spark, SF).count() > 0
