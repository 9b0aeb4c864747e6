"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from zonegrid.plans import queries as plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 9) + 0.0
        return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x

    return [columns[i] for i in order], sorted([tuple(value(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    found = duck.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(plans.queries()) <= set(__spark_entry__.queries()) and set(plans.oracle_sql()) <= set(__spark_entry__.oracle_sql())
