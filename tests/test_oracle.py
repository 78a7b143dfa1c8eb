"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest
from pileline.plans import catalog

DIR = "/root/testdata/sf0.001"


def rows(columns, data):
    def cell(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return str(x)
        return f"{round(float(x), 6) + 0.0:.6f}"

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "events orders customer part lineitem".split():
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
    spark.catalog.clearCache()
