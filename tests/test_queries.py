"""Every query that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from quireframe.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v
    return sorted(columns), sorted(repr(tuple(one(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = plain([tuple(r) for r in got.collect()], got.columns)
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [d[0] for d in want.description]
        assert rows == plain(want.fetchall(), columns)
