"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from lectern import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(found, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted(tuple(str(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    found = df.collect()
    if name in catalog.oracle_sql():
        cursor = duck.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        expected = cursor.fetchall()
        assert sorted(columns) == sorted(df.columns)
        assert rows(found, df.columns, sorted(columns)) == rows(expected, columns, sorted(columns))
    else:
        assert found
