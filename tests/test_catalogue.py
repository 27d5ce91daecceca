"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from parlance.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(rows):
    return sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = tidy(map(tuple, df.select(columns).collect()))
    assert mine or name == "topic_shifts"
    if name in SQL:
        theirs = duck.sql(SQL[name])
        assert sorted(theirs.columns) == columns
        assert mine == tidy(theirs.select(*[f'"{c}"' for c in columns]).fetchall())
