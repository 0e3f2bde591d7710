"""Every query of the library against its SQL, over the smallest tables."""

import duckdb
import pytest

from heronry.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(df.select(*columns).collect()) == text(want.select(*[f'"{c}"' for c in columns]).fetchall())
