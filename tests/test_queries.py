"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from stateloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    """Values as text with their types, so that 1, 1.0 and '1' differ."""
    return sorted(tuple(f"{type(v).__name__} {v:.9g}" if isinstance(v, float) else f"{type(v).__name__} {v}" for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_oracle(spark, oracle, name):
    df, sql = queries.queries()[name](spark, SF), queries.oracle_sql()[name]
    columns = sorted(df.columns)
    assert columns == sorted(oracle.sql(sql).columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = oracle.sql(f"SELECT {quoted} FROM ({sql})").fetchall()
    assert plain(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect())) == plain(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
