import duckdb
import pytest

from quern.llm import registry


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(registry.ORACLE_SQL[name]).df())
