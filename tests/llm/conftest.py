import duckdb
import pytest

TABLES = ("documents", "embeddings", "pages", "labels")
SMALL = "/root/testdata/sf0.001"


def rows(df, key=0):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables of a small corpus as a folder that queries read, and views of them in DuckDB."""
    def write(**frames):
        con = duckdb.connect()
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path), con
    return write
