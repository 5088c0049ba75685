import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from twinfold.session import local_session, ship

    session = local_session(4, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the tables of a test data folder."""
    import duckdb

    def run(sf_dir: str, sql: str):
        con = duckdb.connect()
        for name in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings", "lineitem"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        result = con.sql(sql)
        columns = sorted(result.columns)
        picked = ", ".join(f'"{c}"' for c in columns)
        return columns, sorted(map(repr, con.sql(f"SELECT {picked} FROM ({sql})").fetchall()))

    return run
