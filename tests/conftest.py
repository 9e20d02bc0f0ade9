from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quernstone.cluster import ship

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of the smallest scale as views."""
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(DATA).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(df) -> list[tuple]:
    """A result as sorted rows of plain values, columns by name, doubles rounded."""
    frame = df.toPandas() if hasattr(df, "toPandas") else df
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        values = []
        for x in row:
            if x is None or str(x) in ("NaT", "<NA>", "nan"):
                values.append("null")
            elif hasattr(x, "isoformat"):
                values.append(x.isoformat()[:19])
            elif isinstance(x, str):
                values.append(x)
            else:
                values.append(repr(round(float(x), 9)))
        out.append(tuple(values))
    return sorted(out)
