"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

from numbers import Real
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from fabulary.plans import queries, reviews, stored  # noqa: F401 - reviews and stored add their queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are absent")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, Real) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, str(DATA)).toPandas()) == rows(duck.execute(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    found = queries.QUERIES[name](spark, str(DATA)).toPandas()
    if name == "lunar_order_days":  # every day turned into a lunar date comes back
        assert len(found) and (pd.to_datetime(found["day"]) == pd.to_datetime(found["back"])).all()
