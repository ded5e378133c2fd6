"""Each operator's query that has SQL gives DuckDB's rows at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def rows(frame):
    columns = sorted(frame.columns)
    clean = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x
    return columns, sorted((tuple(clean(x) for x in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    expected = db.sql(queries.oracle_sql()[name]).df()
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(expected)
