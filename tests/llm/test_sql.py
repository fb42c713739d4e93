"""The operators' SQL on the given tables."""

import duckdb
import pytest
from test_queries import TABLES, shown

from quillmill.llm import queries


@pytest.mark.parametrize("size", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name, size):
    folder = f"/root/testdata/sf{size}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.queries()[name](spark, folder).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(want)
    rows = [sorted("|".join(map(shown, r)) for r in f[columns].itertuples(index=False)) for f in (got, want)]
    assert rows[0] == rows[1]
