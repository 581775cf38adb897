import glob
import os

import duckdb
import pytest

from tidegrid.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = c.execute(queries.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in sorted(names)) for r in df.collect()) == sorted(tuple(r[names.index(n)] for n in sorted(names)) for r in cursor.fetchall())
