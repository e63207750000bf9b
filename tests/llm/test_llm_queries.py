"""The pN_ queries equal their SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tastegrid.llm import oracle, queries
from tests.test_queries import SF, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[x]) for x in columns) for r in df.collect())
    result = c.execute(oracle.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(plain(r[names.index(x)]) for x in columns) for r in result.fetchall())
