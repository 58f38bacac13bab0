"""The driver contract, and Spark against SQL for a spread of the registered queries.

The driver compares all of them; this runs the quick ones on the smallest tables.
"""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from leafmill.catalog import oracles
from leafmill.catalog.queries import registered

TESTDATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")

QUICK = [
    "SRC3", "SRC4", "SNK1", "SNK5", "FLT5", "FLT6", "FLT10", "JN1", "JN4", "AGG2", "AGG4", "AGG6",
    "AGG10", "WIN1", "WIN2", "WIN3", "FLT11", "FLT12",
    "JN1_redirects", "JN3", "JN5", "SNK7", "SRC2", "JOB1", "JOB8", "JOB9", "JOB12", "SC3", "SC4", "SC9", "SC16", "SC17", "SC20", "JOB4", "JOB5", "JOB10",
]


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def test_every_query_has_sql():
    assert set(registered()) == set(oracles.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(TESTDATA):
        con.sql(f"create view {file.removesuffix('.parquet')} as from '{TESTDATA}/{file}'")
    df = contract.queries()[name](spark, TESTDATA)
    result = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(row[columns.index(c)] for c in df.columns) for row in result.fetchall()]
    assert sorted(map(tuple, df.collect()), key=_key) == sorted(want, key=_key)


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["page_id", "url", "markdown", "references", "output"]
    assert out.count() == 50
