"""The operators' queries against their SQL, and the queries over whole small tables."""

import glob

import duckdb
import pytest

from corpusloom.llm.registry import ORACLES, QUERIES
from tests.llm.test_rowwise import _bag


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_the_oracle(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, small)
    names = sorted(found.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == names
    assert _bag(tuple(r[n] for n in names) for r in found.collect()) == _bag(want.select(*(f'"{n}"' for n in names)).fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 10
