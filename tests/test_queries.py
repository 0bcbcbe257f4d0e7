"""Every query with an oracle gives the oracle's rows; the others keep their rules."""

import math

import duckdb
import pytest

from corpusloom.plans.registry import ORACLES, QUERIES


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return repr(x)
    return str(x)


def _bag(rows):
    return sorted(tuple(map(_cell, r)) for r in rows)


@pytest.fixture(scope="module")
def oracle(small):
    import glob

    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_the_oracle(spark, small, oracle, name):
    found = QUERIES[name](spark, small)
    names = sorted(found.columns)
    want = oracle.sql(ORACLES[name])
    assert sorted(want.columns) == names
    got = [tuple(r[n] for n in names) for r in found.collect()]
    assert _bag(got) == _bag(want.select(*(f'"{n}"' for n in names)).fetchall())
