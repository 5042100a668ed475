"""Archive queries against their DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from vaultlake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    key = lambda r: [(x is None, x) for x in r]
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in names)} FROM ({ORACLES[name]}) q").fetchall()
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(map(tuple, want), key=key)
