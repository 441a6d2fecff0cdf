"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__
from tallyline import queries as core

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test data")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    return str(v.normalize()) if isinstance(v, Decimal) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, con, name):
    got = core.queries()[name](spark, str(SF))
    want = con.execute(core.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda found: sorted([[plain(v) for v in r] for r in found])
    assert rows(got.select(*(f"`{c}`" for c in columns)).collect()) == rows(want.fetchall())


def test_entry(spark):
    out = {r["outcome"]: r["n"] for r in __spark_entry__.entry(spark).collect()}
    assert out == {"cosmetic": 1, "equal": 145, "missing_in_source": 1, "missing_in_target": 3, "substantive": 1}


def test_registry():
    assert set(core.oracle_sql()) <= set(core.queries()) <= set(__spark_entry__.queries())


def test_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 40"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
