"""Every query with SQL gives the same rows in Spark and DuckDB on the smallest tables; the others give rows."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
from compare import plain

from tidemark import plans

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    assert got or name in EMPTY_HERE
    if name in plans.SQL:
        rel = duck.sql(plans.SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        want = sorted((tuple(plain(x) for x in r) for r in rel.select(*(f'"{c}"' for c in sorted(rel.columns))).fetchall()), key=repr)
        assert got == want


EMPTY_HERE: set[str] = set()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["ticker", "label", "n_events", "avg_abnormal_return"]
    assert set(plans.SQL) <= set(plans.QUERIES)
