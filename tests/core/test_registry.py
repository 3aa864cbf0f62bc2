import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidelane.plans import registry

SMALL = "/root/testdata/sf0.001"
CHECKED = ["bars_15m", "t01_portfolio_trail_1wk", "w13_kernel_indicator", "t06_tactical_target", "w59_confirmation", "a10_value_at_risk", "t14_lifecycle"]


def test_names_and_flagship():
    known = entry.queries()
    assert registry.FLAGSHIP in known and set(entry.oracle_sql()) <= set(known)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the tables")
@pytest.mark.parametrize("name", CHECKED)
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("orders", "events"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found = registry.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    plain = lambda rows: sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    sql = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert plain(found.select(*columns).collect()) == plain(sql)
