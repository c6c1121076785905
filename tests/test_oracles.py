"""Some of the named queries against their SQL in DuckDB, by value."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ("bars_month", "clean_types", "panel_outer_join_fallback", "ts_return_n", "rolling_ma_gap", "decile_assign", "ic_by_period", "kfold_ranges", "winsor_target", "image_pixels", "holdings")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = db.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())
