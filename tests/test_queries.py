"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from ruleloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


#: A few of each kind here; all of them are compared by the driver.
NAMES = ["k1_sma", "k7_rsi", "k13_cci", "k26_candle_patterns", "r4_expanding_thresholds", "r5_stability", "t2_rolling_pctrank", "e4_crossing_predicate", "g8_gate_decision", "a5_and_pairs", "m12_elbow_horizon", "b1_b4_ledger_long_limit", "b10_grid_selection", "j4_duplicates", "q6_time_continuity", "v2_rolling_expectancy"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_every_query_has_a_name_of_its_own_and_sql_belongs_to_one():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 100
