"""A cross-section of the catalogue against DuckDB; check_oracle.py compares all of it."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import TABLES, normal

SF = "/root/testdata/sf0.001"
NAMES = (
    "c06_price_carry_forward c09_earliest_load c10_cleaning_metrics g06_promo_islands g10_features_master "
    "e13_baseline_folds l06_segment_log a01_volume_tier a09_report_set i11_replay_days i12_series_kpis d06_dirtiness"
).split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, db, name):
    df = contract.queries()[name](spark, SF)
    cur = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(df.columns, df.collect()) == normal(names, cur.fetchall())


def test_entry_and_registry(spark):
    assert len(contract.entry(spark).columns) == 49
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) >= 80
