import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = (
    "a1_scan_phase a11_parse_messages b4_sample_ranges b9_outcome_classifier b14_report_columns c1_align_parties c6_verified_gather c11_nearest_surface "
    "d4_error_estimate d4_error_estimate_large d11_variable_reliability d15_qber_bins d19_strategy_guideline d26_serial_correlation e3_first_breach e5_moving_average e6_best_so_far "
    "f5_diverse_batch h24_finite_key_length h29_feasibility_checks h44_verification_tag h49_toeplitz i1_two_hop_size i8_short_cycles j7_acquisition j11_auc "
    "k1_detection_monitor k6_ack_timeout k8_leakage_budget l_sql_functions m1_session_plan m2_sweep_report"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="input tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="input tables not present")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
