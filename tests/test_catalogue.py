"""A selection of the named queries beside their SQL; tools/check_queries.py runs all of them."""

import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry_points
from check_queries import compare

CHECKED = [
    "policy_engineer_features", "policy_alias_input", "policy_clean_frequency", "claim_feature_join", "data_quality_summary",
    "row_contract_violations", "defaults_metadata", "premium_scoring", "top_premiums", "scenario_report",
    "frequency_calibration_deciles", "premium_histogram_log", "glm_frequency_onefactor", "stratified_split",
    "spanish_portfolio", "retrain_policy_frame", "drift_severity", "stream_outcome_match", "stream_dedup", "lorenz_gini",
    "segment_guidance", "psi", "load_policy_csv", "dutch_csv_job", "raising_checks", "quote_store_replay_two_days",
    "ingest_portfolio_csv", "scenario_report_without_ids", "stream_consent_fanout", "retraining_counters", "single_tree_rates",
]
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="sample tables are absent")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, engine, name):
    ours = entry_points.queries()[name](spark, str(FOLDER)).toPandas()
    assert compare(ours, engine.execute(entry_points.oracle_sql()[name]).df()) == ""


def test_every_sql_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() == 3
