import pytest
from pyspark.sql import functions as F

from ratespark.config import CATEGORICAL_DEFAULTS, NUMERIC_DEFAULTS
from ratespark.operators import pricing, scenarios
from ratespark.operators.features import engineer_features

NAMES = [
    "baseline", "vehicle_power_decrease", "vehicle_power_increase", "driver_age_decrease",
    "driver_age_increase", "bonus_malus_decrease", "bonus_malus_increase",
]
BASE = {"annual_frequency": 1.0, "claim_severity": 1800.0, "annualized_expected_loss": 290.0}


def score(df):
    prepared = engineer_features(df, NUMERIC_DEFAULTS, CATEGORICAL_DEFAULTS)
    return pricing.calculate_premium(prepared, F.col("BonusMalus") / 100, F.col("VehPower") * 300, baselines=BASE)


def test_one_policy_gives_seven_rows(raw_policies):
    report = scenarios.simulate_scenarios(raw_policies.where("IDpol = 3"), score)
    assert report.columns == scenarios.REPORT_COLUMNS
    rows = report.collect()
    assert [r.scenario_name for r in rows] == NAMES
    base = rows[0]
    assert (base.changed_feature, base.changed_value, base.premium_delta, base.premium_delta_pct) == ("none", None, 0.0, 0.0)
    for r in rows[1:]:
        assert r.premium_delta == pytest.approx(r.final_premium - base.final_premium)
        assert r.premium_delta_pct == pytest.approx(100 * r.premium_delta / base.final_premium)


def test_values_are_clipped(raw_policies):
    edge = raw_policies.where("IDpol = 1").withColumns({"DrivAge": F.lit(20.0), "BonusMalus": F.lit(60.0), "VehPower": F.lit(19.0)})
    values = {r.scenario_name: r.changed_value for r in scenarios.simulate_scenarios(edge, score).collect()}
    assert values["driver_age_decrease"] == 18.0 and values["bonus_malus_decrease"] == 50.0
    assert values["vehicle_power_increase"] == 20.0 and values["vehicle_power_decrease"] == pytest.approx(15.2)


def test_missing_factor_is_filled_like_the_baseline(raw_policies):
    gap = raw_policies.where("IDpol = 1").withColumn("VehPower", F.lit(None).cast("double"))
    rows = {r.scenario_name: r for r in scenarios.simulate_scenarios(gap, score).collect()}
    assert rows["vehicle_power_increase"].changed_value is None
    assert rows["vehicle_power_increase"].premium_delta == 0.0


def test_portfolio_and_aliases(raw_policies):
    renamed = raw_policies.withColumnRenamed("VehPower", "vehicle_power").withColumnRenamed("DrivAge", "driver_age")
    report = scenarios.simulate_scenarios(renamed, score)
    assert report.count() == 30 * 7
    table = scenarios.sensitivity(report).collect()
    assert {r.scenario_name for r in table} == set(NAMES) and all(r.policies == 30 for r in table)


def test_no_shuffle_in_the_plan(raw_policies):
    report = scenarios.simulate_scenarios(raw_policies, score)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_curves(raw_policies):
    curve = scenarios.premium_curves(scenarios.scored_scenarios(raw_policies.where("IDpol = 2"), score))
    assert {r.feature: r["count"] for r in curve.groupBy("feature").count().collect()} == {"VehPower": 3, "DrivAge": 3, "BonusMalus": 3}
