import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratespark.operators import book, diagnostics
from ratespark.operators.validate import UnusableDataError

RUNS = {
    "poisson_gamma": {
        "status": "success", "frequency_model": "poisson", "severity_model": "gamma",
        "metrics": {"frequency": {"metrics": {"rmse": 0.31}}, "severity": {"metrics": {"rmse": 812.5}}},
    },
    "rf_rf": {
        "status": "success", "frequency_model": "random_forest", "severity_model": "random_forest",
        "metrics": {"frequency": {"metrics": {"rmse": 0.29}}, "severity": {"metrics": {}}},
    },
    "xgb_xgb": {"status": "skipped", "frequency_model": "xgboost", "severity_model": "xgboost"},
}


def test_comparison_frame_takes_successes_only(spark):
    rows = {(r.run_name, r.component): r for r in diagnostics.comparison_rmse_of(spark, RUNS).collect()}
    assert set(rows) == {("poisson_gamma", "Frequency"), ("poisson_gamma", "Severity"), ("rf_rf", "Frequency")}
    assert rows["poisson_gamma", "Severity"]["combo_label"] == "poisson + gamma"
    with pytest.raises(UnusableDataError, match="No successful run"):
        diagnostics.comparison_rmse_of(spark, {"a": {"status": "failed"}})


def test_histogram_matches_numpy(spark):
    df = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("v"))
    rows = diagnostics.histogram(df, "v", 40).orderBy("bin").collect()
    counts, edges = np.histogram([r.v for r in df.collect()], 40)
    assert [r.rows for r in rows] == list(counts)
    assert np.allclose([r.bin_low for r in rows], edges[:-1])
    constant = diagnostics.histogram(spark.range(5).select(F.lit(3.0).alias("v")), "v", 4).orderBy("bin").collect()
    assert constant[0].bin_low == 2.5 and constant[-1].bin_high == 3.5 and sum(r.rows for r in constant) == 5


def test_axis_extent(spark):
    pairs = spark.createDataFrame([(100.0, 90.0), (800.0, 820.0)], "actual double, predicted double")
    assert diagnostics.axis_extent(pairs).first().asDict() == {"axis_low": 90 - 36.5, "axis_high": 820 + 36.5}


def test_calibration_exact_and_approximate(spark):
    df = spark.range(1000).select("id", (F.col("id") / 10).alias("p"), (F.col("id") % 2).alias("y"))
    exact = diagnostics.calibration(df, "y", "p", "id").orderBy("bucket").collect()
    assert [r.bucket for r in exact] == list(range(10)) and sum(r.rows for r in exact) == 1000
    assert [r.predicted_mean for r in exact] == sorted(r.predicted_mean for r in exact)
    near = diagnostics.calibration(df, "y", "p", "id", exact=False).orderBy("bucket").collect()
    assert all(abs(a.rows - b.rows) <= 2 for a, b in zip(exact, near))


def test_gini_matches_brute_force(spark):
    df = spark.range(400).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("risk"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)).cast("double").alias("loss"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9)) + 1).cast("double").alias("exposure"),
    )
    got = diagnostics.gini(df, "risk", "loss", "exposure", "id").first()["gini"]
    pdf = df.toPandas().sort_values(["risk", "id"])
    x = np.concatenate([[0], pdf["exposure"].cumsum() / pdf["exposure"].sum()])
    y = np.concatenate([[0], pdf["loss"].cumsum() / pdf["loss"].sum()])
    assert got == pytest.approx(1 - 2 * np.trapezoid(y, x))
    curve = diagnostics.lorenz_curve(df, "risk", "loss", "exposure", "id").orderBy("point").collect()
    assert curve[-1].exposure_share == pytest.approx(1.0) and curve[-1].loss_share == pytest.approx(1.0)


def test_psi_of_equal_samples_is_zero(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert sum(r.psi_term for r in diagnostics.population_stability(df, df, "v").collect()) == pytest.approx(0.0)
    shifted = df.withColumn("v", F.col("v") + 300)
    assert sum(r.psi_term for r in diagnostics.population_stability(df, shifted, "v").collect()) > 0.25


def test_anomalies(spark):
    df = spark.range(101).select("id", F.when(F.col("id") == 100, 5000.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("c"))
    flagged = diagnostics.anomaly_flags(df, ["v", "c"])
    assert [r.id for r in flagged.where("is_anomaly").collect()] == [100]
    assert set(flagged.columns) == {"id", "v", "c", "robust_z_v", "robust_z_c", "is_anomaly"}


def test_diagnostic_pairs_are_sampled(spark):
    df = spark.range(300).select("id", F.col("id").cast("string").alias("actual"), F.lit("1").alias("predicted"))
    out = diagnostics.diagnostic_pairs(df, F.col("id"), sample_size=50)
    assert out.columns == ["actual", "predicted", "error"] and out.count() == 50


def test_repricing_and_selection(spark):
    df = spark.createDataFrame(
        [(1, "Low", 50.0, 100.0), (2, "High", 200.0, 100.0), (3, "Low", 100.0, 100.0), (4, "High", 90.0, 0.0)],
        "IDpol long, risk_category string, technical_premium double, premium_paid double",
    )
    rows = {r.IDpol: r for r in book.adverse_selection(book.repriced_book(df)).collect()}
    assert [rows[i].selection_flag for i in (1, 2, 3, 4)] == ["low_risk_overcharged", "high_risk_undercharged", "none", "none"]
    assert rows[2].premium_change_pct == 100.0 and rows[4].premium_change_pct is None
    guidance = book.segment_guidance(book.repriced_book(df), ["risk_category"]).collect()
    assert {r.risk_category: r.recommended_change_pct for r in guidance} == {"Low": -25.0, "High": 100.0}


def test_waterfall_adds_up(spark):
    df = spark.createDataFrame([(1, 20.0, 56.0, 100.0)], "IDpol long, expected_loss double, technical_premium double, final_premium double")
    steps = [r.amount for r in book.premium_waterfall(df).orderBy("step_order").collect()]
    assert sum(steps[:4]) == pytest.approx(steps[4]) == 100.0


def test_survey_and_cover(spark):
    survey = spark.createDataFrame(
        [("30", "Motorcycle", 12, 40.0, "High", "Low", 1, True, 5), ("44", "Boat", 3, 1.0, None, "Medium", 0, False, 50)],
        "age string, vehicle_type string, vehicle_age int, daily_km double, night_driving string, harsh_braking string, "
        "accidents_2yr int, claim_filed boolean, experience_years int",
    )
    bike, boat = book.survey_to_policies(survey).collect()
    assert (bike.VehPower, bike.VehBrand, bike.VehGas, bike.Area, bike.Exposure) == (4.0, "B2", "Diesel", "E", 2.0)
    assert bike.Density == 393.0 + 180 + 140 and bike.BonusMalus == pytest.approx(50 + 14 + 18 - 3)
    assert (boat.VehPower, boat.VehBrand, boat.Area, boat.Exposure, boat.BonusMalus) == (6.0, "B12", "B", 0.1, 50.0)
    priced = book.survey_to_policies(survey).withColumn("risk_category", F.lit("Medium"))
    covers = [r.coverage for r in book.coverage_recommendations(priced).collect()]
    assert covers == [["comprehensive", "zero_depreciation", "two_wheeler_policy", "consider_third_party_only"], ["comprehensive", "zero_depreciation"]]


def test_runs_survive_json(spark):
    frame = spark.createDataFrame([(json.dumps(RUNS),), ("{}",)], "payload string")
    assert diagnostics.comparison_rmse(frame).count() == 3
