import pytest
from pyspark.sql import functions as F

from ratespark.config import PricingConfig
from ratespark.operators import pricing
from ratespark.operators.metrics import frequency_metrics, severity_metrics

COLUMNS = [
    "predicted_annual_frequency", "predicted_claim_count", "predicted_claim_severity", "annualized_expected_loss",
    "expected_loss", "pure_premium", "technical_premium", "loaded_premium", "final_premium", "frequency_relativity",
    "severity_relativity", "risk_score", "risk_category",
]


def test_constant_model(policies):
    scored = pricing.calculate_premium(policies, F.lit(0.2), F.lit(1000.0))
    assert set(COLUMNS) <= set(scored.columns) and not [c for c in scored.columns if c.startswith("__")]
    for r in scored.collect():
        pure = 0.2 * r.Exposure * 1000
        assert r.pure_premium == pytest.approx(pure)
        assert r.final_premium == pytest.approx(max(pure * 1.3 + 30, 100)) and r.final_premium >= 100
        assert r.frequency_relativity == pytest.approx(0.2)  # the floor of 1 also holds for frequency
        assert r.severity_relativity == pytest.approx(1.0) and r.risk_score == pytest.approx(100.0)
        assert r.risk_category == "Medium"


def test_frequency_floor_can_be_lowered(policies):
    config = PricingConfig(frequency_floor=1e-9)
    row = pricing.calculate_premium(policies, F.lit(0.2), F.lit(1000.0), config).first()
    assert row["frequency_relativity"] == pytest.approx(1.0)


def test_given_baselines_are_converted(policies):
    config = PricingConfig(fx_rate=2.0)
    given = {"annual_frequency": 0.5, "claim_severity": 500.0, "annualized_expected_loss": 100.0}
    as_dict = pricing.calculate_premium(policies, F.lit(0.2), F.lit(1000.0), config, baselines=given).first()
    assert as_dict["severity_relativity"] == pytest.approx(2.0)
    assert as_dict["risk_score"] == pytest.approx(100 * 400 / 200)
    frame = policies.sparkSession.createDataFrame([given])
    as_frame = pricing.calculate_premium(policies, F.lit(0.2), F.lit(1000.0), config, baselines=frame).first()
    assert as_frame["risk_score"] == pytest.approx(as_dict["risk_score"])


def test_missing_predictions(policies):
    row = pricing.calculate_premium(policies, F.lit(None).cast("double"), F.lit(-5.0), baselines=dict.fromkeys(pricing.BASELINE_KEYS, 1.0)).first()
    assert row["final_premium"] is None and row["predicted_claim_severity"] == 0.0 and row["risk_category"] == "High"


def test_thresholds_come_from_the_config():
    assert pricing.risk_thresholds() == {"low_max": 160.0, "medium_max": 430.0}


def test_baselines(spark):
    df = spark.createDataFrame([(0.1, 1200.0), (0.15, 1800.0), (0.2, 2400.0)], "f double, s double")
    row = pricing.baselines_dict(pricing.portfolio_baselines(df, "f", "s"))
    assert row == {"annual_frequency": 1.0, "claim_severity": 1800.0, "annualized_expected_loss": pytest.approx(290.0)}


def test_band_counts_include_empty_bands(policies):
    scored = pricing.calculate_premium(policies, F.lit(0.2), F.lit(1000.0))
    counts = [(r.risk_category, r.policies) for r in pricing.risk_band_counts(scored).orderBy("band_order").collect()]
    assert counts == [("Low", 0), ("Medium", 30), ("High", 0)]
    summary = pricing.premium_summary(scored).first()
    assert summary["total"] == summary["medium_count"] == 30
    assert summary["min_premium"] <= summary["avg_premium"] <= summary["max_premium"]


def test_top_premiums(policies):
    scored = pricing.calculate_premium(policies, F.col("BonusMalus") / 100, F.lit(1000.0))
    top = pricing.top_premiums(scored, 5)
    assert top.columns == pricing.TOP_PREMIUM_COLUMNS
    best = scored.toPandas().sort_values(["final_premium", "IDpol"], ascending=[False, True])["IDpol"].head(5)
    assert [r.IDpol for r in top.collect()] == list(best)


def test_segment_rates_match_plain_sums(policies, raw_claims):
    rates = {r.Area: r for r in pricing.segment_rates(policies, raw_claims).collect()}
    mean = raw_claims.join(policies, "IDpol").toPandas().groupby("Area")["ClaimAmount"].mean()
    pdf = policies.toPandas().groupby("Area")[["ClaimNb", "Exposure"]].sum()
    for area, row in pdf.iterrows():
        assert rates[area]["rate_frequency"] == pytest.approx(row["ClaimNb"] / row["Exposure"])
        assert rates[area]["rate_severity"] == pytest.approx(mean[area])


def test_metric_bases(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (0, 1.0, 0.4)], "ClaimNb int, Exposure double, predicted_annual_frequency double")
    legacy = frequency_metrics(df, basis="legacy").first()
    assert legacy["rmse"] == pytest.approx(((0.0**2 + 0.4**2) / 2) ** 0.5)
    count = frequency_metrics(df).first()
    assert count["predicted_mean"] == pytest.approx(0.45) and count["sample_size"] == 2
    weighted = frequency_metrics(df, basis="rate_weighted").first()
    assert weighted["observed_mean"] == pytest.approx(1 / 1.5)
    with pytest.raises(ValueError, match="Unsupported basis"):
        frequency_metrics(df, basis="other")


def test_severity_metrics(spark):
    df = spark.createDataFrame([(100.0, 90.0), (250.0, 260.0), (0.0, 5.0)], "ClaimAmount double, predicted_claim_severity double")
    row = severity_metrics(df).first()
    assert row["sample_size"] == 2 and row["mae"] == pytest.approx(10.0) and row["rmse"] == pytest.approx(10.0)
