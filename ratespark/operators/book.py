"""Analysis of the priced book and the customer-facing quote report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import NUMERIC_DEFAULTS, PricingConfig
from ..functions.cleaning import clip, code_lookup, safe_ratio, to_number


def portfolio_overview(scored: DataFrame) -> DataFrame:
    """Policies, claim rate, average frequency and severity, total expected loss."""
    return scored.agg(
        F.count(F.lit(1)).alias("policies"),
        (F.sum("ClaimNb") / F.sum("Exposure")).alias("claim_rate"),
        F.avg("predicted_annual_frequency").alias("avg_frequency"),
        F.avg("predicted_claim_severity").alias("avg_severity"),
        F.sum("expected_loss").alias("total_expected_loss"),
    )


def repriced_book(scored: DataFrame, charged: str = "premium_paid") -> DataFrame:
    """Recommended against charged premium per policy; without a charge the change is null."""
    paid = F.nullif(to_number(charged), F.lit(0.0))
    change = safe_ratio(F.col("technical_premium") - paid, paid) * F.lit(100.0)
    return scored.withColumns({
        "recommended_premium": F.col("technical_premium"),
        "premium_change": F.col("technical_premium") - paid,
        "premium_change_pct": change,
    })


def segment_guidance(repriced: DataFrame, segments: Sequence[str], charged: str = "premium_paid", cube: bool = False) -> DataFrame:
    """Recommended change per segment, weighted by the charged premium.

    ``cube`` adds the subtotals of every subset of ``segments`` (null means all).
    """
    with_charge = repriced.where(F.col("premium_change_pct").isNotNull())
    grouped = with_charge.cube(*segments) if cube else with_charge.groupBy(*segments)
    return grouped.agg(
        F.count(F.lit(1)).alias("policies"),
        F.sum(charged).alias("charged"),
        F.sum("recommended_premium").alias("recommended"),
    ).withColumn(
        "recommended_change_pct", safe_ratio(F.col("recommended") - F.col("charged"), F.col("charged")) * F.lit(100.0)
    )


def adverse_selection(repriced: DataFrame, tolerance_pct: float = 20.0) -> DataFrame:
    """Flag low-risk policies charged too much and high-risk policies charged too little."""
    change = F.col("premium_change_pct")
    flag = (
        F.when((F.col("risk_category") == "Low") & (change < -tolerance_pct), "low_risk_overcharged")
        .when((F.col("risk_category") == "High") & (change > tolerance_pct), "high_risk_undercharged")
        .otherwise("none")
    )
    return repriced.withColumn("selection_flag", flag)


def band_backtest(scored: DataFrame) -> DataFrame:
    """Did the High band claim more? Observed frequency and severity per risk band."""
    return scored.groupBy("risk_category").agg(
        F.count(F.lit(1)).alias("policies"),
        (F.sum("ClaimNb") / F.sum("Exposure")).alias("observed_frequency"),
        safe_ratio(F.sum("TotalClaimAmount"), F.sum("ClaimNb")).alias("observed_severity"),
        (F.sum("TotalClaimAmount") / F.sum("Exposure")).alias("observed_loss"),
    )


def yearly_trend(scored: DataFrame, year: str = "policy_year") -> DataFrame:
    """Mix, frequency and severity per year with the change on the year before."""
    yearly = scored.groupBy(F.col(year).alias("policy_year")).agg(
        F.count(F.lit(1)).alias("policies"),
        (F.count_if(F.col("risk_category") == "High") / F.count(F.lit(1))).alias("high_share"),
        (F.sum("ClaimNb") / F.sum("Exposure")).alias("frequency"),
        safe_ratio(F.sum("TotalClaimAmount"), F.sum("ClaimNb")).alias("severity"),
    )
    by_year = Window.orderBy("policy_year")  # one row per year
    return yearly.withColumns({
        f"{c}_change": F.col(c) - F.lag(c).over(by_year) for c in ("high_share", "frequency", "severity")
    })


# --- Fixed values: steps of the premium waterfall ---------------------------------------------------
WATERFALL_STEPS = ["expected_loss", "expense_loading", "fixed_expense", "minimum_top_up", "final_premium"]


def premium_waterfall(scored: DataFrame, key: str = "IDpol", config: PricingConfig = PricingConfig()) -> DataFrame:
    """(key, step_order, step, amount): how the expected loss grows into the final premium."""
    amounts = [
        F.col("expected_loss"),
        F.col("expected_loss") * F.lit(config.expense_loading),
        F.lit(config.fixed_expense),
        F.col("final_premium") - F.col("technical_premium"),
        F.col("final_premium"),
    ]
    steps = [
        F.struct(F.lit(i).alias("step_order"), F.lit(step).alias("step"), amount.alias("amount"))
        for i, (step, amount) in enumerate(zip(WATERFALL_STEPS, amounts), start=1)
    ]
    return scored.select(key, F.inline(F.array(*steps)))


# --- Fixed values: survey answers to rating factors --------------------------------------------------
VEHICLE_POWER = {"Sedan": "6", "SUV": "8", "Hatchback": "5", "Motorcycle": "4", "Other": "6"}
VEHICLE_BRAND = {"Sedan": "B12", "SUV": "B11", "Hatchback": "B10", "Motorcycle": "B2", "Other": "B12"}
VEHICLE_FUEL = {"Motorcycle": "Diesel"}
LEVEL_POINTS = {"Low": "0", "Medium": "1", "High": "2"}
KM_PER_EXPOSURE = 20.0
DENSITY_PER_ACCIDENT, DENSITY_PER_CLAIM = 180.0, 140.0
BONUS_PER_ACCIDENT, BONUS_PER_CLAIM = 14.0, 18.0
BONUS_PER_YEAR, MAX_YEARS = 0.6, 30.0
# Area letter by risk points: one letter per point, F from five points on.
AREA_LETTERS = ["A", "B", "C", "D", "E", "F"]


def survey_to_policies(survey: DataFrame) -> DataFrame:
    """Questionnaire answers as rating factors.

    Columns: age, vehicle_type, vehicle_age, daily_km, night_driving, harsh_braking,
    accidents_2yr, claim_filed (boolean), experience_years. Density and bonus-malus start from
    the global defaults. How points map to the area letter is this library's choice.
    """
    accidents = F.coalesce(to_number("accidents_2yr"), F.lit(0.0))
    claim = F.coalesce(F.col("claim_filed").cast("int"), F.lit(0)).cast("double")
    points = _points("night_driving") + _points("harsh_braking") + accidents + claim
    letter = F.least(F.greatest(points.cast("int"), F.lit(0)), F.lit(len(AREA_LETTERS) - 1))
    bonus = (
        F.lit(NUMERIC_DEFAULTS["BonusMalus"]) + accidents * F.lit(BONUS_PER_ACCIDENT) + claim * F.lit(BONUS_PER_CLAIM)
        - F.least(F.coalesce(to_number("experience_years"), F.lit(0.0)), F.lit(MAX_YEARS)) * F.lit(BONUS_PER_YEAR)
    )
    return survey.withColumns({
        "Exposure": clip(to_number("daily_km") / F.lit(KM_PER_EXPOSURE), 0.1, 2.5),
        "VehPower": code_lookup("vehicle_type", VEHICLE_POWER, "6").cast("double"),
        "VehAge": to_number("vehicle_age"),
        "DrivAge": to_number("age"),
        "BonusMalus": clip(bonus, 50.0, 350.0),
        "VehBrand": code_lookup("vehicle_type", VEHICLE_BRAND, "B12"),
        "VehGas": code_lookup("vehicle_type", VEHICLE_FUEL, "Regular"),
        "Area": F.element_at(F.array(*map(F.lit, AREA_LETTERS)), letter + F.lit(1)),
        "Density": F.lit(NUMERIC_DEFAULTS["Density"]) + accidents * F.lit(DENSITY_PER_ACCIDENT)
        + claim * F.lit(DENSITY_PER_CLAIM),
        "Region": F.lit("Centre"),
    })


def _points(column: str) -> Column:
    return code_lookup(column, LEVEL_POINTS, "0").cast("double")


# --- Fixed values: coverage recommendations ---------------------------------------------------------
BAND_COVER = {
    "Low": ["third_party", "basic_own_damage", "higher_voluntary_deductible"],
    "Medium": ["comprehensive", "zero_depreciation"],
    "High": ["comprehensive", "zero_depreciation", "engine_protection", "roadside_assistance", "consider_telematics"],
}
MOTORCYCLE_COVER = "two_wheeler_policy"
OLD_VEHICLE_COVER, OLD_VEHICLE_YEARS = "consider_third_party_only", 10.0


def coverage_recommendations(scored: DataFrame, vehicle_type: str | None = "vehicle_type") -> DataFrame:
    """Add ``coverage``: the list of recommended covers by band, vehicle type and age."""
    by_band = F.lit(None).cast("array<string>")
    for band, covers in BAND_COVER.items():
        by_band = F.when(F.col("risk_category") == band, F.array(*map(F.lit, covers))).otherwise(by_band)
    extras = [F.when(F.col("VehAge") > OLD_VEHICLE_YEARS, F.lit(OLD_VEHICLE_COVER))]
    if vehicle_type and vehicle_type in scored.columns:
        extras.insert(0, F.when(F.col(vehicle_type) == "Motorcycle", F.lit(MOTORCYCLE_COVER)))
    return scored.withColumn("coverage", F.array_compact(F.concat(by_band, F.array(*extras))))
