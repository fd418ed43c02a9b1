"""Foreign portfolios mapped onto the rating schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clip, code_lookup, rescale, to_number, year_of_dmy
from .ranking import exact_quantiles

# --- Fixed values: target ranges, code maps and stand-ins for absent factors ---------------------
POWER_RANGE = (4.0, 20.0)
BONUS_RANGE = (50.0, 230.0)
BONUS_PER_CLAIM = 9.0
REFERENCE_YEAR = 2018
AGE_WHEN_UNKNOWN = 40.0
ZIP_TO_AREA = {"0": "A", "1": "B", "2": "C", "3": "D"}
FUEL_CODES = {"P": "Regular", "D": "Diesel"}
AREA_CODES = {"0": "A", "1": "B"}
STAND_INS = {"VehBrand": "B12", "Density": 393.0, "Region": "Centre"}
DUTCH_VEHICLE_AGE, DUTCH_FUEL = 6.0, "Regular"


def dutch_portfolio(raw: DataFrame) -> DataFrame:
    """Columns age_policyholder, nclaims, exposure, amount, power, bm, zip -> rating schema."""
    kept = raw.withColumns({
        c: to_number(c) for c in ["age_policyholder", "nclaims", "exposure", "amount", "power", "bm"]
    }).where(F.col("exposure") > 0)
    extremes = kept.agg(
        F.min("power").alias("power_lo"), F.max("power").alias("power_hi"),
        F.min("bm").alias("bm_lo"), F.max("bm").alias("bm_hi"),
    )
    scaled = kept.crossJoin(F.broadcast(extremes))  # one row
    return scaled.select(
        F.col("exposure").alias("Exposure"),
        rescale(F.col("power"), F.col("power_lo"), F.col("power_hi"), *POWER_RANGE).alias("VehPower"),
        F.lit(DUTCH_VEHICLE_AGE).alias("VehAge"),
        F.col("age_policyholder").alias("DrivAge"),
        rescale(F.col("bm"), F.col("bm_lo"), F.col("bm_hi"), *BONUS_RANGE).alias("BonusMalus"),
        F.lit(STAND_INS["VehBrand"]).alias("VehBrand"),
        F.lit(DUTCH_FUEL).alias("VehGas"),
        code_lookup("zip", ZIP_TO_AREA).alias("Area"),
        F.lit(STAND_INS["Density"]).alias("Density"),
        F.lit(STAND_INS["Region"]).alias("Region"),
        F.coalesce(F.col("nclaims") > 0, F.lit(False)).alias("claim_occurred"),
        (F.col("amount") / clip(F.col("nclaims"), 1.0)).alias("claim_amount"),
        F.lit(0.0).alias("premium_paid"),
    )


def spanish_portfolio(raw: DataFrame) -> DataFrame:
    """One row per policy-year of the ``;``-separated portfolio -> rating schema."""
    kept = raw.withColumns({
        c: to_number(c)
        for c in ["Premium", "Power", "Year_matriculation", "N_claims_history", "N_claims_year", "Cost_claims_year"]
    }).where(F.col("Premium").isNotNull())
    positive = kept.select(F.when(F.col("Power") > 0, F.col("Power")).alias("Power"))
    middle = exact_quantiles(positive, ["Power"], {"power_median": 0.5}).select("power_median")
    # A left cross join by condition keeps the rows when no power is positive at all.
    filled = kept.join(F.broadcast(middle), F.lit(True), "left").withColumn(  # one row
        "Power", F.when(F.col("Power") == 0, F.col("power_median")).otherwise(F.col("Power"))
    )
    # min/max after the fill: positives and the median span the same range as the filled column.
    extremes = kept.agg(
        F.min(F.when(F.col("Power") != 0, F.col("Power"))).alias("power_lo"),
        F.max(F.when(F.col("Power") != 0, F.col("Power"))).alias("power_hi"),
    )
    scaled = filled.crossJoin(F.broadcast(extremes))  # one row
    driver_age = F.coalesce(
        (year_of_dmy("Date_start_contract") - year_of_dmy("Date_birth")).cast("double"), F.lit(AGE_WHEN_UNKNOWN)
    )
    claims = F.coalesce("N_claims_year", F.lit(0.0)).cast("int")
    return scaled.select(
        F.col("ID").try_cast("long").alias("IDpol"),
        F.lit(1.0).alias("Exposure"),
        rescale(F.col("Power"), F.col("power_lo"), F.col("power_hi"), *POWER_RANGE).alias("VehPower"),
        clip(F.lit(float(REFERENCE_YEAR)) - F.col("Year_matriculation"), 0.0).alias("VehAge"),
        clip(driver_age, 18.0, 100.0).alias("DrivAge"),
        clip(F.lit(BONUS_RANGE[0]) + F.lit(BONUS_PER_CLAIM) * F.coalesce("N_claims_history", F.lit(0.0)), *BONUS_RANGE)
        .alias("BonusMalus"),
        F.lit(STAND_INS["VehBrand"]).alias("VehBrand"),
        code_lookup("Type_fuel", FUEL_CODES, default="Regular").alias("VehGas"),
        code_lookup(F.col("Area").try_cast("int"), AREA_CODES, default="A").alias("Area"),
        F.lit(STAND_INS["Density"]).alias("Density"),
        F.lit(STAND_INS["Region"]).alias("Region"),
        (claims > 0).alias("claim_occurred"),
        (F.coalesce("Cost_claims_year", F.lit(0.0)) / F.greatest(claims, F.lit(1))).alias("claim_amount"),
        F.col("Premium").alias("premium_paid"),
    )


def portfolio_summary(harmonised: DataFrame) -> DataFrame:
    """Counts, ranges and averages of a harmonised portfolio in one row."""
    paid = F.col("claim_amount") > 0
    return harmonised.agg(
        F.count(F.lit(1)).alias("policies"),
        F.count_if("claim_occurred").alias("policies_with_claims"),
        F.count_if(paid).alias("severity_rows"),
        F.avg(F.when(paid, F.col("claim_amount"))).alias("avg_severity"),
        F.avg("premium_paid").alias("avg_premium_paid"),
        *[f(c).alias(f"{label}_{c}") for c in ("VehPower", "DrivAge", "BonusMalus") for label, f in (("min", F.min), ("max", F.max))],
    )


def category_distribution(harmonised: DataFrame, column: str) -> DataFrame:
    """(value, policies) of one category."""
    return harmonised.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("policies"))
