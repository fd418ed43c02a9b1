"""Predicted against actual outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import safe_ratio, to_number
from .ranking import approx_quantiles, exact_quantiles

UPPER, LOWER = 1.2, 0.8
_SHARES = {"p10_ratio": 0.10, "median_ratio": 0.50, "p90_ratio": 0.90}


def ratio_status(median: Column) -> Column:
    """The verdict on a median of actual / predicted."""
    return F.when(median > UPPER, "under_predicted").when(median < LOWER, "over_predicted").otherwise("within_band")


def severity_drift(outcomes: DataFrame, exact: bool = True) -> DataFrame:
    """One row: matched claims, spread of actual/predicted and the verdict.

    Needs claim_amount and predicted_claim_severity; rows without a positive amount are left out.
    """
    claims = outcomes.select(
        to_number("claim_amount").alias("actual"), to_number("predicted_claim_severity").alias("predicted")
    ).where(F.col("actual") > 0)
    ratios = claims.select(safe_ratio(F.col("actual"), F.col("predicted")).alias("ratio"))
    means = ratios.agg(F.count(F.lit(1)).alias("matched_claims"), F.avg("ratio").alias("mean_ratio"))
    quantiles = (exact_quantiles if exact else approx_quantiles)(ratios, ["ratio"], _SHARES).select(*_SHARES)
    joined = means.join(quantiles, F.lit(True), "left")  # one row each
    status = F.when(F.col("matched_claims") == 0, "no_data").otherwise(ratio_status(F.col("median_ratio")))
    return joined.select("matched_claims", "median_ratio", "mean_ratio", "p10_ratio", "p90_ratio", status.alias("status"))


def frequency_drift(outcomes: DataFrame) -> DataFrame:
    """One row: mean observed claim rate, mean predicted frequency, their ratio and the verdict."""
    exposure = F.coalesce(F.nullif(to_number("Exposure"), F.lit(0.0)), F.lit(1.0))
    claimed = F.coalesce("claim_occurred", F.lit(False)) | (F.coalesce(to_number("claim_amount"), F.lit(0.0)) > 0)
    rates = outcomes.select(
        (claimed.cast("double") / exposure).alias("observed"), to_number("predicted_annual_frequency").alias("predicted")
    )
    ratio = F.when(F.col("predicted_mean") > 0, F.col("observed_mean") / F.col("predicted_mean"))
    return rates.agg(
        F.count(F.lit(1)).alias("policies"),
        F.avg("observed").alias("observed_mean"),
        F.avg("predicted").alias("predicted_mean"),
    ).withColumn("ratio", ratio).withColumn(
        "status",
        F.when(F.col("ratio").isNull(), "not_computable")
        .when((F.col("ratio") > UPPER) | (F.col("ratio") < LOWER), "drift")
        .otherwise("within_band"),
    )


def drift_report(outcomes: DataFrame, exact: bool = True) -> DataFrame:
    """(component, metric, value, status) for both components."""
    severity = severity_drift(outcomes, exact)
    frequency = frequency_drift(outcomes)
    parts = [
        ("severity", severity, ["matched_claims", "median_ratio", "mean_ratio", "p10_ratio", "p90_ratio"]),
        ("frequency", frequency, ["policies", "observed_mean", "predicted_mean", "ratio"]),
    ]
    out = None
    for component, df, metrics in parts:
        rows = df.select(*[F.col(m).cast("double").alias(m) for m in metrics], "status").unpivot(
            ["status"], metrics, "metric", "value"
        ).select(F.lit(component).alias("component"), "metric", "value", "status")
        out = rows if out is None else out.unionByName(rows)
    return out
