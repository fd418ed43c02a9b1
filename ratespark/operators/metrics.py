"""Model quality measures as one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rating import gamma_unit_deviance, poisson_unit_deviance

BASES = ("count", "legacy", "rate_weighted")


def _common(actual: Column, predicted: Column) -> list[Column]:
    error = actual - predicted
    return [
        F.count(actual).alias("sample_size"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(actual).alias("observed_mean"),
        F.avg(predicted).alias("predicted_mean"),
    ]


def _frequency_measures(frequency: str, basis: str) -> list[Column]:
    rate, exposure, claims = F.col(frequency), F.col("Exposure"), F.col("ClaimNb").cast("double")
    if basis == "rate_weighted":
        observed = claims / exposure

        def mean(value: Column) -> Column:
            return F.sum(exposure * value) / F.sum(exposure)

        error = observed - rate
        return [
            F.count(claims).alias("sample_size"),
            F.sqrt(mean(error * error)).alias("rmse"),
            mean(observed).alias("observed_mean"),
            mean(rate).alias("predicted_mean"),
            mean(poisson_unit_deviance(observed, rate)).alias("poisson_deviance"),
        ]
    if basis not in BASES:
        raise ValueError(f"Unsupported basis '{basis}': choose one of {', '.join(BASES)}.")
    predicted = rate * exposure if basis == "count" else rate
    return [*_common(claims, predicted), F.avg(poisson_unit_deviance(claims, predicted)).alias("poisson_deviance")]


def frequency_metrics(
    scored: DataFrame, frequency: str = "predicted_annual_frequency", basis: str = "count"
) -> DataFrame:
    """RMSE, means and mean Poisson deviance.

    ``count`` compares claims with frequency x exposure, ``legacy`` claims with the annual
    frequency, ``rate_weighted`` the observed rate with the frequency under exposure weights.
    """
    return scored.agg(*_frequency_measures(frequency, basis))


def frequency_metrics_by_basis(scored: DataFrame, frequency: str = "predicted_annual_frequency") -> DataFrame:
    """A row per basis from one pass over the rows."""
    rows = scored.agg(*[F.struct(F.lit(basis).alias("basis"), *_frequency_measures(frequency, basis)).alias(basis) for basis in BASES])
    return rows.select(F.inline(F.array(*BASES)))


def severity_metrics(scored: DataFrame, severity: str = "predicted_claim_severity") -> DataFrame:
    """RMSE, MAE, means and mean Gamma deviance over positive claims."""
    actual, predicted = F.col("ClaimAmount"), F.col(severity)
    return scored.where(actual > 0).agg(
        *_common(actual, predicted),
        F.avg(F.abs(actual - predicted)).alias("mae"),
        F.avg(gamma_unit_deviance(actual, predicted)).alias("gamma_deviance"),
    )
