"""Premium, risk-band and deviance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EXPOSURE_FLOOR, RISK_BANDS, PricingConfig
from .cleaning import clip, to_number


def risk_band(annualized_loss: Column, low_max: float, medium_max: float) -> Column:
    """Low / Medium / High; a missing loss counts as High."""
    low, medium, high = RISK_BANDS
    return (
        F.when(annualized_loss <= F.lit(float(low_max)), low)
        .when(annualized_loss <= F.lit(float(medium_max)), medium)
        .otherwise(high)
    )


def priced_exposure(exposure: Column) -> Column:
    return clip(F.coalesce(to_number(exposure), F.lit(1.0)), EXPOSURE_FLOOR)


def technical_premium(pure: Column, config: PricingConfig) -> Column:
    return pure * F.lit(1.0 + config.expense_loading) + F.lit(config.fixed_expense)


def poisson_unit_deviance(actual: Column, predicted: Column) -> Column:
    log_term = F.when(actual > 0, actual * F.ln(actual / predicted)).otherwise(F.lit(0.0))
    return F.lit(2.0) * (log_term - actual + predicted)


def gamma_unit_deviance(actual: Column, predicted: Column) -> Column:
    return F.lit(2.0) * (F.ln(predicted / actual) + actual / predicted - F.lit(1.0))


def md5_order(key: Column, seed: int) -> Column:
    """A seeded, engine-independent pseudo-random sort key (hex text)."""
    return F.md5(F.concat(key.cast("string"), F.lit(":"), F.lit(str(seed))))
