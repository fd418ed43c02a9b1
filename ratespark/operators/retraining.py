"""Training frames from stored quotes and insurer portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLAIM_AMOUNT, CLAIM_COUNT, OUTCOME_COLUMNS, POLICY_ID, RATING_COLUMNS
from ..functions.cleaning import to_number
from ..schemas import canonical_case
from .datasets import data_quality
from .features import engineer_features
from .validate import UnusableDataError, has_min_rows

MIN_ROWS = 200

# --- Fixed values: stand-ins for factors missing from a stored record ------------------------------
RECORD_DEFAULTS = {
    "Exposure": 1.0, "VehPower": 6.0, "VehAge": 6.0, "DrivAge": 40.0, "BonusMalus": 60.0,
    "VehBrand": "B12", "VehGas": "Regular", "Area": "C", "Density": 500.0, "Region": "Centre",
}


def record_id(raw: Column) -> Column:
    """A whole-number id as it is; any other id (a UUID) hashed below zero, clear of real ids."""
    text = raw.cast("string")
    hashed = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return F.coalesce(text.try_cast("long"), -(hashed + F.lit(1)))


def record_factors(legacy_zero_as_missing: bool = False) -> dict[str, Column]:
    """Rating factors with stand-ins for nulls (and, in the legacy reading, for zeros)."""
    out: dict[str, Column] = {}
    for name, default in RECORD_DEFAULTS.items():
        if isinstance(default, str):
            text = F.col(name).cast("string")
            out[name] = F.coalesce(F.nullif(text, F.lit("")), F.lit(default))
        else:
            number = to_number(name)
            known = F.nullif(number, F.lit(0.0)) if legacy_zero_as_missing or name == "Exposure" else number
            out[name] = F.coalesce(known, F.lit(default))
    return out


def combine_records(training: DataFrame, b2b: DataFrame) -> DataFrame:
    """Both stored tables in one frame, canonical names, tagged with their origin."""
    names = ["id", *RATING_COLUMNS, *OUTCOME_COLUMNS]
    parts = [
        canonical_case(df, names).withColumn("origin", F.lit(origin))
        for df, origin in ((training, "training_data"), (b2b, "b2b_portfolios"))
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def policy_records(records: DataFrame, legacy_zero_as_missing: bool = False) -> DataFrame:
    """One policy row per record; a claim is a flag or a positive amount."""
    df = canonical_case(records, ["id", *RATING_COLUMNS, *OUTCOME_COLUMNS])
    amount = F.coalesce(to_number("claim_amount"), F.lit(0.0))
    claimed = F.coalesce(F.col("claim_occurred").cast("boolean"), F.lit(False)) | (amount > 0)
    return df.select(
        record_id(F.col("id")).alias(POLICY_ID),
        claimed.cast("int").alias(CLAIM_COUNT),
        *[value.alias(name) for name, value in record_factors(legacy_zero_as_missing).items()],
        F.coalesce(to_number("premium_paid"), F.lit(0.0)).alias("premium_paid"),
    )


def claim_records(records: DataFrame, legacy_zero_as_missing: bool = False) -> DataFrame:
    """One claim row per record with a positive amount."""
    df = canonical_case(records, ["id", *RATING_COLUMNS, *OUTCOME_COLUMNS])
    amount = to_number("claim_amount")
    return df.where(F.coalesce(amount, F.lit(0.0)) > 0).select(
        record_id(F.col("id")).alias(POLICY_ID),
        amount.alias(CLAIM_AMOUNT),
        *[value.alias(name) for name, value in record_factors(legacy_zero_as_missing).items()],
    )


def require_min_rows(records: DataFrame, minimum: int = MIN_ROWS) -> None:
    if not has_min_rows(records, minimum):
        raise UnusableDataError(f"Refusing to retrain: fewer than {minimum} policy rows.")


def retraining_frames(
    records: DataFrame,
    bundled_policies: DataFrame | None = None,
    bundled_claims: DataFrame | None = None,
    legacy_zero_as_missing: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(policies, claims) ready for training, blended with a bundled portfolio when there is one.

    The records are complete after their stand-ins, so no batch default is looked up.
    """
    policies = engineer_features(policy_records(records, legacy_zero_as_missing), batch_defaults=False)
    claims = engineer_features(claim_records(records, legacy_zero_as_missing), batch_defaults=False)
    if bundled_policies is not None and bundled_claims is not None:
        policies = policies.unionByName(bundled_policies, allowMissingColumns=True)
        claims = claims.unionByName(bundled_claims, allowMissingColumns=True)
    return policies.withColumn("has_claim", (F.col(CLAIM_COUNT) > 0).cast("int")), claims


def retraining_quality(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """The seven counters of :func:`data_quality` for a retraining set, and the policies with a paid premium."""
    premiums = policies.agg(F.count_if(F.col("premium_paid") > 0).alias("policies_with_paid_premium"))
    paid = claims.where(F.col(CLAIM_AMOUNT) > 0)
    return data_quality(policies, paid).crossJoin(premiums)  # one row each
