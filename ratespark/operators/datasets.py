"""Policy and claim cleaning, their joins and the data-quality summary."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    CLAIM_AMOUNT,
    CLAIM_COUNT,
    EXPOSURE,
    EXPOSURE_FLOOR,
    FREQUENCY_COLUMNS,
    MODEL_CATEGORICAL,
    POLICY_ID,
    RATED_NUMERIC,
    RATING_COLUMNS,
    SEVERITY_COLUMNS,
    UNKNOWN_CATEGORY,
)
from ..functions.cleaning import clip, text_or, to_number, whole_id
from .features import engineer_features
from .validate import require_columns


#: What training reads of the policies; everything else would only fill the cache.
TRAINING_COLUMNS = [POLICY_ID, CLAIM_COUNT, *RATING_COLUMNS, "LogDensity", "has_claim", "premium_paid"]


class ModelData(NamedTuple):
    policies: DataFrame
    claims: DataFrame
    quality: DataFrame


def clean_frequency_data(
    df: DataFrame, numeric_defaults: dict | None = None, categorical_defaults: dict | None = None,
    batch_defaults: bool = True,
) -> DataFrame:
    """One model-ready row per policy; rows without an id are dropped."""
    require_columns(df, FREQUENCY_COLUMNS, "Frequency dataset")
    numbers = df.withColumns({c: to_number(c) for c in [CLAIM_COUNT, *RATED_NUMERIC]})
    cleaned = numbers.withColumns({
        POLICY_ID: whole_id(df, POLICY_ID),
        CLAIM_COUNT: F.rint(clip(F.coalesce(CLAIM_COUNT, F.lit(0.0)), 0.0)).cast("int"),
        EXPOSURE: clip(F.coalesce(EXPOSURE, F.lit(1.0)), EXPOSURE_FLOOR),
        **{c: text_or(c, UNKNOWN_CATEGORY) for c in MODEL_CATEGORICAL},
    }).where(F.col(POLICY_ID).isNotNull())
    # Exposure and categories are complete here, so no batch default can be needed for them.
    complete = {EXPOSURE: 1.0, **(numeric_defaults or {})}
    categories = {**{c: UNKNOWN_CATEGORY for c in MODEL_CATEGORICAL}, **(categorical_defaults or {})}
    featured = engineer_features(cleaned, complete, categories, batch_defaults)
    return featured.withColumns({
        "has_claim": (F.col(CLAIM_COUNT) > 0).cast("int"),
        "observed_claim_frequency": F.col(CLAIM_COUNT) / F.col(EXPOSURE),
    })


def clean_severity_data(df: DataFrame) -> DataFrame:
    """Paid claims only: known policy id and a positive amount."""
    require_columns(df, SEVERITY_COLUMNS, "Severity dataset")
    return df.withColumns({
        POLICY_ID: whole_id(df, POLICY_ID),
        CLAIM_AMOUNT: to_number(CLAIM_AMOUNT),
    }).where(F.col(POLICY_ID).isNotNull() & (F.col(CLAIM_AMOUNT) > 0))


def claim_totals(claims: DataFrame) -> DataFrame:
    """Total claim amount per policy (partial aggregation absorbs a hot policy)."""
    return claims.groupBy(POLICY_ID).agg(F.sum(CLAIM_AMOUNT).alias("TotalClaimAmount"))


def attach_claim_totals(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Policies with total and average claim amount; claims are aggregated before the join."""
    total = F.coalesce("TotalClaimAmount", F.lit(0.0))
    return (
        policies.join(claim_totals(claims), POLICY_ID, "left")
        .withColumn("TotalClaimAmount", total)
        .withColumn(
            "AverageClaimAmount",
            F.when(F.col(CLAIM_COUNT) > 0, F.col("TotalClaimAmount") / F.greatest(CLAIM_COUNT, F.lit(1)))
            .otherwise(F.lit(0.0)),
        )
    )


def hot_keys(df: DataFrame, key: str, share: float = 0.001) -> list:
    """Keys that hold more than ``share`` of the rows.

    A sketch names at most 1/share candidates; their rows are then counted, which removes the
    many false ones of a table without skew. Two narrow passes, no shuffle of rows.
    """
    candidates = df.where(F.col(key).isNotNull()).stat.freqItems([key], share).first()[0]
    if not candidates:
        return []
    named = F.when(F.col(key).isin(list(candidates)), F.col(key)).alias("name")
    counts = {r["name"]: r["rows"] for r in df.groupBy(named).agg(F.count(F.lit(1)).alias("rows")).collect()}
    return [name for name, rows in counts.items() if name is not None and rows > share * sum(counts.values())]


def join_on_skewed_key(
    facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot: Sequence | None = None, salts: int = 32
) -> DataFrame:
    """Join facts to a lookup however skewed the facts are on ``key``.

    Facts of hot keys are spread over ``salts`` sub-keys and meet that many copies of the hot
    keys' lookup rows; all other facts take the ordinary join. ``hot`` only steers the physical
    plan: every fact is joined exactly once for any list.
    """
    keys = hot_keys(facts, key) if hot is None else list(hot)
    if not keys:
        return facts.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    # Deterministic under task retries; the partition id also separates identical rows.
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *facts.columns), F.lit(salts)).cast("int")
    salted = facts.where(is_hot).withColumn("__salt", salt)
    copies = lookup.where(F.col(key).isin(keys)).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    spread = salted.join(copies, [key, "__salt"], how).drop("__salt")
    return spread.unionByName(facts.where(~is_hot).join(lookup, key, how))


def claims_with_factors(claims: DataFrame, policies: DataFrame, hot: Sequence | None = None) -> DataFrame:
    """Each paid claim with the rating factors of its policy.

    Policies with very many claims are looked for first (two narrow passes over the claims) and split; pass the list
    when it is known. Keys below the share are left to adaptive execution, which splits large join partitions.
    """
    factors = policies.select(POLICY_ID, *RATING_COLUMNS, "LogDensity")
    return join_on_skewed_key(claims, factors, POLICY_ID, hot=hot).where(F.col(CLAIM_AMOUNT) > 0)


def orphan_claims(claims: DataFrame, policies: DataFrame) -> DataFrame:
    return claims.join(policies.select(POLICY_ID), POLICY_ID, "left_anti")


def data_quality(policies: DataFrame, claims: DataFrame) -> DataFrame:
    """Seven counters in one row, from one join of policies with claims, both folded by policy first."""
    folded = policies.groupBy(POLICY_ID).agg(
        F.count(F.lit(1)).alias("__rows"), F.count_if(F.col(CLAIM_COUNT) > 0).alias("__claimed")
    )
    totals = claims.groupBy(POLICY_ID).agg(
        F.sum(CLAIM_AMOUNT).alias("__total"), F.count(F.lit(1)).alias("__claims")
    )
    is_policy = F.col("__rows").isNotNull()
    paid = F.coalesce("__total", F.lit(0.0)) > 0
    counted = folded.join(totals, POLICY_ID, "full").agg(
        _rows(F.col("__rows")).alias("frequency_rows"),
        _rows(F.col("__claimed")).alias("policies_with_claims"),
        _rows(F.when(paid, F.col("__rows"))).alias("policies_with_paid_amounts"),
        _rows(F.when(~paid, F.col("__claimed"))).alias("positive_claim_count_without_paid_amount"),
        _rows(F.col("__claims")).alias("severity_rows"),
        _rows(F.when(~is_policy, F.col("__claims"))).alias("severity_rows_without_matching_policy"),
        _rows(F.when(is_policy, F.col("__claims"))).alias("claim_rows_used_for_severity_model"),
    )
    return counted.select(
        "frequency_rows", "severity_rows", "policies_with_claims", "policies_with_paid_amounts",
        "positive_claim_count_without_paid_amount", "severity_rows_without_matching_policy",
        "claim_rows_used_for_severity_model",
    )


def _rows(counts):
    return F.coalesce(F.sum(counts), F.lit(0)).cast("long")


def prepare_model_datasets(raw_policies: DataFrame, raw_claims: DataFrame, **clean_options) -> ModelData:
    """Clean both tables and align them for training.

    Claims take their factors from the same columns that training persists, so policies are cleaned once for both.
    """
    frequency = clean_frequency_data(raw_policies, **clean_options)
    severity = clean_severity_data(raw_claims)
    policies = attach_claim_totals(frequency, severity)
    return ModelData(
        policies, claims_with_factors(severity, training_policies(policies), hot=None), data_quality(frequency, severity)
    )


def training_policies(policies: DataFrame) -> DataFrame:
    return policies.select(*[c for c in TRAINING_COLUMNS if c in policies.columns])
