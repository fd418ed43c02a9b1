"""Scoring with saved artifacts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..config import POLICY_ID, PricingConfig
from ..operators.features import build_inference_frame, canonical_columns, fill_policy_ids
from ..operators.pricing import calculate_premium
from ..operators.scenarios import scenario_report, scored_scenarios
from ..sources.artifacts import load_artifacts, write_csv_report
from ..sources.readers import read_scoring_csv


def pricing_config(metadata: Mapping[str, Any]) -> PricingConfig:
    saved = metadata.get("pricing_config") or {}
    return PricingConfig(**saved)


def price(prepared: DataFrame, artifacts: Mapping[str, Any]) -> DataFrame:
    """Both models and the premium columns for rows that went through the feature path."""
    metadata = artifacts["metadata"]
    scored = artifacts["severity_model"].transform(artifacts["frequency_model"].transform(prepared))
    return calculate_premium(
        scored, "predicted_annual_frequency", "predicted_claim_severity", pricing_config(metadata),
        metadata.get("risk_thresholds"), metadata.get("portfolio_baselines"),
    )


def predict_premiums(
    df: DataFrame, artifacts: Mapping[str, Any], check: bool = True, missing_ids: str = "hash"
) -> DataFrame:
    """Arbitrary policy rows -> priced rows; rows without an id get a stable one below zero unless positions are asked for."""
    prepared = build_inference_frame(
        df, artifacts["metadata"], check_rows=check, check_values=check, missing_ids=missing_ids
    )
    return price(prepared, artifacts)


def scorer(artifacts: Mapping[str, Any]) -> Callable[[DataFrame], DataFrame]:
    """A job-free scoring function, for scenarios and streams."""
    def score(df: DataFrame) -> DataFrame:
        prepared = build_inference_frame(
            df, artifacts["metadata"], check_rows=False, check_values=False, batch_defaults=False, missing_ids="keep"
        )
        return price(prepared, artifacts)

    return score


def score_csv(spark: SparkSession, source: str, target: str, models: str) -> DataFrame:
    """Score a CSV into a CSV report; returns the malformed input rows."""
    policies, malformed = read_scoring_csv(spark, source)
    # Input without any ids is numbered; a gap in given ids gets a hash, which costs no pass over the rows.
    policies = canonical_columns(policies)
    if POLICY_ID not in policies.columns:
        policies = fill_policy_ids(policies, "file")
    write_csv_report(predict_premiums(policies, load_artifacts(spark, models), missing_ids="hash"), target)
    return malformed


def scenario_csv(spark: SparkSession, source: str, target: str, models: str) -> DataFrame:
    """Scenario report for every policy of a CSV; returns the malformed input rows."""
    policies, malformed = read_scoring_csv(spark, source)
    # Numbered once, before the variants are made, so that all variants of a policy share its id.
    policies = fill_policy_ids(canonical_columns(policies), "file")
    scored = scored_scenarios(policies, scorer(load_artifacts(spark, models)))
    write_csv_report(scenario_report(scored), target, decimals=6)
    return malformed
