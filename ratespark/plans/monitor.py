"""Drift of the current models against stored outcomes."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OUTCOME_COLUMNS, RATING_COLUMNS
from ..operators.drift import drift_report
from ..schemas import canonical_case
from ..sources.store import read_table
from .score import scorer

PREDICTED = ["predicted_annual_frequency", "predicted_claim_severity"]


def scored_outcomes(portfolios: DataFrame, artifacts: Mapping[str, Any]) -> DataFrame:
    """Outcome records with the current models' predictions.

    Portfolios are stored without predictions, so they are scored here rather than trusted to
    carry them. A missing or zero exposure counts as a full year.
    """
    known = canonical_case(portfolios, [*RATING_COLUMNS, *OUTCOME_COLUMNS]).select(*RATING_COLUMNS, *OUTCOME_COLUMNS)
    full_year = F.coalesce(F.nullif("Exposure", F.lit(0.0)), F.lit(1.0))
    # The amount is set aside: it would otherwise be taken for the claim column of a training row.
    renamed = known.withColumn("Exposure", full_year).withColumnRenamed("claim_amount", "outcome_amount")
    return scorer(artifacts)(renamed).select(
        "Exposure", "claim_occurred", F.col("outcome_amount").alias("claim_amount"), *PREDICTED
    )


def drift_check(spark: SparkSession, store: str, artifacts: Mapping[str, Any], exact: bool = True) -> DataFrame:
    """(component, metric, value, status) for the stored portfolios; reads only."""
    return drift_report(scored_outcomes(read_table(spark, store, "b2b_portfolios"), artifacts), exact)
