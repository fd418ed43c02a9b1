"""The training job: split, evaluate, compare, refit, price, report, persist."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..config import (
    CLAIM_AMOUNT,
    POLICY_ID,
    RANDOM_SEED,
    RATING_COLUMNS,
    TEST_SIZE,
    ExperimentConfig,
    ModelConfig,
    PricingConfig,
)
from ..operators.datasets import ModelData, prepare_model_datasets, training_policies
from ..operators.models import train_frequency_model, train_severity_model
from ..operators.pricing import baselines_dict, calculate_premium, portfolio_baselines, risk_thresholds, top_premiums
from ..operators.retraining import MIN_ROWS, combine_records, require_min_rows, retraining_frames, retraining_quality
from ..operators.sampling import stratified_split
from ..operators.stats import build_metadata, categorical_options
from ..runtime import materialise
from ..sources.artifacts import record_run, save_artifacts, write_csv_report, write_json
from ..sources.readers import load_frequency_data, load_severity_data, table_fingerprint
from ..sources.store import fetch_training_data
from .experiments import run_model_comparison

# What training reads; everything else would only fill the cache.
CLAIM_COLUMNS = [POLICY_ID, "claim_seq", CLAIM_AMOUNT, *RATING_COLUMNS, "LogDensity"]


def policy_key() -> Column:
    return F.col("IDpol")


def numbered_claims(claims: DataFrame) -> DataFrame:
    """Claims with a ``claim_seq`` that tells even identical rows apart.

    Numbers made here are written with the rows: they must not change when a task is repeated.
    """
    if "claim_seq" in claims.columns:
        return claims
    return materialise(claims.withColumn("claim_seq", F.monotonically_increasing_id()))


def claim_key() -> Column:
    return F.concat_ws("-", F.col("IDpol").cast("string"), F.col("claim_seq").cast("string"))


def split_claims(claims: DataFrame, test_size: float = TEST_SIZE, seed: int = RANDOM_SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the claims, without strata."""
    one = claims.withColumn("__all", F.lit(1))
    train, test = stratified_split(one, claim_key(), "__all", test_size, seed)
    return train.drop("__all"), test.drop("__all")


def run_training(
    spark: SparkSession,
    policies: DataFrame,
    claims: DataFrame,
    quality: dict[str, int],
    out: str,
    models: ModelConfig = ModelConfig(),
    experiments: ExperimentConfig = ExperimentConfig(),
    pricing: PricingConfig = PricingConfig(),
    test_size: float = TEST_SIZE,
    dataset_version: Any = None,
) -> dict[str, Any]:
    """Train, evaluate and write everything under ``out``. Returns metrics and metadata."""
    policies = training_policies(policies).persist()
    claims = numbered_claims(claims.select(*[c for c in CLAIM_COLUMNS if c in claims.columns])).persist()
    try:
        train_p, test_p = stratified_split(policies, policy_key(), "has_claim", test_size)
        train_c, test_c = split_claims(claims, test_size)
        metrics = {
            "frequency": {
                "selected_model": models.frequency_model,
                **train_frequency_model(train_p, config=models).evaluate(test_p).first().asDict(),
            },
            "severity": {
                "selected_model": models.severity_model,
                **train_severity_model(train_c, config=models).evaluate(test_c).first().asDict(),
            },
        }
        if experiments.enabled:
            results, premiums = run_model_comparison(
                train_p, test_p, train_c, test_c, policy_key(), claim_key(), experiments, models, pricing=pricing
            )
            write_json(spark, results, f"{out}/evaluation/model_comparison")
            write_csv_report(premiums, f"{out}/reports/model_comparison", decimals=6)

        frequency = train_frequency_model(policies, config=models)
        severity = train_severity_model(claims, config=models)
        predicted = severity.transform(frequency.transform(policies))
        base = baselines_dict(
            portfolio_baselines(predicted, "predicted_annual_frequency", "predicted_claim_severity", pricing)
        )
        scored = calculate_premium(
            predicted, "predicted_annual_frequency", "predicted_claim_severity", pricing, risk_thresholds(pricing), base
        )
        write_csv_report(top_premiums(scored), f"{out}/reports/top_premiums")

        metadata = build_metadata(
            policies,
            trained_at_utc=datetime.now(timezone.utc).isoformat(),
            random_seed=RANDOM_SEED,
            risk_thresholds=risk_thresholds(pricing),
            portfolio_baselines=base,
            pricing_config=asdict(pricing),
            modeling_config=asdict(models),
            dataset_summary={"policy_rows": policies.count(), "claim_rows": claims.count()},
            data_quality=quality,
        )
        save_artifacts(spark, f"{out}/models", frequency, severity, metadata, metrics, categorical_options(policies))
        run_id = record_run(
            spark, f"{out}/runs", model_parameters=asdict(models), evaluation_metrics=metrics,
            dataset_version=dataset_version or {}, dataset_summary=metadata["dataset_summary"],
            data_quality=quality, pricing_config=asdict(pricing),
        )
    finally:
        claims.unpersist()
        policies.unpersist()
    return {"metrics": metrics, "metadata": metadata, "run_id": run_id}


def load_and_train(spark: SparkSession, policies_csv: str, claims_csv: str, out: str, **options: Any) -> dict[str, Any]:
    """Read, check, clean and align both tables, then train; the run records their fingerprints."""
    policies, claims = load_frequency_data(spark, policies_csv), load_severity_data(spark, claims_csv)
    version = {
        name: {"path": path, **{k: str(v) for k, v in table_fingerprint(df).first().asDict().items()}}
        for name, path, df in (("policies", policies_csv, policies), ("claims", claims_csv, claims))
    }
    return train_on(spark, prepare_model_datasets(policies, claims), out, dataset_version=version, **options)


def train_on(spark: SparkSession, data: ModelData, out: str, **options: Any) -> dict[str, Any]:
    return run_training(spark, data.policies, data.claims, data.quality.first().asDict(), out, **options)


def bundled_if_present(spark: SparkSession, policies_csv: str, claims_csv: str) -> ModelData | None:
    """The bundled portfolio, or None when one of its files is absent."""
    try:
        policies, claims = load_frequency_data(spark, policies_csv), load_severity_data(spark, claims_csv)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem.getCondition()):
            return None
        raise
    return prepare_model_datasets(policies, claims)


def retrain(
    spark: SparkSession, store: str, out: str, minimum: int = MIN_ROWS, bundled: ModelData | None = None, **options: Any
) -> dict[str, Any]:
    """Train on stored quotes and portfolios, blended with a bundled portfolio when given."""
    tables = fetch_training_data(spark, store)
    records = combine_records(tables["training_data"], tables["b2b_portfolios"])
    require_min_rows(records, minimum)
    policies, claims = retraining_frames(
        records, bundled.policies if bundled else None, bundled.claims if bundled else None
    )
    quality = retraining_quality(policies, claims).first().asDict()
    return run_training(spark, policies, claims, quality, out, **options)
