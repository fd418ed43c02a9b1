"""Model comparison: every frequency/severity pair, each model fitted once."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product
from time import perf_counter
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ExperimentConfig, ModelConfig, PricingConfig
from ..functions.rating import priced_exposure, technical_premium
from ..functions.cleaning import clip
from ..operators.models import FREQUENCY, SEVERITY, FittedModel, Role, train_model
from ..operators.sampling import experiment_sample

# --- Fixed values: run-key abbreviations and the families of the premium table ----------------------
SHORT_NAMES = {"random_forest": "rf", "xgboost": "xgb", "boosted": "boost"}
FAMILIES = {
    "glm": ("poisson", "gamma"),
    "rf": ("random_forest", "random_forest"),
    "xgb": ("xgboost", "xgboost"),
}


@dataclass
class Attempt:
    """One model of one role: fitted with its metrics, or the reason why not."""

    status: str
    seconds: float
    model: FittedModel | None = None
    metrics: dict | None = None
    error: str | None = None


def run_key(frequency: str, severity: str) -> str:
    return f"{SHORT_NAMES.get(frequency, frequency)}_{SHORT_NAMES.get(severity, severity)}"


def comparison_model_config(base: ModelConfig, config: ExperimentConfig) -> ModelConfig:
    """The model settings with the smaller tree counts of the comparison."""
    def smaller(role):
        return replace(
            role,
            forest=replace(role.forest, trees=config.forest_trees or role.forest.trees),
            boost=replace(role.boost, trees=config.boost_trees or role.boost.trees),
        )

    return replace(base, frequency=smaller(base.frequency), severity=smaller(base.severity))


def _attempt(role: Role, name: str, train: DataFrame, test: DataFrame, config: ModelConfig) -> Attempt:
    started = perf_counter()
    try:
        model = train_model(train, role, name, config)
        row = model.evaluate(test).first().asDict()
    except ImportError as missing:
        return Attempt("skipped", perf_counter() - started, error=str(missing))
    except Exception as problem:  # one broken model must not end the comparison
        return Attempt("failed", perf_counter() - started, error=str(problem))
    distribution = {k: row.pop(k) for k in ("observed_mean", "predicted_mean")}
    metrics = {
        "model_name": name, "evaluation_split": "test", "sample_size": row.pop("sample_size"),
        "metrics": row, "distribution": distribution,
    }
    return Attempt("success", perf_counter() - started, model, metrics)


def run_model_comparison(
    frequency_train: DataFrame,
    frequency_test: DataFrame,
    severity_train: DataFrame,
    severity_test: DataFrame,
    frequency_key: Column,
    severity_key: Column,
    config: ExperimentConfig = ExperimentConfig(),
    models: ModelConfig = ModelConfig(),
    scoring: DataFrame | None = None,
    pricing: PricingConfig = PricingConfig(),
) -> tuple[dict[str, Any], DataFrame]:
    """(results per pair, premium table of the scoring frame or the frequency test set)."""
    settings = comparison_model_config(models, config)
    samples = {
        FREQUENCY: experiment_sample(frequency_train, frequency_key, config.sample_fraction, config.max_frequency_rows),
        SEVERITY: experiment_sample(severity_train, severity_key, config.sample_fraction, config.max_severity_rows),
    }
    plan = [
        (FREQUENCY, config.frequency_models, frequency_test),
        (SEVERITY, config.severity_models, severity_test),
    ]
    attempts: dict[tuple[str, str], Attempt] = {}
    for role, names, test in plan:
        train = samples[role].persist()
        for name in names:
            attempts[role.name, name] = _attempt(role, name, train, test, settings)
        train.unpersist()

    results = {
        run_key(f, s): _combined(f, s, attempts["frequency", f], attempts["severity", s])
        for f, s in product(config.frequency_models, config.severity_models)
    }
    for role, names, _ in plan:
        if all(attempts[role.name, name].status == "failed" for name in names):
            raise RuntimeError(f"No {role.name} model could be fitted: {attempts[role.name, names[0]].error}")
    return results, premium_table(frequency_test if scoring is None else scoring, attempts, pricing)


def _combined(frequency_name: str, severity_name: str, frequency: Attempt, severity: Attempt) -> dict[str, Any]:
    run = {
        "frequency_model": frequency_name, "severity_model": severity_name,
        "duration_seconds": frequency.seconds + severity.seconds,
    }
    for attempt in (frequency, severity):
        if attempt.status != "success":
            return {"status": attempt.status, **run, "error": attempt.error}
    return {"status": "success", **run, "metrics": {"frequency": frequency.metrics, "severity": severity.metrics}}


def premium_table(
    df: DataFrame, attempts: dict[tuple[str, str], Attempt], pricing: PricingConfig = PricingConfig()
) -> DataFrame:
    """policy_id with frequency, severity and premium of each model family.

    The families' models transform the same rows one after the other, so nothing is joined.
    A family without fitted models has null columns.
    """
    scored, columns = df, [F.coalesce(F.col("IDpol"), F.lit(0)).cast("long").alias("policy_id")]
    for family, (frequency_name, severity_name) in FAMILIES.items():
        pair = [attempts.get(("frequency", frequency_name)), attempts.get(("severity", severity_name))]
        names = [f"{family}_predicted_frequency", f"{family}_predicted_severity", f"{family}_premium"]
        if not all(a is not None and a.model is not None for a in pair):
            columns += [F.lit(None).cast("double").alias(n) for n in names]
            continue
        scored = pair[1].model.transform(pair[0].model.transform(scored, names[0]), f"__sev_{family}")
        severity = F.col(f"__sev_{family}") * F.lit(pricing.fx_rate)
        pure = F.col(names[0]) * priced_exposure(F.col("Exposure")) * severity
        premium = clip(technical_premium(pure, pricing), pricing.minimum_premium)
        columns += [F.col(names[0]), severity.alias(names[1]), premium.alias(names[2])]
    return scored.select(*columns)
