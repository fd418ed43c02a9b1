"""From predicted frequency and severity to premiums, relativities and risk bands."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EXPOSURE, POLICY_ID, RISK_BANDS, PricingConfig
from ..functions.cleaning import clip, safe_ratio, to_number
from ..functions.rating import priced_exposure, risk_band, technical_premium

BASELINE_KEYS = ["annual_frequency", "claim_severity", "annualized_expected_loss"]


def risk_thresholds(config: PricingConfig = PricingConfig()) -> dict[str, float]:
    """Absolute underwriting limits on the annualized expected loss."""
    return {"low_max": config.low_max, "medium_max": config.medium_max}


def portfolio_baselines(
    df: DataFrame, frequency: str | Column, severity: str | Column, config: PricingConfig = PricingConfig()
) -> DataFrame:
    """One row: mean frequency, severity and their product, each held above its floor."""
    freq, sev = _non_negative(frequency), _non_negative(severity)
    floors = [config.frequency_baseline_floor, config.baseline_floor, config.baseline_floor]
    means = [F.avg(freq), F.avg(sev), F.avg(freq * sev)]
    return df.agg(*[
        F.greatest(mean, F.lit(float(floor))).alias(key) for key, mean, floor in zip(BASELINE_KEYS, means, floors)
    ])


def baselines_dict(baselines: DataFrame) -> dict[str, float]:
    return baselines.first().asDict()


def calculate_premium(
    df: DataFrame,
    frequency: str | Column,
    severity: str | Column,
    config: PricingConfig = PricingConfig(),
    thresholds: Mapping[str, float] | None = None,
    baselines: Mapping[str, float] | DataFrame | None = None,
) -> DataFrame:
    """Add the thirteen premium columns.

    ``baselines`` given in the model's currency are converted by the FX rate. Without them the
    batch's own means are used, from one aggregate whose single row is broadcast back.
    """
    fx = F.lit(config.fx_rate)
    limits = dict(thresholds or risk_thresholds(config))
    priced = df.withColumns({
        "predicted_annual_frequency": _non_negative(frequency),
        "predicted_claim_severity": _non_negative(severity) * fx,
    })
    if baselines is None:
        own = portfolio_baselines(priced, "predicted_annual_frequency", "predicted_claim_severity", config)
        priced, base = _with_one_row(priced, own, F.lit(1.0))
    elif isinstance(baselines, DataFrame):
        priced, base = _with_one_row(priced, baselines, fx)
    else:
        base = {
            key: F.lit(float(baselines[key])) * (F.lit(1.0) if key == "annual_frequency" else fx)
            for key in BASELINE_KEYS
        }
    base_frequency = F.greatest(base["annual_frequency"], F.lit(config.frequency_baseline_floor))
    base_severity = F.greatest(base["claim_severity"], F.lit(config.baseline_floor))
    base_loss = F.greatest(base["annualized_expected_loss"], F.lit(config.baseline_floor))

    freq, sev = F.col("predicted_annual_frequency"), F.col("predicted_claim_severity")
    count = freq * priced_exposure(F.col(EXPOSURE))
    technical = technical_premium(F.col("expected_loss"), config)
    return (
        priced.withColumns({"predicted_claim_count": count, "annualized_expected_loss": freq * sev})
        .withColumn("expected_loss", F.col("predicted_claim_count") * sev)
        .withColumns({
            "pure_premium": F.col("expected_loss"),
            "technical_premium": technical,
            "loaded_premium": technical,
            "final_premium": clip(technical, config.minimum_premium),
            "frequency_relativity": freq / base_frequency,
            "severity_relativity": sev / base_severity,
            "risk_score": F.lit(config.risk_score_scale) * F.col("annualized_expected_loss") / base_loss,
            "risk_category": risk_band(F.col("annualized_expected_loss"), limits["low_max"], limits["medium_max"]),
        })
        .drop(*[f"__base_{key}" for key in BASELINE_KEYS])
    )


def _with_one_row(df: DataFrame, baselines: DataFrame, fx: Column) -> tuple[DataFrame, dict[str, Column]]:
    one_row = baselines.select(*[F.col(key).alias(f"__base_{key}") for key in BASELINE_KEYS])
    joined = df.crossJoin(F.broadcast(one_row))
    base = {key: F.col(f"__base_{key}") for key in BASELINE_KEYS}
    return joined, {key: value if key == "annual_frequency" else value * fx for key, value in base.items()}


def _non_negative(column: str | Column) -> Column:
    return clip(to_number(column), 0.0)


def segment_rates(policies: DataFrame, claims: DataFrame, segment: str = "Area") -> DataFrame:
    """(segment, rate_frequency, rate_severity): observed rates, i.e. a one-factor model.

    Claims are folded to one row per policy before they meet the policies, so a policy with very
    many claims ships one row; then one join and one grouping give both rates.
    """
    per_policy = claims.groupBy(POLICY_ID).agg(
        F.sum("ClaimAmount").alias("__paid"), F.count(F.lit(1)).alias("__claims")
    )
    joined = policies.select(POLICY_ID, segment, "ClaimNb", EXPOSURE).join(per_policy, POLICY_ID, "left")
    return joined.groupBy(segment).agg(
        (F.sum("ClaimNb") / F.sum(EXPOSURE)).alias("rate_frequency"),
        safe_ratio(F.sum("__paid"), F.sum("__claims")).alias("rate_severity"),
    )


def with_segment_rates(policies: DataFrame, rates: DataFrame, segment: str = "Area") -> DataFrame:
    """Policies with the rates of their segment; adaptive execution broadcasts the rates if they turn out small."""
    return policies.join(rates, segment, "left")


def risk_band_counts(scored: DataFrame) -> DataFrame:
    """Policies per band in fixed order, zero included: one aggregate, three output rows."""
    counts = scored.agg(*[F.count_if(F.col("risk_category") == band).alias(band) for band in RISK_BANDS])
    rows = [
        F.struct(F.lit(i).alias("band_order"), F.lit(band).alias("risk_category"), F.col(band).alias("policies"))
        for i, band in enumerate(RISK_BANDS, start=1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def premium_summary(scored: DataFrame) -> DataFrame:
    """Total, band counts and premium mean / min / max in one pass."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_category") == band).alias(f"{band.lower()}_count") for band in RISK_BANDS],
        F.avg("final_premium").alias("avg_premium"),
        F.min("final_premium").alias("min_premium"),
        F.max("final_premium").alias("max_premium"),
    )


# --- Fixed values: columns of the highest-premium report ---------------------------------------
TOP_PREMIUM_COLUMNS = [
    "IDpol", "Exposure", "predicted_annual_frequency", "predicted_claim_count", "predicted_claim_severity",
    "annualized_expected_loss", "expected_loss", "pure_premium", "final_premium", "risk_score", "risk_category",
]


def top_premiums(scored: DataFrame, top_n: int = 1000) -> DataFrame:
    """The report of the ``top_n`` dearest policies (ties by id)."""
    return scored.select(*TOP_PREMIUM_COLUMNS).orderBy(F.desc("final_premium"), POLICY_ID).limit(top_n)
