"""What-if analysis for a whole portfolio: seven variants per policy, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLIP_BOUNDS, POLICY_ID
from ..functions.cleaning import clip, to_number
from .features import canonical_columns

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Scenario:
    name: str
    feature: str
    factor: float = 1.0
    shift: float = 0.0

    def value(self) -> Column:
        changed = to_number(self.feature) * F.lit(self.factor) + F.lit(self.shift)
        return clip(changed, *CLIP_BOUNDS[self.feature])


# --- Fixed values: the standard what-if set -----------------------------------------------------
STANDARD_SCENARIOS = [
    Scenario("vehicle_power_decrease", "VehPower", factor=0.8),
    Scenario("vehicle_power_increase", "VehPower", factor=1.2),
    Scenario("driver_age_decrease", "DrivAge", shift=-10.0),
    Scenario("driver_age_increase", "DrivAge", shift=10.0),
    Scenario("bonus_malus_decrease", "BonusMalus", shift=-20.0),
    Scenario("bonus_malus_increase", "BonusMalus", shift=20.0),
]
BASELINE, NO_FEATURE = "baseline", "none"
_TAGS = ["scenario_name", "changed_feature", "changed_value"]
REPORT_COLUMNS = [
    "policy_id", *_TAGS, "predicted_frequency", "predicted_severity", "final_premium",
    "premium_delta", "premium_delta_pct",
]


def expand_scenarios(df: DataFrame, scenarios: list[Scenario] = STANDARD_SCENARIOS) -> DataFrame:
    """Baseline plus one row per scenario for every policy, by ``explode`` in place."""
    canonical = canonical_columns(df)
    baseline = F.struct(
        F.lit(BASELINE).alias(_TAGS[0]), F.lit(NO_FEATURE).alias(_TAGS[1]), F.lit(None).cast("double").alias(_TAGS[2])
    )
    variants = [
        F.struct(F.lit(s.name).alias(_TAGS[0]), F.lit(s.feature).alias(_TAGS[1]), s.value().alias(_TAGS[2]))
        for s in scenarios
    ]
    exploded = canonical.withColumn("__variant", F.explode(F.array(baseline, *variants))).select(
        *[F.col(f"`{c}`") for c in canonical.columns], "__variant.*"
    )
    changed = dict.fromkeys(s.feature for s in scenarios)
    return exploded.withColumns({
        feature: F.when(F.col("changed_feature") == feature, F.col("changed_value")).otherwise(to_number(feature))
        for feature in changed
    })


def scored_scenarios(df: DataFrame, score: Scorer, scenarios: list[Scenario] = STANDARD_SCENARIOS) -> DataFrame:
    """Scored variants with ``baseline_premium``.

    The baseline is priced before the explode and rides along in the row, which spares the
    self-join or window that would otherwise pair each variant with its baseline. ``score``
    must keep the columns it is given.
    """
    canonical = canonical_columns(df)
    # Variants start from the values as given, not from the filled and clipped ones.
    given = F.struct(*[F.col(f"`{c}`") for c in canonical.columns]).alias("__given")
    base = score(canonical.select("*", given)).select("__given.*", F.col("final_premium").alias("baseline_premium"))
    return score(expand_scenarios(base, scenarios)).withColumns({
        "premium_delta": F.col("final_premium") - F.col("baseline_premium"),
        "premium_delta_pct": (F.col("final_premium") - F.col("baseline_premium"))
        / F.greatest("baseline_premium", F.lit(1e-9)) * F.lit(100.0),
    })


def scenario_report(scored: DataFrame) -> DataFrame:
    """The nine report columns, one row per policy and scenario."""
    return scored.select(
        F.coalesce(F.col(POLICY_ID).cast("long"), F.lit(0)).alias("policy_id"),
        *_TAGS,
        F.col("predicted_annual_frequency").alias("predicted_frequency"),
        F.col("predicted_claim_severity").alias("predicted_severity"),
        "final_premium", "premium_delta", "premium_delta_pct",
    )


def simulate_scenarios(df: DataFrame, score: Scorer, scenarios: list[Scenario] = STANDARD_SCENARIOS) -> DataFrame:
    return scenario_report(scored_scenarios(df, score, scenarios))


def premium_curves(scored: DataFrame, features: tuple[str, ...] = ("VehPower", "DrivAge", "BonusMalus")) -> DataFrame:
    """(policy_id, feature, feature_value, final_premium): the points of each policy's curve.

    A baseline row belongs to every curve, a changed row to its own feature's curve only.
    """
    points = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("feature_value")) for f in features])
    own = F.col("changed_feature").isin("none") | (F.col("changed_feature") == F.col("feature"))
    return (
        scored.select(F.col(POLICY_ID).alias("policy_id"), "changed_feature", "final_premium", F.inline(points))
        .where(own)
        .select("policy_id", "feature", "feature_value", "final_premium")
    )


def sensitivity(report: DataFrame) -> DataFrame:
    """Portfolio view: mean premium and mean change per scenario."""
    return report.groupBy("scenario_name", "changed_feature").agg(
        F.count(F.lit(1)).alias("policies"),
        F.avg("final_premium").alias("avg_premium"),
        F.avg("premium_delta").alias("avg_delta"),
        F.avg("premium_delta_pct").alias("avg_delta_pct"),
    )
