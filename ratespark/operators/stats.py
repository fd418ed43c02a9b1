"""Training-time statistics: defaults, ranges, options and the metadata built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORICAL_DEFAULTS, COLUMN_ALIASES, MODEL_CATEGORICAL, NUMERIC_DEFAULTS, RATED_NUMERIC
from ..config import SIMULATED_ALIASES
from ..functions.cleaning import strip
from .ranking import approx_quantiles, exact_quantiles, modes, unpivot


def numeric_medians(
    df: DataFrame, columns: Sequence[str] = tuple(RATED_NUMERIC), exact: bool = True, count: str | None = None
) -> DataFrame:
    """(feature, value): median per column; ``count`` names how many rows a row stands for (exact medians only)."""
    found = exact_quantiles(df, columns, {"median": 0.5}, count) if exact else approx_quantiles(df, columns, {"median": 0.5})
    return found.select("feature", F.col("median").alias("value"))


def categorical_modes(df: DataFrame, columns: Sequence[str] = tuple(MODEL_CATEGORICAL)) -> DataFrame:
    """(feature, value): most frequent trimmed non-empty text per column, smallest on ties."""
    trimmed = df.select(*[F.nullif(strip(c), F.lit("")).alias(c) for c in columns])
    return modes(trimmed, columns)


def numeric_ranges(df: DataFrame, columns: Sequence[str] = tuple(RATED_NUMERIC)) -> DataFrame:
    """(feature, min_value, max_value) from one global aggregate."""
    extremes = df.agg(
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(columns)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"lo_{i}").alias("min_value"), F.col(f"hi_{i}").alias("max_value")
        )
        for i, c in enumerate(columns)
    ]
    return extremes.select(F.inline(F.array(*rows)))


def categorical_options(df: DataFrame, columns: Sequence[str] = tuple(MODEL_CATEGORICAL)) -> DataFrame:
    """Distinct (feature, option) pairs; long form, so a dirty column cannot fill one task."""
    return unpivot(df.select(*[F.col(c).cast("string").alias(c) for c in columns]), columns, value="option").distinct()


def default_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], exact: bool = True) -> dict:
    """Driver-side defaults: one value per column, global constants where a column has none."""
    found: dict = {}
    if numeric:
        found |= {r.feature: r.value for r in numeric_medians(df, numeric, exact).collect()}
    if categorical:
        found |= {r.feature: r.value for r in categorical_modes(df, categorical).collect()}
    constants = {**NUMERIC_DEFAULTS, **CATEGORICAL_DEFAULTS}
    return {name: found.get(name, constants[name]) for name in [*numeric, *categorical]}


def build_metadata(policies: DataFrame, exact: bool = True, **sections) -> dict:
    """Everything inference needs, as a JSON-ready dict; ``sections`` are added unchanged.

    The category options, of which there may be any number, are a table of their own (:func:`categorical_options`),
    which ``save_artifacts`` stores beside the metadata.
    """
    ranges = {r.feature: {"min": r.min_value, "max": r.max_value} for r in numeric_ranges(policies).collect()}
    return {
        "numeric_defaults": default_values(policies, RATED_NUMERIC, [], exact),
        "categorical_defaults": default_values(policies, [], MODEL_CATEGORICAL),
        "supported_input_aliases": COLUMN_ALIASES,
        "optional_simulated_features": list(SIMULATED_ALIASES),
        "numeric_ranges": ranges,
        **sections,
    }
