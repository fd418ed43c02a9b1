"""Schema checks, one-pass value checks and the row contract."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COLUMN_ALIASES, RATING_COLUMNS
from ..functions.cleaning import to_number


class UnusableDataError(ValueError):
    """Input does not meet the contract of an operator."""


def require_columns(df: DataFrame, required: Sequence[str], dataset: str) -> None:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise UnusableDataError(
            f"{dataset}: missing required columns {missing}; present are {df.columns}"
        )


def require_pricing_columns(df: DataFrame) -> None:
    """Every rating factor must be there under its own name or an accepted alias."""
    missing = [name for name in RATING_COLUMNS if not set(COLUMN_ALIASES[name]) & set(df.columns)]
    if missing:
        raise UnusableDataError(
            f"Input: missing required pricing columns {missing}, also under their aliases."
        )


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise UnusableDataError("The input is empty; at least one policy row is needed.")


def has_min_rows(df: DataFrame, minimum: int) -> bool:
    """True with at least ``minimum`` rows; reads no further than needed."""
    return df.limit(minimum).count() >= minimum


def value_profile(df: DataFrame, required: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Long frame (column_name, rows, non_null, numeric_ok, missing) from a single pass."""
    wanted = list(dict.fromkeys([*required, *numeric]))
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *_profile_aggregates(wanted, numeric))
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("column_name"),
            F.col(f"set_{i}").alias("non_null"),
            (F.col(f"num_{i}") if name in numeric else F.lit(None).cast("long")).alias("numeric_ok"),
        )
        for i, name in enumerate(wanted)
    ])
    return totals.select("rows", F.inline(entries)).select(
        "column_name", "rows", "non_null", "numeric_ok", (F.col("rows") - F.col("non_null")).alias("missing")
    )


def _profile_aggregates(wanted: Sequence[str], numeric: Sequence[str]) -> list[Column]:
    out = []
    for i, name in enumerate(wanted):
        out.append(F.count(F.col(name)).alias(f"set_{i}"))
        if name in numeric:
            out.append(F.count(to_number(name)).alias(f"num_{i}"))
    return out


def validate_schema(
    df: DataFrame,
    dataset: str,
    required: Sequence[str],
    numeric: Sequence[str],
    allow_missing: Collection[str] = (),
) -> None:
    """Column presence, then numeric coercibility and missing values in one aggregate job."""
    require_columns(df, required, dataset)
    profile = value_profile(df, required, numeric).collect()  # one row per column
    unusable = [r.column_name for r in profile if r.numeric_ok == 0 and r.non_null > 0]
    if unusable:
        raise UnusableDataError(f"{dataset}: nothing but non-numeric values in {unusable}")
    gaps = {
        r.column_name: r.missing
        for r in profile
        if r.missing > 0 and r.column_name in required and r.column_name not in allow_missing
    }
    if gaps:
        raise UnusableDataError(
            f"{dataset}: missing values per column {gaps}; fill or drop them first"
        )


# --- Fixed values: the row contract of a policy to be priced ---------------------------------
POSITIVE_UP_TO = {"Exposure": 2.5, "VehPower": 20.0}
CLOSED_RANGES = {"VehAge": (0, 100), "DrivAge": (18, 100), "BonusMalus": (50, 350), "Density": (0, 27000)}
NON_EMPTY_TEXT = ["VehBrand", "VehGas", "Area", "Region"]


def contract_rules() -> Mapping[str, Column]:
    """Violation code -> condition that a good row meets."""
    rules: dict[str, Column] = {}
    for name, high in POSITIVE_UP_TO.items():
        value = to_number(name)
        rules[f"{name}_out_of_range"] = (value > 0) & (value <= high)
    for name, (low, high) in CLOSED_RANGES.items():
        rules[f"{name}_out_of_range"] = to_number(name).between(low, high)
    for name in NON_EMPTY_TEXT:
        rules[f"{name}_empty"] = F.length(F.col(name)) > 0
    return rules


def with_violations(df: DataFrame, alias: str = "violations") -> DataFrame:
    """Add the codes of all broken rules; a null value breaks its rule."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in contract_rules().items()]
    return df.withColumn(alias, F.array_compact(F.array(*broken)))


def split_by_contract(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violation codes)."""
    checked = with_violations(df)
    return (
        checked.where(F.size("violations") == 0).drop("violations"),
        checked.where(F.size("violations") > 0),
    )


# --- Fixed values: known actual/predicted column pairs, first match wins ----------------------
PREDICTION_PAIRS = [
    ("actual", "predicted"),
    ("y_true", "y_pred"),
    ("observed", "predicted"),
    ("ClaimAmount", "predicted_claim_severity"),
    ("ClaimNb", "predicted_claim_count"),
]


def prediction_columns(df: DataFrame, actual: str | None = None, predicted: str | None = None) -> tuple[str, str]:
    candidates = [(actual, predicted)] if actual and predicted else PREDICTION_PAIRS
    for pair in candidates:
        if set(pair) <= set(df.columns):
            return pair
    if actual and predicted:
        raise UnusableDataError(f"The frame lacks '{actual}' or '{predicted}'.")
    raise UnusableDataError("No known pair of actual and predicted columns; name the pair.")


def prediction_pairs(
    df: DataFrame,
    actual: str | None = None,
    predicted: str | None = None,
    check: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(actual, predicted, error) for rows where both are numbers, plus the ``keep`` columns."""
    actual_name, predicted_name = prediction_columns(df, actual, predicted)
    pairs = df.select(
        *keep, to_number(actual_name).alias("actual"), to_number(predicted_name).alias("predicted")
    ).dropna(subset=["actual", "predicted"])
    if check and pairs.isEmpty():
        raise UnusableDataError("No row has both a numeric actual and a numeric predicted value.")
    return pairs.withColumn("error", F.col("actual") - F.col("predicted"))
