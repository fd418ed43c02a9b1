"""The one feature path shared by training, batch scoring and streaming."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    CATEGORICAL_DEFAULTS,
    CLIP_BOUNDS,
    COLUMN_ALIASES,
    EXPOSURE,
    EXPOSURE_FLOOR,
    MODEL_CATEGORICAL,
    NOT_PROVIDED,
    NUMERIC_DEFAULTS,
    POLICY_ID,
    RATED_NUMERIC,
    RATING_COLUMNS,
    SIMULATED_ALIASES,
    SIMULATED_NUMERIC,
)
from ..functions.cleaning import clip, strip, text_or, to_number, whole_id
from .ranking import dense_ids, in_file_order
from .stats import default_values
from .validate import require_pricing_columns, require_rows, validate_schema


def canonical_columns(df: DataFrame) -> DataFrame:
    """Add each missing canonical column from its first alias present; keep the alias too."""
    present = set(df.columns)
    added: dict[str, Column] = {}
    for target, aliases in {**COLUMN_ALIASES, **SIMULATED_ALIASES}.items():
        source = next((name for name in aliases if name in present), None)
        if source is not None and target not in present:
            added[target] = F.col(f"`{source}`")
    # Spark resolves names without regard to case: "exposure" is replaced by "Exposure".
    folded = {target.lower() for target in added} & {name.lower() for name in present}
    kept = [F.col(f"`{name}`") for name in df.columns if name.lower() not in folded]
    return df.select(*kept, *[source.alias(target) for target, source in added.items()])


def fill_policy_ids(df: DataFrame, missing_ids: str = "position") -> DataFrame:
    """Whole-number ids. Missing ones get a 1-based number, a hash, or stay null.

    ``position`` numbers follow the order in which rows arrive: file order for one file, any order among several. ``file``
    numbers follow the files' paths and the rows in each; the frame must come straight from a reader, and nothing is written.
    ``position`` looks for a missing id in the id column and, only when there is one, numbers all
    rows, which writes the frame once; ``hash`` needs no job and is the only choice for a stream;
    ``keep`` is for frames whose ids are known to be complete.
    """
    known = whole_id(df, POLICY_ID) if POLICY_ID in df.columns else F.lit(None).cast("long")
    numbers = {"position": dense_ids, "file": in_file_order}.get(missing_ids)
    complete = numbers and POLICY_ID in df.columns and df.select(known.alias("k")).where("k IS NULL").isEmpty()
    if numbers and not complete:
        numbered = numbers(df.withColumn(POLICY_ID, known), "__position")
        return numbered.withColumn(POLICY_ID, F.coalesce(POLICY_ID, "__position")).drop("__position")
    if missing_ids == "hash":
        known = F.coalesce(known, negative_hash(*[F.col(f"`{c}`") for c in df.columns]))
    return df.withColumn(POLICY_ID, known)


def negative_hash(*columns: Column) -> Column:
    """A stable id below zero, out of reach of real (positive) policy ids."""
    return -(F.pmod(F.xxhash64(*columns), F.lit(4611686018427387904)) + F.lit(1))


def engineer_features(
    df: DataFrame,
    numeric_defaults: Mapping[str, float] | None = None,
    categorical_defaults: Mapping[str, str] | None = None,
    batch_defaults: bool = True,
    missing_ids: str = "keep",
) -> DataFrame:
    """Canonical names, filled and clipped factors, log density, clean categories.

    A default comes from the given mapping, else (``batch_defaults``) from the batch's own median
    or mode, else from the global constants. With all defaults given this is one projection.
    """
    named = fill_policy_ids(canonical_columns(df), missing_ids)
    present = set(named.columns)
    coerced = named.withColumns({c: to_number(c) for c in RATED_NUMERIC if c in present})
    defaults = _resolve_defaults(coerced, {**(numeric_defaults or {}), **(categorical_defaults or {})}, batch_defaults)

    factors: dict[str, Column] = {}
    for name in RATED_NUMERIC:
        default = F.lit(float(defaults[name]))
        filled = F.coalesce(F.col(name), default) if name in present else default
        factors[name] = clip(filled, *CLIP_BOUNDS[name])
    factors[EXPOSURE] = clip(factors[EXPOSURE], EXPOSURE_FLOOR)
    for name in MODEL_CATEGORICAL:
        default_text = str(defaults[name])
        factors[name] = text_or(name, default_text) if name in present else F.lit(default_text)
    featured = coerced.withColumns(factors).withColumn("LogDensity", F.log1p("Density"))
    return _simulated_features(featured)


def _resolve_defaults(df: DataFrame, given: Mapping[str, object], batch_defaults: bool) -> dict[str, object]:
    constants = {**NUMERIC_DEFAULTS, **CATEGORICAL_DEFAULTS}
    open_names = [name for name in constants if name not in given and name in df.columns]
    from_batch: dict = {}
    if batch_defaults and open_names:
        # One pass finds the columns with gaps; only these need a median or mode, and most have none.
        gap = {n: F.col(n) if n in RATED_NUMERIC else F.nullif(strip(n), F.lit("")) for n in open_names}
        gaps = df.agg(*[F.count_if(value.isNull()).alias(n) for n, value in gap.items()]).first()
        needed = [n for n in open_names if gaps[n] > 0]
        from_batch = default_values(
            df, [n for n in RATED_NUMERIC if n in needed], [n for n in MODEL_CATEGORICAL if n in needed]
        )
    return {**constants, **from_batch, **given}


def _simulated_features(df: DataFrame) -> DataFrame:
    """Optional telematics columns: kept and cleaned, never model inputs.

    The flag is 1 as soon as any text column of the group exists, because blanks in it have
    been filled by then.
    """
    present = [name for name in SIMULATED_ALIASES if name in df.columns]
    if not present:
        return df
    cleaned = df.withColumns({
        name: to_number(name) if name in SIMULATED_NUMERIC else text_or(name, NOT_PROVIDED) for name in present
    })
    any_given = F.lit(False)
    for name in present:
        any_given = any_given | F.col(name).isNotNull()
    return cleaned.withColumn("has_simulated_behavioral_inputs", any_given.cast("int"))


def build_inference_frame(
    df: DataFrame,
    metadata: Mapping | None = None,
    check_rows: bool = True,
    check_values: bool = True,
    batch_defaults: bool = True,
    missing_ids: str = "hash",
) -> DataFrame:
    """Rows ready for scoring. The two checks cost a job each; a stream switches them off."""
    require_pricing_columns(df)
    if check_rows:
        require_rows(df)
    given = metadata or {}
    prepared = engineer_features(
        df, given.get("numeric_defaults"), given.get("categorical_defaults"), batch_defaults, missing_ids
    )
    if check_values:
        validate_schema(
            prepared, "Prepared inference dataset", [POLICY_ID, *RATING_COLUMNS], [POLICY_ID, *RATED_NUMERIC], [POLICY_ID]
        )
    return prepared
