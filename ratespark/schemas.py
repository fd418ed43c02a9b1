"""Declared schemas. Stored tables are read with these, so added columns need no rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import OUTCOME_COLUMNS, RATING_COLUMNS, RESULT_COLUMNS

_TEXT = {"VehBrand", "VehGas", "Area", "Region", "risk_category", "portfolio_name", "source", "id", "batch_id"}
_OTHER = {
    "created_at": T.TimestampType(),
    "created_date": T.DateType(),
    "consent": T.BooleanType(),
    "claim_occurred": T.BooleanType(),
}


def _field(name: str) -> T.StructField:
    kind = _OTHER.get(name) or (T.StringType() if name in _TEXT else T.DoubleType())
    return T.StructField(name.lower(), kind)


def _table(*names: str) -> T.StructType:
    return T.StructType([_field(name) for name in names])


QUOTES = _table(
    "id", "created_at", "source", "consent", *RATING_COLUMNS, *RESULT_COLUMNS, *OUTCOME_COLUMNS,
    "portfolio_name", "created_date", "batch_id",
)
TRAINING_DATA = QUOTES
B2B_PORTFOLIOS = _table(
    "id", "created_at", *RATING_COLUMNS, *OUTCOME_COLUMNS, "source", "consent", *RESULT_COLUMNS,
    "portfolio_name", "batch_id",
)
TABLES = {"quotes": QUOTES, "training_data": TRAINING_DATA, "b2b_portfolios": B2B_PORTFOLIOS}

# One policy of a JSON scoring request, and the request itself.
POLICY_REQUEST = T.StructType([
    T.StructField("IDpol", T.LongType()),
    *[
        T.StructField(name, T.StringType() if name in _TEXT else T.DoubleType())
        for name in RATING_COLUMNS
    ],
])
BATCH_REQUEST = T.StructType([
    T.StructField("policies", T.ArrayType(POLICY_REQUEST)),
    T.StructField("consent", T.BooleanType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema`` in its order; absent ones are null, others are dropped.

    Matching ignores case, as a store that folds names to lower case needs.
    """
    by_name = {name.lower(): name for name in df.columns}
    return df.select(*[
        (F.col(f"`{by_name[f.name]}`") if f.name in by_name else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def canonical_case(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename columns that differ from ``names`` only by case."""
    wanted = {name.lower(): name for name in names}
    return df.select(*[F.col(f"`{c}`").alias(wanted.get(c.lower(), c)) for c in df.columns])
