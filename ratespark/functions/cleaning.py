"""Coercion, clipping and text normalisation expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: the Unicode white-space characters (plain trim would strip blanks only) ----------
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def to_number(column: Column | str) -> Column:
    """Number or null: unparsable text and NaN both become null."""
    number = _col(column).try_cast("double")
    return F.when(~F.isnan(number), number)


def clip(column: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clamp to [low, high] and keep nulls (``greatest``/``least`` alone would drop them)."""
    value = _col(column)
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return bounded if bounded is value else F.when(value.isNotNull(), bounded)


def strip(column: Column | str) -> Column:
    return F.btrim(_col(column).cast("string"), F.lit(WHITE_SPACE))


def text_or(column: Column | str, default: str) -> Column:
    """Trimmed text; null and blank become ``default``."""
    return F.coalesce(F.nullif(strip(column), F.lit("")), F.lit(default))


def round_to_long(column: Column | str) -> Column:
    """Half-even rounding to a whole number."""
    return F.rint(_col(column)).cast("long")


def whole_id(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a whole-number id; what is no number becomes null.

    Whole numbers never pass through a double, which would damage ids above 2^53.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    rounded = round_to_long(to_number(name))
    return F.coalesce(F.col(name).try_cast("long"), rounded) if isinstance(kind, T.StringType) else rounded


def code_lookup(column: Column | str, codes: Mapping[str, str], default: str | None = None) -> Column:
    """Translate a code by a small fixed map; unmapped codes give ``default`` or null."""
    pairs = [F.lit(item) for pair in codes.items() for item in pair]
    translated = F.try_element_at(F.create_map(*pairs), _col(column).cast("string"))
    return translated if default is None else F.coalesce(translated, F.lit(default))


def year_of_dmy(column: Column | str) -> Column:
    """Year of a DD/MM/YYYY text; malformed text gives null."""
    return F.try_element_at(F.split(_col(column).cast("string"), "/"), F.lit(-1)).try_cast("int")


def rescale(value: Column, low: Column, high: Column, new_low: float, new_high: float) -> Column:
    """Linear map of [low, high] onto [new_low, new_high]; a zero-width range gives null."""
    return F.lit(new_low) + F.try_divide((value - low) * F.lit(new_high - new_low), high - low)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
