import pytest
from pyspark.sql import functions as F

from ratespark.functions import cleaning as c
from ratespark.functions.rating import gamma_unit_deviance, poisson_unit_deviance, risk_band


def values(spark, column, *rows):
    """Evaluate ``column`` over one text column ``x``."""
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], "x string").select(column).collect()]


def test_numbers_from_text(spark):
    assert values(spark, c.to_number("x"), " 7 ", "", "abc", "NaN", "1e3", None) == [7.0, None, None, None, 1000.0, None]


def test_clip_keeps_nulls(spark):
    assert values(spark, c.clip(c.to_number("x"), 1, 3), "0", "2", "9", None) == [1.0, 2.0, 3.0, None]


def test_text_is_stripped_of_all_white_space(spark):
    assert values(spark, c.text_or("x", "?"), "\t a b \n", "   ", None) == ["a b", "?", "?"]


def test_rounding_is_half_even(spark):
    assert values(spark, c.round_to_long(c.to_number("x")), "2.5", "3.5", "-0.5") == [2, 4, 0]


def test_large_ids_stay_exact(spark):
    big = 2**53 + 1
    text = spark.createDataFrame([(str(big),), ("12.0",), ("x",)], "IDpol string")
    assert [r[0] for r in text.select(c.whole_id(text, "IDpol")).collect()] == [big, 12, None]
    number = spark.createDataFrame([(big,)], "IDpol long")
    assert number.select(c.whole_id(number, "IDpol")).first()[0] == big


def test_year_of_date_text(spark):
    assert values(spark, c.year_of_dmy("x"), "05/11/2015", "oops", "1/2/", None) == [2015, None, None, None]


def test_code_lookup(spark):
    assert values(spark, c.code_lookup("x", {"P": "Regular"}), "P", "Z") == ["Regular", None]
    assert values(spark, c.code_lookup("x", {"P": "Regular"}, "D"), "P", "Z", None) == ["Regular", "D", "D"]


def test_rescale_of_a_constant_column_is_null(spark):
    x = c.to_number("x")
    assert values(spark, c.rescale(x, F.lit(0.0), F.lit(10.0), 4, 20), "5") == [12.0]
    assert values(spark, c.rescale(x, F.lit(5.0), F.lit(5.0), 4, 20), "5") == [None]


def test_risk_band_limits(spark):
    assert values(spark, risk_band(c.to_number("x"), 150, 400), "120", "150", "250", "700", None) == [
        "Low", "Low", "Medium", "High", "High"
    ]


@pytest.mark.parametrize("y, p", [(0.0, 0.5), (2.0, 0.5), (1.0, 1.0)])
def test_unit_deviances(spark, y, p):
    import math

    row = spark.range(1).select(poisson_unit_deviance(F.lit(y), F.lit(p)), gamma_unit_deviance(F.lit(y + 1), F.lit(p))).first()
    expected = 2 * ((y * math.log(y / p) if y else 0) - y + p)
    assert row[0] == pytest.approx(expected, abs=1e-12)
    assert row[1] == pytest.approx(2 * (math.log(p / (y + 1)) + (y + 1) / p - 1), abs=1e-12)
