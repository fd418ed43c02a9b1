"""Foreign portfolio CSV -> rating CSV and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.portfolios import dutch_portfolio, portfolio_summary, spanish_portfolio
from ..sources.artifacts import write_csv_report
from ..sources.readers import read_dutch_csv, read_spanish_csv

SHAPES = {"dutch": (read_dutch_csv, dutch_portfolio), "spanish": (read_spanish_csv, spanish_portfolio)}


def harmonise_csv(spark: SparkSession, shape: str, source: str, target: str) -> DataFrame:
    """Write the portfolio at ``source`` in the rating schema to ``target``; returns its one-row summary."""
    read, harmonise = SHAPES[shape]
    harmonised = harmonise(read(spark, source))
    write_csv_report(harmonised, target)
    return portfolio_summary(harmonised)
