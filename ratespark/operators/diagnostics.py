"""The aggregates behind model and portfolio charts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RANDOM_SEED
from ..functions.cleaning import safe_ratio
from .ranking import exact_quantiles, prefix_sums, with_approx_bucket, with_quantile_bucket
from .sampling import seeded_sample
from .validate import UnusableDataError, prediction_pairs

DEFAULT_BINS = 40


def calibration(
    df: DataFrame, actual: str, predicted: str, key: str, buckets: int = 10, exact: bool = True
) -> DataFrame:
    """Mean actual and predicted value per equal-count bucket of the prediction.

    Ties are split by ``key``. ``exact=False`` takes bucket edges from a sketch instead.
    """
    narrow = df.select(
        F.col(key).alias("__key"), F.col(actual).alias("__actual"), F.col(predicted).alias("__predicted")
    )
    if exact:
        placed = with_quantile_bucket(narrow, ["__predicted", "__key"], buckets)
    else:
        placed = with_approx_bucket(narrow, "__predicted", buckets)
    return placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("__actual").alias("actual_mean"),
        F.avg("__predicted").alias("predicted_mean"),
    )


def histogram(
    df: DataFrame, column: str, bins: int = DEFAULT_BINS, log10: bool = False, mean: str | None = None
) -> DataFrame:
    """(bin, bin_low, bin_high, rows) over equal-width bins, empty bins included.

    ``log10`` makes the bins equal on a log axis (positive values only). A constant column
    gets a unit-wide range around its value. ``mean`` names a column for the mean of all values.
    The rows are read twice, as the edges depend on the extremes; the mean comes with these.
    """
    value = F.log10(column) if log10 else F.col(column).cast("double")
    values = df.select(value.alias("v")).where(F.col("v").isNotNull())
    extremes = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - F.lit(0.5)).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + F.lit(0.5)).otherwise(F.col("hi")).alias("hi"), "mean",
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    slot = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = values.crossJoin(F.broadcast(extremes)).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    edges = extremes.select("lo", "mean", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))

    def edge(index: Column) -> Column:
        at = F.col("lo") + index * F.col("width")
        return F.pow(F.lit(10.0), at) if log10 else at

    return edges.join(counts, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("bin_low"),
        edge(F.col("bin") + F.lit(1)).alias("bin_high"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        *([F.col("mean").alias(mean)] if mean else []),
    )


def premium_histogram(scored: DataFrame, bins: int = DEFAULT_BINS, log10: bool = False) -> DataFrame:
    return histogram(scored, "final_premium", bins, log10)


def residual_histogram(pairs: DataFrame, bins: int = DEFAULT_BINS) -> DataFrame:
    """Histogram of ``error``, with the mean error on each row."""
    return histogram(pairs, "error", bins, mean="mean_error")


def diagnostic_pairs(
    df: DataFrame, key: Column, actual: str | None = None, predicted: str | None = None,
    sample_size: int = 5000, seed: int = RANDOM_SEED,
) -> DataFrame:
    """A seeded sample of numeric (actual, predicted, error) rows for a scatter chart."""
    tagged = prediction_pairs(df.withColumn("__key", key), actual, predicted, keep=["__key"])
    return seeded_sample(tagged, F.col("__key"), sample_size, seed).drop("__key")


def axis_extent(pairs: DataFrame) -> DataFrame:
    """(axis_low, axis_high): common range of both values, padded by 5 % and at least 1."""
    extremes = pairs.agg(
        F.least(F.min("actual"), F.min("predicted")).alias("lo"),
        F.greatest(F.max("actual"), F.max("predicted")).alias("hi"),
    )
    padding = F.greatest((F.col("hi") - F.col("lo")) * F.lit(0.05), F.lit(1.0))
    return extremes.select((F.col("lo") - padding).alias("axis_low"), (F.col("hi") + padding).alias("axis_high"))


RUN_TYPE = (
    "map<string, struct<status: string, frequency_model: string, severity_model: string, "
    "metrics: struct<frequency: struct<metrics: struct<rmse: double>>, "
    "severity: struct<metrics: struct<rmse: double>>>>>"
)


def comparison_rmse(runs: DataFrame) -> DataFrame:
    """One row per successful run and component that has an RMSE.

    ``runs`` holds the run results as JSON text in a column ``payload``.
    """
    parsed = runs.select(F.explode(F.from_json("payload", RUN_TYPE)).alias("run_name", "run"))
    parts = F.array(*[
        F.struct(F.lit(name.title()).alias("component"), F.col(f"run.metrics.{name}.metrics.rmse").alias("rmse"))
        for name in ("frequency", "severity")
    ])
    label = F.concat(
        F.coalesce("run.frequency_model", F.lit("frequency")), F.lit(" + "),
        F.coalesce("run.severity_model", F.lit("severity")),
    )
    return (
        parsed.where(F.col("run.status") == "success")
        .select("run_name", label.alias("combo_label"), F.inline(parts))
        .where(F.col("rmse").isNotNull())
    )


def comparison_rmse_of(spark: SparkSession, runs: Mapping[str, Any]) -> DataFrame:
    """:func:`comparison_rmse` for a handful of runs held as a mapping."""
    frame = comparison_rmse(spark.createDataFrame([(json.dumps(runs),)], "payload string"))
    if frame.isEmpty():
        raise UnusableDataError("No successful run has an RMSE.")
    return frame


def lorenz_points(df: DataFrame, predicted: str, loss: str, exposure: str, key: str) -> DataFrame:
    """Rows by rising predicted risk with running and total loss and exposure."""
    narrow = df.select(
        F.col(key).alias("key"), F.col(predicted).alias("risk"),
        F.col(loss).alias("loss"), F.col(exposure).alias("exposure"),
    )
    return prefix_sums(
        narrow, ["risk", "key"],
        {"cum_loss": F.col("loss"), "cum_exposure": F.col("exposure")},
        totals={"cum_loss": "total_loss", "cum_exposure": "total_exposure"},
    )


def gini(df: DataFrame, predicted: str, loss: str, exposure: str, key: str) -> DataFrame:
    """One row with the Gini index 1 - 2 x area under the Lorenz curve (trapezoids)."""
    strip = F.col("exposure") * (F.lit(2.0) * F.col("cum_loss") - F.col("loss")) / F.lit(2.0)
    points = lorenz_points(df, predicted, loss, exposure, key)
    return points.groupBy("total_loss", "total_exposure").agg(  # the totals are constants
        F.count(F.lit(1)).alias("policies"), F.sum(strip).alias("area")
    ).select(
        "policies", "total_loss", "total_exposure",
        (F.lit(1.0) - F.lit(2.0) * safe_ratio(F.col("area"), F.col("total_loss") * F.col("total_exposure"))).alias("gini"),
    )


def lorenz_curve(df: DataFrame, predicted: str, loss: str, exposure: str, key: str, points: int = 20) -> DataFrame:
    """(point, exposure_share, loss_share): the curve at equal steps of exposure."""
    curve = lorenz_points(df, predicted, loss, exposure, key)
    share = F.col("cum_exposure") / F.col("total_exposure")
    point = F.least(F.ceil(F.round(share * F.lit(points), 9)), F.lit(points)).cast("int")
    return curve.groupBy(point.alias("point")).agg(
        F.max(share).alias("exposure_share"), F.max(F.col("cum_loss") / F.col("total_loss")).alias("loss_share")
    )


def bucket_edges(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """One row with the array of inner equal-count edges."""
    shares = {f"q{i}": i / buckets for i in range(1, buckets)}
    return exact_quantiles(df, [column], shares).select(F.array(*shares).alias("edges"))


def population_stability(
    expected: DataFrame, actual: DataFrame, column: str, buckets: int = 10, floor: float = 1e-6
) -> DataFrame:
    """(bucket, expected_share, actual_share, psi_term); the index is the sum of the terms.

    Buckets are the deciles of ``expected``. The edges are one row, broadcast to both sides.
    """
    edges = bucket_edges(expected, column, buckets)
    both = expected.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("is_expected")).unionByName(
        actual.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("is_expected"))
    ).where(F.col("v").isNotNull())
    bucket = F.size(F.filter("edges", lambda edge: edge < F.col("v"))).cast("int")
    counts = both.crossJoin(F.broadcast(edges)).groupBy(bucket.alias("bucket")).agg(
        F.count_if(F.col("is_expected") == 1).alias("expected_rows"),
        F.count_if(F.col("is_expected") == 0).alias("actual_rows"),
    )
    totals = counts.agg(F.sum("expected_rows").alias("te"), F.sum("actual_rows").alias("ta"))
    shares = counts.crossJoin(F.broadcast(totals)).select(  # one row
        "bucket",
        F.greatest(F.col("expected_rows") / F.col("te"), F.lit(floor)).alias("expected_share"),
        F.greatest(F.col("actual_rows") / F.col("ta"), F.lit(floor)).alias("actual_share"),
    )
    term = (F.col("actual_share") - F.col("expected_share")) * F.ln(F.col("actual_share") / F.col("expected_share"))
    return shares.withColumn("psi_term", term)


# Scales the median absolute deviation to a standard deviation for normal data.
_MAD_TO_SD = 0.6745


def anomaly_flags(df: DataFrame, columns: Sequence[str], limit: float = 3.5) -> DataFrame:
    """Add a robust z-score per column and ``is_anomaly``.

    A stand-in for an isolation forest, which Spark ML lacks: |0.6745 (x - median) / MAD|.
    A column without spread (MAD 0) gives null scores and flags nothing.
    """
    medians = _pivot_one_row(exact_quantiles(df, columns, {"m": 0.5}), columns, "m")
    deviations = df.crossJoin(F.broadcast(medians)).select(*[
        F.abs(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in columns
    ])
    mads = _pivot_one_row(exact_quantiles(deviations, columns, {"d": 0.5}), columns, "d")
    joined = df.crossJoin(F.broadcast(medians)).crossJoin(F.broadcast(mads))
    scored = joined.withColumns({
        f"robust_z_{c}": safe_ratio(F.lit(_MAD_TO_SD) * (F.col(c) - F.col(f"__m_{c}")), F.nullif(F.col(f"__d_{c}"), F.lit(0.0)))
        for c in columns
    })
    worst = F.lit(False)
    for c in columns:
        worst = worst | F.coalesce(F.abs(f"robust_z_{c}") > F.lit(limit), F.lit(False))
    return scored.withColumn("is_anomaly", worst).drop(*[f"__{p}_{c}" for p in "md" for c in columns])


def _pivot_one_row(long: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    return long.agg(*[F.max(F.when(F.col("feature") == c, F.col(label))).alias(f"__{label}_{c}") for c in columns])
