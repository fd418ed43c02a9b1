"""Poisson and Gamma models with log link by Newton's method; every step is one pass over the rows.

The objective is the weighted mean half-deviance plus penalty / 2 |coefficients|^2, intercept free. A step solves for the
*change* of the coefficients from the gradient, which is near zero at the optimum. Normal equations for the coefficients
themselves, as in iteratively reweighted least squares, repeat them with a rounding error that grows with the rows; a change
below the tolerance is then a matter of luck. Tasks add up gradient and curvature in numpy, Spark adds up the tasks.
Rows are stored once, packed by batches, for all steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rise of the objective that is rounding.
ROUNDING = 1e-9
#: A level number beyond all known ones.
UNKNOWN = 2**31 - 1
TASKS_PER_CORE = 2


def _pack(rows: DataFrame, target: str, weight: str, numbers: Sequence[str], levels: Sequence[str], odd: Column) -> DataFrame:
    """A row per Arrow batch: each column as the bytes of its values, with the batch's weight, total and number of odd rows.

    Every step reads all rows again. Bytes are handed to Python as they are stored, where single values are converted one by one.
    """
    doubles = [*numbers, target, weight]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            arrays = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            y, w = arrays[target], arrays[weight]
            stored = [arrays[c].astype(np.float64 if c in doubles else np.int32).tobytes() for c in [*doubles, *levels]]
            sums = [float(w.sum()), float(w @ y), int(arrays["__odd"].sum())]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in [*stored, *sums]], names=[*doubles, *levels, "__w", "__t", "__o"])

    schema = ", ".join([*[f"`{c}` binary" for c in [*doubles, *levels]], "__w double, __t double, __o long"])
    return rows.select(
        *[F.col(c).cast("double").alias(c) for c in doubles], *[F.coalesce(F.col(c).cast("int"), F.lit(UNKNOWN)).alias(c) for c in levels], odd.cast("int").alias("__odd")
    ).mapInArrow(pack, schema)


def _columns(batches: Iterator[pa.RecordBatch], doubles: Sequence[str], levels: Sequence[str]) -> Iterator[tuple[list, list]]:
    """(doubles, levels) as arrays, for every batch of plain rows and for every packed row."""
    for batch in batches:
        if not pa.types.is_binary(batch.schema.field(doubles[-1]).type):
            yield tuple([batch.column(c).to_numpy(zero_copy_only=False) for c in names] for names in (doubles, levels))
            continue
        for i in range(batch.num_rows):
            yield tuple(
                [np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c in names]
                for names, kind in ((doubles, np.float64), (levels, np.int32))
            )


def _add_levels(
    slope: np.ndarray, curve: np.ndarray, z: np.ndarray, spots: Sequence[int], indices: Sequence[np.ndarray], starts: Sequence[int],
    widths: Sequence[int], w_slopes: np.ndarray, w_curves: np.ndarray,
) -> None:
    """Adds what the levels say to gradient and upper curvature: a level's column is one or zero, so its products are counts."""
    weighted = z * w_curves
    for f, (index, start, width) in enumerate(zip(indices, starts, widths)):
        own = slice(start, start + width)
        slope[own] += np.bincount(index, w_slopes, width + 1)[:width]
        for spot, values in zip(spots, weighted):
            sums = np.bincount(index, values, width + 1)[:width]
            if spot < start:
                curve[spot, own] += sums
            else:  # the intercept, whose column is all ones
                curve[own, spot] += sums
                curve[np.arange(start, start + width), np.arange(start, start + width)] += sums
        for other, begin, size in zip(indices[:f], starts, widths):
            pairs = np.bincount(other * (width + 1) + index, w_curves, (size + 1) * (width + 1)).reshape(size + 1, width + 1)
            curve[begin:begin + size, own] += pairs[:size, :width]


def _sums(
    rows: DataFrame, family: str, target: str, weight: str, numbers: Sequence[str], levels: Sequence[str], widths: Sequence[int], beta: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, negative gradient, curvature) at ``beta``, summed over all rows, plain or packed, without the penalty.

    An index beyond the known levels sets no column.
    """
    size, count = len(beta), len(numbers)
    upper = np.triu_indices(size)
    starts = [count + sum(widths[:i]) for i in range(len(widths))]
    spots = [*range(count), size - 1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, curve = 0.0, np.zeros(size), np.zeros((size, size))
        with np.errstate(over="ignore", invalid="ignore"):
            for (*x, y, w), indices in _columns(batches, [*numbers, target, weight], levels):
                indices = [np.where(index < width, index, width).astype(np.intp) for index, width in zip(indices, widths)]
                z = np.stack([*x, np.ones(len(y))])
                eta = beta[spots] @ z
                for index, start, width in zip(indices, starts, widths):
                    eta += np.append(beta[start:start + width], 0.0)[index]
                mu = np.exp(eta)
                if family == "poisson":
                    losses, slopes, curves = mu - y * eta, y - mu, mu
                else:
                    losses, slopes, curves = y / mu + eta, y / mu - 1.0, y / mu
                loss += float(w @ losses)
                slope[spots] += z @ (w * slopes)
                curve[np.ix_(spots, spots)] += (z * (w * curves)) @ z.T
                _add_levels(slope, curve, z, spots, indices, starts, widths, w * slopes, w * curves)
        values = np.concatenate([[loss], slope, curve[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["place", "value"])

    # One row per entry of the gradient and the curvature, whatever the number of rows.
    # A task that starts Python costs more than the sums over a small part: a few tasks per core read the stored parts.
    few = rows.select(*numbers, *levels, target, weight).coalesce(TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    summed = few.mapInArrow(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    values = np.array([r.value for r in sorted(summed.collect())])
    curve = np.zeros((size, size))
    curve[upper] = values[1 + size:]
    return float(values[0]), values[1:1 + size], curve + np.triu(curve, 1).T


def fit_log_link(
    rows: DataFrame, family: str, target: str, weight: str, numbers: Sequence[str], levels: Sequence[str], widths: Sequence[int],
    penalty: float, max_iter: int, tolerance: float,
) -> np.ndarray:
    """Coefficients of the numbers and of ``widths`` levels per index column, then the intercept.

    Ends when no coefficient changes by ``tolerance`` or more. A step that raises the objective is halved. Directions the rows
    say nothing about keep their values.
    """
    sound = F.col(target).isNotNull() & ~F.isnan(target) & (F.col(weight) >= 0)
    packed = _pack(rows, target, weight, numbers, levels, ~F.coalesce(sound, F.lit(False))).persist()
    try:
        start = packed.agg(F.sum("__w").alias("weight"), F.sum("__t").alias("total"), F.sum("__o").alias("odd")).first()
        if start.odd:
            raise ValueError("Targets must not be missing, weights must not be missing or negative.")
        size = len(numbers) + sum(widths) + 1
        pull = np.append(np.full(size - 1, penalty), 0.0)
        beta, best, lowest = np.zeros(size), None, np.inf
        beta[-1] = np.log(max(start.total / start.weight, 1e-16))
        for _ in range(max_iter):
            loss, slope, curve = _sums(packed, family, target, weight, numbers, levels, widths, beta)
            loss = loss / start.weight + float(pull @ beta**2) / 2
            if best is not None and not loss <= lowest + ROUNDING * abs(lowest):
                beta = (beta + best) / 2
                continue
            step = np.linalg.lstsq(curve / start.weight + np.diag(pull), slope / start.weight - pull * beta, rcond=None)[0]
            best, lowest, beta = beta, loss, beta + step
            if np.abs(step).max() < tolerance:
                break
    finally:
        packed.unpersist()
    return beta


def as_model(spark, beta: np.ndarray, settings: GeneralizedLinearRegression) -> GeneralizedLinearRegressionModel:
    """The fitted model with these coefficients: ``settings``, without penalty, fitted on one row per coefficient that it meets exactly."""
    size = len(beta) - 1
    spans = 1.0 / np.maximum(1.0, np.abs(beta[:-1]))  # no row's mean is far from the intercept's
    means = np.exp(beta[-1] + np.append(beta[:-1] * spans, 0.0))
    poisson = settings.getFamily() == "poisson"
    rows = [
        (Vectors.sparse(size, [i], [float(spans[i])]) if i < size else Vectors.sparse(size, [], []), float(m), float(1 / m) if poisson else 1.0)
        for i, m in enumerate(means)
    ]
    names = [settings.getFeaturesCol(), settings.getLabelCol(), settings.getWeightCol()]
    tolerance = settings.getTol() * max(1.0, float(np.abs(beta).max()))
    exact = settings.copy({settings.regParam: 0.0, settings.maxIter: 100, settings.tol: tolerance})
    return exact.fit(spark.createDataFrame(rows, names).coalesce(1))
