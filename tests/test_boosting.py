"""Boosted trees against steps computed in numpy, and their behaviour as models."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from book_helpers import make_claims, make_policies
from ratespark.config import MODEL_CATEGORICAL, MODEL_NUMERIC, BoostConfig, ModelConfig
from ratespark.functions.rating import gamma_unit_deviance, poisson_unit_deviance
from ratespark.operators import boosting, models
from ratespark.operators.datasets import clean_frequency_data

PLAIN = BoostConfig(6, "", learning_rate=0.5, max_depth=3, subsample=1.0, colsample_bytree=1.0)


@pytest.fixture(scope="module")
def book(spark):
    policies = clean_frequency_data(make_policies(spark, 500)).cache()
    return policies, make_claims(policies).join(policies.drop("ClaimNb"), "IDpol").cache()


def brute(x, levels, y, w, objective, settings):
    """Exact greedy trees over every value and level; returns the log means."""
    score = np.full(len(y), np.log((w * y).sum() / w.sum()))
    lam = settings.reg_lambda
    for _ in range(settings.trees):
        mu = np.exp(score)
        g, h = (w * (mu - y), w * mu) if objective == "poisson" else (w * (1 - y / mu), w * y / mu)
        groups, done = [np.arange(len(y))], []
        for _ in range(settings.max_depth):
            following = []
            for rows in groups:
                best = None
                masks = [x[rows, j] < v for j in range(x.shape[1]) for v in np.unique(x[:, j])]
                masks += [levels[rows, j] == v for j in range(levels.shape[1]) for v in np.unique(levels[:, j])]
                for left in masks:
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                    if hl < settings.min_child_weight or hr < settings.min_child_weight:
                        continue
                    gain = 0.5 * (gl**2 / (hl + lam) + gr**2 / (hr + lam) - (gl + gr) ** 2 / (hl + hr + lam))
                    if gain > settings.min_gain and (best is None or gain > best[0] + 1e-9):
                        best = gain, left
                if best is None:
                    done.append(rows)
                else:
                    following += [rows[best[1]], rows[~best[1]]]
            groups = following
        for rows in done + groups:
            if len(done) + len(groups) > 1:
                step = -g[rows].sum() / (h[rows].sum() + lam)
                score[rows] += settings.learning_rate * np.clip(step, -0.7, 0.7)
    return score


@pytest.mark.parametrize("objective", ["poisson", "gamma"])
def test_trees_match_exact_greedy_search(spark, book, objective):
    policies, claims = book
    if objective == "poisson":
        rows = policies.select("DrivAge", "VehPower", "Area", "VehGas", (F.col("ClaimNb") / F.col("Exposure")).alias("y"), F.col("Exposure").alias("w"))
    else:
        rows = claims.select("DrivAge", "VehPower", "Area", "VehGas", F.col("ClaimAmount").alias("y"), F.lit(1.0).alias("w"))
    model = boosting.fit_boosted(rows, objective, PLAIN, "y", "w", ["DrivAge", "VehPower"], ["Area", "VehGas"], {})
    pdf = rows.withColumn("p", model.mean()).toPandas()
    want = np.exp(brute(pdf[["DrivAge", "VehPower"]].to_numpy(), pdf[["Area", "VehGas"]].to_numpy(), pdf.y.to_numpy(), pdf.w.to_numpy(), objective, PLAIN))
    np.testing.assert_allclose(pdf.p, want, rtol=1e-8)


@pytest.mark.parametrize("objective", ["poisson", "gamma"])
def test_deviance_falls_with_every_tree(spark, book, objective):
    policies, claims = book
    rows = policies.select(*MODEL_NUMERIC, *MODEL_CATEGORICAL, (F.col("ClaimNb") / F.col("Exposure")).alias("y"), F.col("Exposure").alias("w"))
    if objective == "gamma":
        rows = claims.select(*MODEL_NUMERIC, *MODEL_CATEGORICAL, F.col("ClaimAmount").alias("y"), F.lit(1.0).alias("w"))
    settings = replace(PLAIN, trees=12, learning_rate=1.0)
    model = boosting.fit_boosted(rows, objective, settings, "y", "w", MODEL_NUMERIC, MODEL_CATEGORICAL, {})
    unit = poisson_unit_deviance if objective == "poisson" else gamma_unit_deviance
    measures = []
    for n in range(len(model.trees) + 1):
        mean = boosting.BoostedTrees(objective, model.base, {}, model.trees[:n]).mean()
        measures.append((F.sum(F.col("w") * unit(F.col("y"), mean)) / F.sum("w")).alias(f"d{n}"))
    deviances = list(rows.agg(*measures).first())
    assert len(model.trees) == 12 and all(b < a for a, b in zip(deviances, deviances[1:]))


def test_shares_of_rows_and_features_are_drawn_alike_every_time(spark, book):
    settings = replace(PLAIN, subsample=0.6, colsample_bytree=0.5)
    rows = book[0].select("IDpol", *MODEL_NUMERIC, *MODEL_CATEGORICAL, (F.col("ClaimNb") / F.col("Exposure")).alias("y"), F.col("Exposure").alias("w"))
    fits = [
        boosting.fit_boosted(df, "poisson", settings, "y", "w", MODEL_NUMERIC, MODEL_CATEGORICAL, {})
        for df in (rows, rows.repartition(7, "IDpol"))
    ]
    assert [t.splits.keys() for t in fits[0].trees] == [t.splits.keys() for t in fits[1].trees]
    for one, other in zip(fits[0].trees, fits[1].trees):
        assert [(s.feature, s.bin, s.level) for s in one.splits.values()] == [(s.feature, s.bin, s.level) for s in other.splits.values()]


def test_as_a_model_of_each_role(spark, book, tmp_path):
    policies, claims = book
    small = BoostConfig(4, "", max_depth=2)
    config = replace(ModelConfig(), frequency=replace(ModelConfig().frequency, boost=small), severity=replace(ModelConfig().severity, boost=small))
    model = models.train_frequency_model(policies, "boosted", config=config)
    model.save(f"{tmp_path}/m")
    again = models.load_model(spark, models.FREQUENCY, "boosted", f"{tmp_path}/m")
    a, b = (m.transform(policies).select("IDpol", "predicted_annual_frequency").orderBy("IDpol").collect() for m in (model, again))
    assert a == b
    shares = models.feature_importance(model, spark, 3).collect()
    assert shares and len(shares) <= 3 and sum(r.importance for r in models.feature_importance(model, spark).collect()) == pytest.approx(1)
    assert models.glm_relativities(model, spark) is None
    assert models.train_severity_model(claims, "boosted", config=config).evaluate(claims).first().sample_size == claims.count()


def test_missing_and_unseen_values(spark):
    rows = spark.createDataFrame(
        [(1.0, "a", 1.0, 1.0), (1.0, "a", 2.0, 1.0), (9.0, "b", 8.0, 1.0), (None, "b", 9.0, 1.0), (9.0, None, 7.0, 1.0)], "v double, c string, y double, w double"
    )
    settings = replace(PLAIN, min_child_weight=0.0)
    model = boosting.fit_boosted(rows, "gamma", settings, "y", "w", ["v"], ["c"], {"v": 9.0})
    new = spark.createDataFrame([(None, "z"), (float("nan"), None), (1.0, "a")], "v double, c string")
    high, same, low = [r.p for r in new.withColumn("p", model.mean()).collect()]
    assert high == same and low < high


def test_no_claims_are_refused(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 1.0)], "v double, y double, w double")
    with pytest.raises(ValueError):
        boosting.fit_boosted(rows, "poisson", PLAIN, "y", "w", ["v"], [], {})
    with pytest.raises(ValueError):
        boosting.fit_boosted(rows, "squared", PLAIN, "y", "w", ["v"], [], {})
