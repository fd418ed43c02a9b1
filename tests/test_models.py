"""Fits are checked against a small Newton solver of the penalised likelihood."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from book_helpers import make_claims, make_policies
from ratespark.config import MODEL_CATEGORICAL, MODEL_NUMERIC, BoostConfig, ForestConfig, ModelConfig, RoleConfig
from ratespark.operators import glm, models
from ratespark.operators.datasets import clean_frequency_data

SMALL = ModelConfig(
    frequency=RoleConfig(BoostConfig(5, "count:poisson"), forest=ForestConfig(5, 4)),
    severity=RoleConfig(BoostConfig(5, "reg:gamma"), forest=ForestConfig(5, 4)),
)


@pytest.fixture(scope="module")
def book(spark):
    policies = clean_frequency_data(make_policies(spark, 600)).cache()
    return policies, make_claims(policies).join(policies.drop("ClaimNb"), "IDpol").cache()


def design(pdf):
    numbers = pdf[MODEL_NUMERIC].to_numpy(float)
    blocks = [(numbers - numbers.mean(0)) / numbers.std(0, ddof=1)]
    for name in MODEL_CATEGORICAL:
        blocks.append(np.stack([(pdf[name] == level) for level in sorted(pdf[name].unique())], 1).astype(float))
    return np.hstack([np.ones((len(pdf), 1)), *blocks])


def newton(x, y, w, alpha, family):
    """Minimise weighted mean half-deviance + alpha/2 |coefficients|^2 (intercept free)."""
    penalty = alpha * np.eye(x.shape[1])
    penalty[0, 0] = 0.0
    beta = np.zeros(x.shape[1])
    beta[0] = np.log((w * y).sum() / w.sum())
    for _ in range(100):
        mu = np.exp(x @ beta)
        slope, curve = (mu - y, mu) if family == "poisson" else (1 - y / mu, y / mu)
        gradient = x.T @ (w * slope) / w.sum() + penalty @ beta
        step = np.linalg.solve(x.T @ (x * (w * curve)[:, None]) / w.sum() + penalty + 1e-12 * np.eye(len(beta)), gradient)
        beta -= step
        if np.abs(step).max() < 1e-13:
            break
    return np.exp(x @ beta)


@pytest.mark.parametrize("alpha", [1e-4, 0.1])
def test_poisson_matches_the_penalised_optimum(book, alpha):
    policies, _ = book
    model = models.train_frequency_model(policies, alpha=alpha)
    pdf = model.transform(policies).toPandas()
    expected = newton(design(pdf), (pdf["ClaimNb"] / pdf["Exposure"]).to_numpy(), pdf["Exposure"].to_numpy(), alpha, "poisson")
    assert np.allclose(pdf["predicted_annual_frequency"], expected, rtol=1e-7)


@pytest.mark.parametrize("alpha", [1e-4, 0.1])
def test_gamma_matches_the_penalised_optimum(book, alpha):
    _, claims = book
    model = models.train_severity_model(claims, alpha=alpha)
    pdf = model.transform(claims).toPandas()
    expected = newton(design(pdf), pdf["ClaimAmount"].to_numpy(), np.ones(len(pdf)), alpha, "gamma")
    assert np.allclose(pdf["predicted_claim_severity"], expected, rtol=1e-6)


def test_formula_equals_pipeline_and_ignores_unknown_levels(book):
    policies, _ = book
    model = models.train_frequency_model(policies)
    odd = policies.limit(50).withColumns({
        "VehBrand": F.when(F.col("IDpol") % 2 == 0, F.lit("never seen")).otherwise(F.col("VehBrand")),
        "Region": F.when(F.col("IDpol") % 3 != 0, F.col("Region")),
    })
    ours = model.transform(odd).select("IDpol", F.col("predicted_annual_frequency").alias("a"))
    theirs = model.pipeline.transform(odd).select("IDpol", F.col("prediction").alias("b"))
    gap = ours.join(theirs, "IDpol").agg(F.max(F.abs(F.col("a") / F.col("b") - 1)), F.count("a")).first()
    assert gap[0] < 1e-12 and gap[1] == 50


def test_predictions_are_positive_and_complete(book):
    policies, claims = book
    for name in ("poisson", "random_forest", "gbt"):
        scored = models.train_frequency_model(policies, name, config=SMALL).transform(policies)
        assert scored.where("predicted_annual_frequency > 0").count() == 600
    for name in ("gamma", "random_forest", "gbt"):
        scored = models.train_severity_model(claims, name, config=SMALL).transform(policies)
        assert scored.where("predicted_claim_severity > 0").count() == 600
    count = models.predict_claim_count(scored.withColumn("predicted_annual_frequency", F.lit(0.5))).first()
    assert count["predicted_claim_count"] == pytest.approx(0.5 * count["Exposure"])


def test_names_are_checked(book):
    policies, claims = book
    with pytest.raises(ValueError, match="Unsupported severity_model"):
        models.train_severity_model(claims, "invalid_model")
    with pytest.raises(ValueError, match="Unsupported frequency_model"):
        models.train_frequency_model(policies, "gamma")


def test_xgboost_is_optional(book):
    if models.xgboost_available():
        pytest.skip("xgboost is installed")
    with pytest.raises(ImportError, match="xgboost"):
        models.train_frequency_model(book[0], "xgboost")


def test_empty_training_data(book):
    with pytest.raises(ValueError, match="empty"):
        models.train_severity_model(book[1].withColumn("ClaimAmount", F.lit(0.0)))


def test_importance_for_forests_only(spark, book):
    policies, _ = book
    forest = models.train_frequency_model(policies, "random_forest", config=SMALL)
    rows = models.feature_importance(forest, spark).collect()
    names = {r.feature for r in rows}
    assert "DrivAge" in names and "VehBrand=B12" in names
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    assert models.feature_importance(forest, spark, top_n=3).count() == 3
    glm = models.train_frequency_model(policies)
    assert models.feature_importance(glm, spark) is None
    effects = {r.feature: r for r in models.glm_relativities(glm, spark).collect()}
    assert effects["VehGas=Diesel"]["relativity"] == pytest.approx(np.exp(effects["VehGas=Diesel"]["coefficient"]))
    assert models.glm_relativities(forest, spark) is None


def test_evaluate(book):
    policies, claims = book
    frequency = models.train_frequency_model(policies).evaluate(policies).first()
    assert frequency["sample_size"] == 600 and frequency["predicted_mean"] == pytest.approx(frequency["observed_mean"], rel=1e-3)
    severity = models.train_severity_model(claims).evaluate(claims).first()
    assert severity["gamma_deviance"] > 0 and severity["mae"] <= severity["rmse"]


def test_a_fit_without_penalty_ends_after_few_passes_and_meets_its_score_equations(book, monkeypatch):
    policies, _ = book
    passes, sums = [], glm._sums
    monkeypatch.setattr(glm, "_sums", lambda *a: passes.append(1) or sums(*a))
    twins = policies.withColumn("VehAge", F.col("VehPower") + F.col("VehAge") / 1000)  # nearly one direction: equations solved anew never settle
    model = models.train_frequency_model(twins, alpha=0.0, drop_reference=True)
    assert len(passes) <= 12
    fitted = model.transform(twins).withColumn("fitted", F.col("predicted_annual_frequency") * F.col("Exposure"))
    for name in MODEL_CATEGORICAL:
        for row in fitted.groupBy(name).agg(F.sum("fitted").alias("a"), F.sum("ClaimNb").alias("b")).collect():
            assert row.a == pytest.approx(row.b, rel=1e-9)


def test_a_model_with_reference_levels_is_a_formula_that_refuses_unseen_ones(book):
    policies, _ = book
    model = models.train_frequency_model(policies, alpha=0.0, drop_reference=True)
    assert models.glm_formula(model.pipeline) is not None
    pair = model.transform(policies).join(model.pipeline.transform(policies).select("IDpol", "prediction"), "IDpol")
    assert pair.agg(F.max(F.abs(F.col("predicted_annual_frequency") / F.col("prediction") - 1))).first()[0] < 1e-12
    for odd in (F.lit("never seen"), F.lit(None).cast("string")):
        with pytest.raises(Exception, match="Area was not seen"):
            model.transform(policies.withColumn("Area", odd)).agg(F.sum("predicted_annual_frequency")).collect()


def test_steps_that_go_too_far_are_halved_and_missing_targets_refused(spark):
    rows = spark.createDataFrame([(float(i % 7 == 0) * 40.0, 0, 1.0, 50.0 * (i % 7 == 0)) for i in range(70)], "x double, l int, w double, y double")
    beta = glm.fit_log_link(rows, "poisson", "y", "w", ["x"], ["l"], [0], 1e-3, 100, 1e-10)
    loss, slope, _ = glm._sums(rows, "poisson", "y", "w", ["x"], ["l"], [0], beta)
    assert np.abs(slope / 70 - [1e-3 * beta[0], 0.0]).max() < 1e-9
    with pytest.raises(ValueError, match="missing"):
        glm.fit_log_link(rows.withColumn("y", F.lit(None).cast("double")), "poisson", "y", "w", ["x"], ["l"], [0], 0.0, 5, 1e-10)


@pytest.mark.parametrize("family", ["poisson", "gamma"])
def test_packed_rows_give_the_sums_of_the_design_matrix(spark, family):
    draws = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": draws.normal(size=900), "z": draws.normal(size=900), "a": draws.integers(0, 4, 900), "b": draws.integers(0, 3, 900),
                        "y": draws.gamma(2.0, size=900), "w": draws.uniform(0.1, 1, 900)})
    rows = spark.createDataFrame(pdf).withColumn("b", F.nullif("b", F.lit(2))).repartition(5)
    ones = [(pdf["a"] == i) for i in range(3)] + [(pdf["b"] == i) for i in range(2)]  # level 3 of a and no level of b have no column
    x = np.stack([pdf["x"], pdf["z"], *ones, np.ones(900)], 1).astype(float)
    beta = draws.normal(size=8) / 4
    eta, y = x @ beta, pdf["y"].to_numpy()
    mu = np.exp(eta)
    loss, slope, curve = (mu - y * eta, y - mu, mu) if family == "poisson" else (y / mu + eta, y / mu - 1, y / mu)
    w = pdf["w"].to_numpy()
    packed = glm._pack(rows, "y", "w", ["x", "z"], ["a", "b"], F.lit(False))
    assert packed.count() <= 5  # a row per batch
    for form in (rows, packed):
        found = glm._sums(form, family, "y", "w", ["x", "z"], ["a", "b"], [3, 2], beta)
        for ours, theirs in zip(found, (w @ loss, x.T @ (w * slope), x.T @ (x * (w * curve)[:, None]))):
            assert np.allclose(ours, theirs, rtol=1e-12, atol=1e-10)
