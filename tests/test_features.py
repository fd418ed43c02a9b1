import math

import pytest
from pyspark.sql import functions as F

from ratespark.config import CATEGORICAL_DEFAULTS, NUMERIC_DEFAULTS, RATING_COLUMNS
from ratespark.operators.datasets import (
    clean_frequency_data,
    clean_severity_data,
    claims_with_factors,
    data_quality,
    hot_keys,
    join_on_skewed_key,
    prepare_model_datasets,
    training_policies,
)
from ratespark.operators.features import build_inference_frame, engineer_features, fill_policy_ids
from ratespark.operators.validate import (
    UnusableDataError,
    has_min_rows,
    prediction_columns,
    prediction_pairs,
    split_by_contract,
    validate_schema,
)

METADATA = {"numeric_defaults": NUMERIC_DEFAULTS, "categorical_defaults": CATEGORICAL_DEFAULTS}


def test_missing_column_is_reported(raw_policies):
    with pytest.raises(UnusableDataError, match="missing required columns"):
        clean_frequency_data(raw_policies.drop("VehPower"))


def test_missing_pricing_columns_are_reported(raw_policies):
    with pytest.raises(UnusableDataError, match="missing required pricing columns"):
        build_inference_frame(raw_policies.select("Exposure", "VehPower", "VehAge", "DrivAge"))


def test_empty_input_is_reported(raw_policies):
    with pytest.raises(UnusableDataError, match="empty"):
        build_inference_frame(raw_policies.where("false"))


def test_alias_names(spark):
    row = spark.createDataFrame(
        [(1001, 0.8, 8, 5, 42, 55, "B12", "Regular", "C", 390, "Centre")],
        "policy_id long, exposure double, vehicle_power int, vehicle_age int, driver_age int, bonus_malus int, "
        "vehicle_brand string, fuel_type string, area string, population_density int, region string",
    )
    out = build_inference_frame(row, METADATA)
    assert set(["IDpol", *RATING_COLUMNS]) <= set(out.columns)
    assert "policy_id" in out.columns
    got = out.first()
    assert got["IDpol"] == 1001 and got["Exposure"] == 0.8 and got["Density"] == 390.0


def test_first_alias_wins_without_filling_from_the_second(spark):
    df = spark.createDataFrame([(None, 9.0)], "vehicle_power double, power double")
    out = engineer_features(df, NUMERIC_DEFAULTS, CATEGORICAL_DEFAULTS).first()
    assert out["VehPower"] == NUMERIC_DEFAULTS["VehPower"]


def test_batch_defaults_are_median_and_mode(spark):
    df = spark.createDataFrame(
        [(1, 4.0, "x"), (2, 6.0, "b "), (3, None, "b"), (4, 9.0, "x"), (5, 10.0, " ")], "IDpol long, VehPower double, Area string"
    )
    rows = {r.IDpol: r for r in engineer_features(df).collect()}
    assert rows[3]["VehPower"] == 7.5  # median of 4, 6, 9, 10
    assert rows[5]["Area"] == "b"  # tie of b and x: the smaller
    assert rows[1]["VehAge"] == NUMERIC_DEFAULTS["VehAge"]


def test_log_density_and_blank_category(raw_policies):
    blank = raw_policies.withColumn("VehBrand", F.when(F.col("IDpol") == 1, "").otherwise(F.col("VehBrand")))
    out = engineer_features(blank)
    assert out.where("LogDensity < 0 OR trim(VehBrand) = ''").count() == 0
    one = out.where("IDpol = 2").first()
    assert one["LogDensity"] == pytest.approx(math.log1p(one["Density"]))


def test_simulated_flag(spark):
    numeric_only = spark.createDataFrame([(1, "5"), (2, "x")], "IDpol long, daily_mileage string")
    flags = {r.IDpol: r.has_simulated_behavioral_inputs for r in engineer_features(numeric_only, **_all()).collect()}
    assert flags == {1: 1, 2: 0}
    with_text = spark.createDataFrame([(1, None)], "IDpol long, vehicle_type string")
    row = engineer_features(with_text, **_all()).first()
    assert row["has_simulated_behavioral_inputs"] == 1 and row["simulated_vehicle_type"] == "NotProvided"


def _all():
    return {"numeric_defaults": NUMERIC_DEFAULTS, "categorical_defaults": CATEGORICAL_DEFAULTS}


def test_missing_ids_get_positions(spark):
    df = spark.createDataFrame([(10.0,), (None,), (30.0,)], "IDpol double").coalesce(1)
    assert [r[0] for r in fill_policy_ids(df, "position").collect()] == [10, 2, 30]
    many = spark.range(0, 1000, 1, 7).select(F.col("id").alias("v"))
    ids = fill_policy_ids(many, "position")
    assert ids.where(F.col("IDpol") != F.col("v") + 1).count() == 0
    hashed = fill_policy_ids(df, "hash").where("IDpol < 0")
    assert hashed.count() == 1


def test_severity_keeps_paid_claims_only(spark):
    df = spark.createDataFrame([("1", "10"), ("1", "0"), ("2", "-5"), (None, "3"), ("x", "3"), ("3", "abc")], "IDpol string, ClaimAmount string")
    assert [tuple(r) for r in clean_severity_data(df).collect()] == [(1, 10.0)]


def test_claim_count_and_exposure_cleaning(spark, raw_policies):
    odd = raw_policies.limit(1).withColumns({"ClaimNb": F.lit(-3.0), "Exposure": F.lit(None).cast("double")})
    row = clean_frequency_data(odd).first()
    assert (row["ClaimNb"], row["Exposure"], row["has_claim"], row["observed_claim_frequency"]) == (0, 1.0, 0, 0.0)


def test_validation_messages(spark):
    df = spark.createDataFrame([("a", None), ("b", "1")], "x string, y string")
    with pytest.raises(UnusableDataError, match="non-numeric"):
        validate_schema(df, "T", ["x"], ["x"])
    with pytest.raises(UnusableDataError, match="missing values"):
        validate_schema(df, "T", ["y"], ["y"])
    validate_schema(df, "T", ["y"], ["y"], allow_missing={"y"})


def test_row_contract(raw_policies):
    bad = raw_policies.withColumn("DrivAge", F.when(F.col("IDpol") == 1, 17.0).when(F.col("IDpol") == 2, None).otherwise(F.col("DrivAge")))
    valid, quarantine = split_by_contract(bad)
    assert valid.count() == 28
    assert {tuple(r.violations) for r in quarantine.collect()} == {("DrivAge_out_of_range",)}


def test_min_rows(raw_policies):
    assert has_min_rows(raw_policies, 30) and not has_min_rows(raw_policies, 31)


def test_prediction_columns(spark):
    df = spark.createDataFrame([("1", "1.1"), ("x", "2")], "y_true string, y_pred string")
    assert prediction_columns(df) == ("y_true", "y_pred")
    rows = prediction_pairs(df).collect()
    assert len(rows) == 1 and rows[0]["error"] == pytest.approx(-0.1)
    with pytest.raises(UnusableDataError, match="No known pair"):
        prediction_columns(df.drop("y_pred"))
    with pytest.raises(UnusableDataError, match="numeric actual"):
        prediction_pairs(df.where("y_true = 'x'"))


def test_datasets_and_quality(raw_policies, raw_claims, spark):
    extra = spark.createDataFrame([(999, 50.0), (999, 70.0)], raw_claims.schema)
    data = prepare_model_datasets(raw_policies, raw_claims.unionByName(extra))
    quality = data.quality.first().asDict()
    claimed = raw_policies.where("ClaimNb > 0").count()
    assert quality["frequency_rows"] == 30 and quality["policies_with_claims"] == claimed
    assert quality["severity_rows"] == raw_claims.count() + 2
    assert quality["severity_rows_without_matching_policy"] == 2
    assert quality["claim_rows_used_for_severity_model"] == data.claims.count() == raw_claims.count()
    assert quality["positive_claim_count_without_paid_amount"] == 0
    for r in data.policies.collect():
        assert r.AverageClaimAmount == (r.TotalClaimAmount / r.ClaimNb if r.ClaimNb else 0.0)


def test_claims_read_the_policies_that_training_keeps(raw_policies, raw_claims):
    data = prepare_model_datasets(raw_policies.withColumn("marker", F.lit(1)), raw_claims)
    kept = training_policies(data.policies).persist()
    try:
        plan = data.claims.select("IDpol", "Area")._jdf.queryExecution().withCachedData().toString()
    finally:
        kept.unpersist()
    assert "InMemoryRelation" in plan and "has_claim" in plan and "marker" not in plan


def test_skewed_join_equals_plain_join(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("IDpol"), F.col("id").alias("ClaimAmount"))
    lookup = spark.range(60).select(F.col("id").alias("IDpol"), (F.col("id") * 2).alias("v"))
    assert hot_keys(facts, "IDpol", 0.1) == [7]
    assert hot_keys(spark.range(5000).withColumnRenamed("id", "IDpol"), "IDpol") == []
    for how in ("inner", "left"):
        plain = facts.join(lookup.where("IDpol < 40"), "IDpol", how)
        salted = join_on_skewed_key(facts, lookup.where("IDpol < 40"), "IDpol", how)
        assert plain.exceptAll(salted.select(plain.columns)).count() == 0 and plain.count() == salted.count()
        assert join_on_skewed_key(facts, lookup, "IDpol", how, hot=[1, 2, 3]).count() == 3000


def test_claims_carry_factors(raw_policies, raw_claims, policies):
    joined = claims_with_factors(clean_severity_data(raw_claims), policies, hot=None)
    assert set([*RATING_COLUMNS, "LogDensity", "ClaimAmount"]) <= set(joined.columns)
    assert joined.count() == raw_claims.count()
