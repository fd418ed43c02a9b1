import json

import pytest
from pyspark.sql import functions as F

from book_helpers import make_claims, make_policies
from ratespark.config import BoostConfig, ExperimentConfig, ForestConfig, ModelConfig, RoleConfig
from ratespark.operators.diagnostics import comparison_rmse
from ratespark.operators.portfolios import dutch_portfolio, portfolio_summary, spanish_portfolio
from ratespark.plans import experiments, monitor, score, train
from ratespark.sources import artifacts, readers, store

SMALL = ModelConfig(
    frequency=RoleConfig(BoostConfig(5, "count:poisson"), forest=ForestConfig(4, 4)),
    severity=RoleConfig(BoostConfig(5, "reg:gamma"), forest=ForestConfig(4, 4)),
)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("train")
    policies = make_policies(spark, 400)
    policies.write.option("header", True).csv(f"{root}/freq")
    make_claims(policies).write.option("header", True).csv(f"{root}/sev")
    result = train.load_and_train(
        spark, f"{root}/freq", f"{root}/sev", f"{root}/out", models=SMALL,
        experiments=ExperimentConfig(sample_fraction=0.9, forest_trees=4),
    )
    return str(root), result


def test_training_writes_everything(spark, trained):
    root, result = trained
    assert result["metadata"]["dataset_summary"]["policy_rows"] == 400
    assert result["metrics"]["frequency"]["sample_size"] == pytest.approx(80, abs=2)
    runs = artifacts.read_json(spark, f"{root}/out/evaluation/model_comparison")
    assert len(runs) == 9 and {"poisson_gamma", "rf_rf", "xgb_xgb"} <= set(runs)
    assert runs["poisson_gamma"]["status"] == "success"
    assert runs["poisson_gamma"]["metrics"]["severity"]["metrics"]["gamma_deviance"] > 0
    if runs["xgb_xgb"]["status"] != "success":
        assert runs["xgb_xgb"]["status"] == "skipped" and "xgboost" in runs["xgb_xgb"]["error"]
    table = spark.read.option("header", True).csv(f"{root}/out/reports/model_comparison")
    assert table.columns == ["policy_id"] + [
        f"{f}_{c}" for f in ("glm", "rf", "xgb") for c in ("predicted_frequency", "predicted_severity", "premium")
    ]
    assert table.where("double(glm_premium) >= 100 AND double(rf_premium) >= 100").count() == table.count()
    saved = readers.read_comparison_runs(spark, f"{root}/out/evaluation/model_comparison")
    assert comparison_rmse(saved).where("run_name = 'rf_rf'").count() == 2
    recorded = spark.read.parquet(f"{root}/out/runs").first()
    assert recorded["run_id"] == result["run_id"] and json.loads(recorded["data_quality"])["frequency_rows"] == 400
    top = spark.read.option("header", True).csv(f"{root}/out/reports/top_premiums")
    assert top.count() == 400


def test_saved_models_score_alike(spark, trained, tmp_path):
    root, result = trained
    loaded = artifacts.load_artifacts(spark, f"{root}/out/models")
    assert loaded["metrics"] == result["metrics"]
    assert loaded["metadata"]["portfolio_baselines"] == result["metadata"]["portfolio_baselines"]
    (tmp_path / "in.csv").write_text(
        "Exposure,VehPower,VehAge,DrivAge,BonusMalus,VehBrand,VehGas,Area,Density,Region\n"
        "1,6,4,50,50,B12,Regular,A,50,Centre\n1,6,6,45,100,B12,Regular,D,3000,Centre\n1,x,2,20,200,NA,Regular,F,8000,Bretagne\n"
    )
    score.score_csv(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out", f"{root}/out/models")
    rows = spark.read.option("header", True).csv(f"{tmp_path}/out").orderBy("IDpol").collect()
    assert [r.IDpol for r in rows] == ["1", "2", "3"] and all(float(r.final_premium) >= 100 for r in rows)
    assert rows[2].VehBrand == loaded["metadata"]["categorical_defaults"]["VehBrand"]
    score.scenario_csv(spark, f"{tmp_path}/in.csv", f"{tmp_path}/scenarios", f"{root}/out/models")
    report = spark.read.option("header", True).csv(f"{tmp_path}/scenarios")
    assert report.count() == 21 and report.select("policy_id").distinct().count() == 3


def test_missing_artifacts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        artifacts.load_artifacts(spark, str(tmp_path))


def test_retraining_from_the_store(spark, trained, tmp_path):
    root, _ = trained
    outcomes = make_policies(spark, 300).withColumns({
        "claim_occurred": F.col("ClaimNb") > 0, "premium_paid": F.lit(300.0),
        "claim_amount": F.when(F.col("ClaimNb") > 0, F.lit(100.0) + F.col("BonusMalus")),
    })
    store.save_b2b_portfolio(outcomes, f"{tmp_path}/store", "Acme")
    quotes = outcomes.limit(20)
    loaded = artifacts.load_artifacts(spark, f"{root}/out/models")
    store.save_quotes(score.predict_premiums(quotes, loaded), f"{tmp_path}/store", consent=True)
    result = train.retrain(spark, f"{tmp_path}/store", f"{tmp_path}/out", models=SMALL, experiments=ExperimentConfig(enabled=False))
    assert result["metadata"]["data_quality"]["frequency_rows"] == 320
    assert result["metadata"]["data_quality"]["policies_with_paid_premium"] == 300
    report = {(r.component, r.metric): r for r in monitor.drift_check(spark, f"{tmp_path}/store", loaded).collect()}
    assert report["frequency", "policies"].value == 300
    assert report["severity", "matched_claims"].value == outcomes.where("ClaimNb > 0").count()
    assert report["severity", "median_ratio"].value > 0


def test_bundled_portfolio_is_optional(spark, trained, tmp_path):
    root, _ = trained
    assert train.bundled_if_present(spark, f"{tmp_path}/no.csv", f"{tmp_path}/none.csv") is None
    assert train.bundled_if_present(spark, f"{root}/freq", f"{root}/sev").policies.count() == 400


def test_run_keys_and_family_columns():
    assert experiments.run_key("poisson", "gamma") == "poisson_gamma"
    assert experiments.run_key("random_forest", "xgboost") == "rf_xgb"


def test_dutch_rows(spark):
    raw = spark.createDataFrame(
        [("40", "2", "0.5", "300", "20", "1", "0"), ("50", "0", "1", "0", "100", "23", "3"),
         ("30", "1", "0", "9", "500", "9", "1"), ("30", "0", "1", "60", "60", "12", "9")],
        "age_policyholder string, nclaims string, exposure string, amount string, power string, bm string, zip string",
    )
    rows = dutch_portfolio(raw).orderBy("DrivAge").collect()
    assert [(r.DrivAge, r.VehPower, r.BonusMalus, r.Area) for r in rows] == [(30.0, 12.0, 140.0, None), (40.0, 4.0, 50.0, "A"), (50.0, 20.0, 230.0, "D")]
    assert [(r.claim_occurred, r.claim_amount) for r in rows] == [(False, 60.0), (True, 150.0), (False, 0.0)]
    assert portfolio_summary(dutch_portfolio(raw)).first()["severity_rows"] == 2


def test_spanish_rows(spark):
    raw = spark.createDataFrame(
        [("1", "100.5", "0", "2010", "05/11/2015", "01/02/1980", "2", "D", "1", "2", "90"),
         ("2", "50", "10", "2020", "bad", "01/02/1980", None, "X", None, None, "30"),
         ("3", "60", "30", "2000", "05/11/2017", "01/02/2010", "99", "P", "0", "0", None),
         ("4", None, "999", "2000", "05/11/2017", "01/02/1950", "0", "P", "0", "0", "0")],
        "ID string, Premium string, Power string, Year_matriculation string, Date_start_contract string, Date_birth string, "
        "N_claims_history string, Type_fuel string, Area string, N_claims_year string, Cost_claims_year string",
    )
    one, two, three = spanish_portfolio(raw).orderBy("IDpol").collect()
    assert (one.VehPower, one.VehAge, one.DrivAge, one.BonusMalus, one.VehGas, one.Area) == (12.0, 8.0, 35.0, 68.0, "Diesel", "B")
    assert (one.claim_occurred, one.claim_amount, one.premium_paid) == (True, 45.0, 100.5)
    assert (two.VehPower, two.VehAge, two.DrivAge, two.BonusMalus, two.VehGas, two.Area) == (4.0, 0.0, 40.0, 50.0, "Regular", "A")
    assert (two.claim_occurred, two.claim_amount) == (False, 30.0)
    assert (three.VehPower, three.DrivAge, three.BonusMalus) == (20.0, 18.0, 230.0)
