"""Named queries that go through files: readers, sinks, the quote store, model artifacts and whole jobs.

Each writes the sample tables in the shape a job reads, runs the job and returns what it wrote. Models are one-factor
fits without penalty, which give every area its observed rates, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORICAL_DEFAULTS, MODEL_CATEGORICAL, NUMERIC_DEFAULTS, RATING_COLUMNS, ExperimentConfig
from ..config import ForestConfig, ModelConfig
from ..operators import datasets, diagnostics, features, models, pricing, ranking, retraining, validate
from ..runtime import scratch_path
from ..sources import artifacts, readers, sample_book, store
from . import experiments, harmonise, score, train
from .catalogue import (
    BASE_COLUMNS, CLAIMS_SRC, POL, POLICIES_SRC, SAMPLE_PRICING, SCORED, SQL, _claims, _policies, _quotes, _round, _scored,
    _tariff, comparison_payloads, query, sql,
)


def _csv(df: DataFrame, label: str, sep: str = ",") -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def _complete_policies(spark: SparkSession, folder: str) -> DataFrame:
    raw = sample_book.raw_policies(spark, folder).select(*BASE_COLUMNS)
    return raw.withColumns({"VehGas": F.coalesce("VehGas", F.lit("Regular")), "Density": F.coalesce("Density", F.lit(393.0))})


# ---- readers ------------------------------------------------------------------------------------
@query("load_policy_csv")
def load_policy_csv(spark, folder):
    """The checked policy reader on a CSV of the book."""
    loaded = readers.load_frequency_data(spark, _csv(_complete_policies(spark, folder), "policies"))
    texts = {"VehBrand", "VehGas", "Area", "Region"}
    numbers = {c: F.col(c).cast("double") for c in BASE_COLUMNS if c not in texts}
    return _round(loaded.withColumns(numbers).select(*BASE_COLUMNS), 6, "Density")


sql("load_policy_csv", f"""WITH {POLICIES_SRC} SELECT CAST(IDpol AS DOUBLE) AS IDpol, CAST(ClaimNb AS DOUBLE) AS ClaimNb, Exposure, VehPower,
VehAge, DrivAge, BonusMalus, VehBrand, coalesce(VehGas,'Regular') AS VehGas, Area, round(coalesce(Density,393.0::DOUBLE),6) AS Density, Region
FROM policies_src""")


@query("load_claim_csv")
def load_claim_csv(spark, folder):
    loaded = readers.load_severity_data(spark, _csv(sample_book.raw_claims(spark, folder), "claims"))
    return loaded.select(F.col("IDpol").cast("long"), F.round(F.col("ClaimAmount").cast("double"), 4).alias("ClaimAmount"))


sql("load_claim_csv", f"WITH {CLAIMS_SRC} SELECT IDpol, round(ClaimAmount,4) AS ClaimAmount FROM claims_src")


@query("dutch_csv_job")
def dutch_csv_job(spark, folder):
    """Raw CSV -> rating CSV, read back."""
    target = scratch_path(spark, "dutch")
    harmonise.harmonise_csv(spark, "dutch", _csv(sample_book.raw_dutch(spark, folder), "dutch-raw"), target)
    out = spark.read.option("header", True).schema(
        "Exposure double, VehPower double, VehAge double, DrivAge double, BonusMalus double, VehBrand string, VehGas string, Area string, "
        "Density double, Region string, claim_occurred boolean, claim_amount double, premium_paid double"
    ).csv(target)
    return _round(out, 6, "Exposure", "VehPower", "BonusMalus", "claim_amount")


sql("dutch_csv_job", SQL["dutch_portfolio"])


@query("spanish_csv_job")
def spanish_csv_job(spark, folder):
    """Summary of the job that reads the semicolon-separated CSV."""
    source = _csv(sample_book.raw_spanish(spark, folder), "spanish-raw", ";")
    out = harmonise.harmonise_csv(spark, "spanish", source, scratch_path(spark, "spanish"))
    return _round(out, 4, *[c for c in out.columns if c not in ("policies", "policies_with_claims", "severity_rows")])


sql("spanish_csv_job", SQL["spanish_portfolio_summary"])


@query("comparison_json_files")
def comparison_json_files(spark, folder):
    """Comparison results read from JSON documents, one per file line set."""
    path = scratch_path(spark, "runs")
    comparison_payloads(spark, folder).repartition(20, "payload").write.option("maxRecordsPerFile", 1).text(path)
    return diagnostics.comparison_rmse(readers.read_comparison_runs(spark, path))


sql("comparison_json_files", SQL["comparison_rmse_frame"])


def _line_files(spark: SparkSession, folder: str, swap: bool = False) -> str:
    """Orders as text lines in three files of unlike size, in key order; ``swap`` exchanges the first two keys' lines."""
    orders = sample_book.table(spark, folder, "orders")
    key = F.col("o_orderkey")
    part = F.when(key % 10 < 6, "a").when(key % 10 < 9, "b").otherwise("c")
    place = F.when(key == 1, F.lit(2)).when(key == 2, F.lit(1)).otherwise(key) if swap else key
    lines = orders.select(place.alias("place"), F.concat_ws("|", key.cast("string"), "o_orderstatus", "o_orderpriority").alias("value"), part.alias("part"))
    path = scratch_path(spark, "lines")
    lines.repartition("part").sortWithinPartitions("part", "place").drop("place").write.partitionBy("part").text(path)
    return path


@query("file_order_ids")
def file_order_ids(spark, folder):
    """Rows of three files of unlike size numbered by file and line."""
    path = _line_files(spark, folder)
    lines = spark.read.schema("value string, part string").text(path)
    numbered = features.fill_policy_ids(lines.select("value"), "file")
    return numbered.select(F.substring_index("value", "|", 1).cast("long").alias("order_key"), "IDpol")


sql("file_order_ids", """SELECT o_orderkey AS order_key, row_number() OVER (ORDER BY CASE WHEN o_orderkey%10<6 THEN 'a' WHEN o_orderkey%10<9 THEN 'b'
ELSE 'c' END, o_orderkey) AS IDpol FROM orders""")


@query("file_digests")
def file_digests(spark, folder):
    """Digest of every file, and of the same files with two lines swapped in one of them."""
    out = None
    for swapped in (False, True):
        found = readers.file_digests(spark, _line_files(spark, folder, swapped)).select(
            F.lit(swapped).alias("swapped"), F.regexp_extract("path", "part=([a-z])", 1).alias("part"), "lines", "digest"
        )
        out = found if out is None else out.unionByName(found)
    return out


sql("file_digests", """WITH l AS (SELECT s.swapped, CASE WHEN o_orderkey%10<6 THEN 'a' WHEN o_orderkey%10<9 THEN 'b' ELSE 'c' END AS part,
  CASE WHEN swapped AND o_orderkey=1 THEN 2 WHEN swapped AND o_orderkey=2 THEN 1 ELSE o_orderkey END AS place,
  sha256(concat_ws('|',CAST(o_orderkey AS VARCHAR),o_orderstatus,o_orderpriority)) AS d FROM orders, (VALUES (false),(true)) s(swapped)),
n AS (SELECT *, row_number() OVER (PARTITION BY swapped, part ORDER BY place)-1 AS i, count(*) OVER (PARTITION BY swapped, part) AS lines FROM l),
t AS (SELECT swapped, part, lines, i//4096 AS run, CASE WHEN count(*)=1 THEN min(d) ELSE sha256(string_agg(d,'' ORDER BY i)) END AS d FROM n GROUP BY ALL)
SELECT swapped, part, lines, CASE WHEN count(*)=1 THEN min(d) ELSE sha256(string_agg(d,'' ORDER BY run)) END AS digest FROM t GROUP BY ALL""")


@query("input_file_versions")
def input_file_versions(spark, folder):
    """Every file of a written table has a size, a time and a fingerprint; a missing path says so."""
    path = _csv(sample_book.raw_claims(spark, folder).repartition(3, "IDpol"), "versions")
    found = readers.file_versions(spark, path)
    absent = readers.file_versions(spark, f"{path}-absent")
    complete = F.col("size_bytes").isNotNull() & F.col("modified_utc").isNotNull() & F.col("fingerprint").isNotNull()
    return found.unionByName(absent).groupBy("exists").agg(
        F.bool_and(complete).alias("complete"), (F.count_distinct("fingerprint") == F.count("fingerprint")).alias("told_apart")
    )


sql("input_file_versions", "SELECT true AS \"exists\", true AS complete, true AS told_apart UNION ALL SELECT false, false, true")


# ---- checks that raise ----------------------------------------------------------------------------
@query("raising_checks")
def raising_checks(spark, folder):
    """What the checks of the readers and of the retraining job say about broken input."""
    policies = _complete_policies(spark, folder)
    records = sample_book.outcome_records(spark, folder)
    cases = {
        "missing_column": lambda: validate.require_columns(policies.drop("Area"), BASE_COLUMNS, "policies"),
        "non_numeric": lambda: validate.validate_schema(policies.withColumn("VehPower", F.lit("x")), "policies", BASE_COLUMNS, ["VehPower"]),
        "missing_values": lambda: validate.validate_schema(
            policies.withColumn("Area", F.nullif("Area", F.lit("A"))), "policies", BASE_COLUMNS, ["VehPower"]),
        "empty": lambda: validate.require_rows(policies.where("Exposure < 0")),
        "too_few_rows": lambda: retraining.require_min_rows(records.where("id = '4'")),
        "sound": lambda: (
            validate.validate_schema(policies, "policies", BASE_COLUMNS, ["VehPower"]), retraining.require_min_rows(records)),
    }
    rows = []
    for name, check in cases.items():
        try:
            check()
            rows.append((name, False))
        except validate.UnusableDataError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "check_name string, refused boolean")


sql("raising_checks", "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {r})" for n, r in [("missing_column", True), ("non_numeric", True), ("missing_values", True), ("empty", True),
                                 ("too_few_rows", True), ("sound", False)]) + ") t(check_name, refused)")


# ---- the quote store --------------------------------------------------------------------------------
STORED = ["id", "source", "consent", "exposure", "drivage", "final_premium"]


@query("quote_store_replay_two_days")
def quote_store_replay_two_days(spark, folder):
    """A batch written again on the next day replaces the first attempt in both tables."""
    root, priced = scratch_path(spark, "replay"), _tariff(_quotes(spark, folder))
    for day in (0, 1):
        shifted = priced.withColumn("created_at", F.col("created_at") + F.expr(f"INTERVAL {day} DAYS"))
        store.save_quotes(shifted, root, F.col("source"), F.col("consent"), batch_id="b1")
    parts = [
        store.read_table(spark, root, name).groupBy(F.lit(name).alias("table_name"), F.col("created_date").cast("string").alias("created_date"))
        .agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))
        for name in ("quotes", "training_data")
    ]
    return parts[0].unionByName(parts[1])


sql("quote_store_replay_two_days", """WITH e AS (SELECT event_id, CAST(ts + INTERVAL 1 DAY AS DATE) AS d FROM events)
SELECT 'quotes' AS table_name, CAST(d AS VARCHAR) AS created_date, count(*) AS rows, count(DISTINCT event_id) AS ids FROM e GROUP BY d
UNION ALL SELECT 'training_data', CAST(d AS VARCHAR), count(*), count(DISTINCT event_id) FROM e WHERE event_id%3=0 GROUP BY d""")


@query("ingest_quotes_csv")
def ingest_quotes_csv(spark, folder):
    """Quotes backfilled from a CSV, read back from the store."""
    root = scratch_path(spark, "ingest")
    given = _tariff(_quotes(spark, folder)).select(*RATING_COLUMNS, "final_premium", "risk_category")
    store.ingest_quotes_csv(spark, _csv(given, "quotes"), root)
    stored = store.read_table(spark, root, "quotes")
    return stored.groupBy("source", "consent", "vehbrand").agg(
        F.count("*").alias("rows"), F.round(F.sum("exposure"), 4).alias("exposure"), F.round(F.sum("drivage"), 2).alias("driver_ages")
    )


sql("ingest_quotes_csv", """SELECT 'backfill' AS source, false AS consent, concat('B',CAST(1+user_id%14 AS VARCHAR)) AS vehbrand, count(*) AS rows,
round(sum(CAST(1+user_id%100 AS DOUBLE)/100),4) AS exposure, round(sum(CAST(18+user_id%83 AS DOUBLE)),2) AS driver_ages FROM events GROUP BY 3""")


@query("ingest_portfolio_csv")
def ingest_portfolio_csv(spark, folder):
    """An insurer's portfolio loaded from a CSV, then fetched with the training data and combined with its origin."""
    root = scratch_path(spark, "b2b")
    records = sample_book.outcome_records(spark, folder).select("exposure", "vehpower", "area", "claim_occurred", "claim_amount", "premium_paid")
    store.ingest_b2b_csv(spark, _csv(records, "portfolio"), root, "sample")
    store.save_quotes(_tariff(_quotes(spark, folder)), root, F.col("source"), F.col("consent"))
    tables = store.fetch_training_data(spark, root)
    both = retraining.combine_records(tables["training_data"], tables["b2b_portfolios"])
    return both.groupBy("origin", "claim_occurred").agg(
        F.count("*").alias("rows"), F.round(F.sum("premium_paid"), 2).alias("premium_paid"), F.round(F.sum("claim_amount"), 2).alias("claim_amount")
    )


sql("ingest_portfolio_csv", f"""WITH {POLICIES_SRC}, r AS (SELECT coalesce(CASE WHEN p.IDpol%4<>0 THEN p.ClaimNb>0 END,false) AS c,
CASE WHEN p.IDpol%5<>0 THEN premium_paid END AS paid, cl.mean_amount AS a FROM policies_src p LEFT JOIN cl USING (IDpol))
SELECT 'b2b_portfolios' AS origin, c AS claim_occurred, count(*) AS rows, round(sum(paid),2) AS premium_paid, round(sum(a),2) AS claim_amount FROM r GROUP BY c
UNION ALL SELECT 'training_data', NULL, count(*), NULL, NULL FROM events WHERE event_id%3=0""")


@query("older_store_files")
def older_store_files(spark, folder):
    """Files written before a column existed show it as null beside newer ones."""
    root = scratch_path(spark, "older")
    quotes = _tariff(_quotes(spark, folder))
    store.write_table(store.quote_rows(quotes, "new"), root, "quotes", "new")
    old = store.quote_rows(quotes, "old").drop("risk_score").withColumn("created_date", F.to_date("created_at"))
    old.write.partitionBy("created_date").parquet(f"{root}/quotes/batch_id=old")
    return store.read_table(spark, root, "quotes").groupBy("source").agg(F.count("*").alias("rows"), F.count("risk_score").alias("with_score"))


sql("older_store_files", """SELECT 'new' AS source, count(*) AS rows, count(*) AS with_score FROM events
UNION ALL SELECT 'old', count(*), 0 FROM events""")


# ---- models and scoring -------------------------------------------------------------------------------
def _area_models(spark: SparkSession, folder: str):
    policies = _policies(spark, folder)
    claims = datasets.claims_with_factors(_claims(spark, folder), policies)
    options = {"alpha": 0.0, "numeric": [], "categorical": ["Area"], "drop_reference": True}
    return models.train_frequency_model(policies, **options), models.train_severity_model(claims, **options)


def _saved_models(spark: SparkSession, folder: str) -> str:
    frequency, severity = _area_models(spark, folder)
    metadata = {
        "numeric_defaults": NUMERIC_DEFAULTS, "categorical_defaults": CATEGORICAL_DEFAULTS, "pricing_config": {"fx_rate": SAMPLE_PRICING.fx_rate},
        "portfolio_baselines": dict.fromkeys(pricing.BASELINE_KEYS, 1.0), "risk_thresholds": pricing.risk_thresholds(),
    }
    root = scratch_path(spark, "models")
    artifacts.save_artifacts(spark, root, frequency, severity, metadata, {})
    return root


AREA_PRICED = SCORED + """, ap AS (SELECT pol.*, rate_frequency AS f, rate_severity*0.1::DOUBLE AS s,
greatest(rate_frequency*Exposure*rate_severity*0.1::DOUBLE*1.3+30,100) AS final_premium FROM pol JOIN rf USING (Area) JOIN rs USING (Area))"""


@query("score_csv_job")
def score_csv_job(spark, folder):
    """A CSV with broken lines scored by saved models into a CSV; broken lines come back apart."""
    lines = _complete_policies(spark, folder).drop("ClaimNb")
    header = ",".join(lines.columns)
    text = lines.select("IDpol", F.concat_ws(",", *[F.col(c).cast("string") for c in lines.columns]).alias("value"))
    broken = text.where("IDpol % 100 = 0").select(F.concat(F.col("IDpol").cast("string"), F.lit(",broken")).alias("value"))
    source, target = scratch_path(spark, "input"), scratch_path(spark, "scored")
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.text(source)
    rows = text.select("value").union(broken)
    # Every file of a CSV folder starts with the header.
    headed = rows.withColumn("first", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0)
    headed.select(F.when(F.col("first"), F.concat(F.lit(header + "\n"), F.col("value"))).otherwise(F.col("value")).alias("value")).write.mode(
        "append").text(source)
    malformed = score.score_csv(spark, source, target, _saved_models(spark, folder))
    scored = spark.read.option("header", True).csv(target).select(
        F.col("IDpol").cast("double").cast("long").alias("IDpol"), F.round(F.col("final_premium").cast("double"), 3).alias("final_premium"), "risk_category"
    )
    return scored.unionByName(malformed.select(
        F.col("IDpol").cast("long").alias("IDpol"), F.lit(None).cast("double").alias("final_premium"), F.lit("malformed").alias("risk_category")
    ))


sql("score_csv_job", f"""WITH {AREA_PRICED} SELECT IDpol, round(final_premium,3) AS final_premium,
CASE WHEN f*s<=160 THEN 'Low' WHEN f*s<=430 THEN 'Medium' ELSE 'High' END AS risk_category FROM ap
UNION ALL SELECT IDpol, NULL, 'malformed' FROM pol WHERE IDpol%100=0""")


@query("scenario_report_without_ids")
def scenario_report_without_ids(spark, folder):
    """The scenario job on a CSV without an id column: every policy gets a number of its own, shared by its variants."""
    target = scratch_path(spark, "scenarios")
    source = _csv(_complete_policies(spark, folder).select(*RATING_COLUMNS), "profiles")
    score.scenario_csv(spark, source, target, _saved_models(spark, folder))
    report = spark.read.option("header", True).csv(target)
    return report.groupBy("scenario_name").agg(
        F.count("*").alias("rows"), F.count_distinct("policy_id").alias("ids"), F.min(F.col("policy_id").cast("long")).alias("first_id"),
        F.max(F.col("policy_id").cast("long")).alias("last_id"), F.round(F.avg(F.col("final_premium").cast("double")), 3).alias("avg_premium"),
    )


sql("scenario_report_without_ids", f"""WITH {AREA_PRICED} SELECT scenario_name, count(*) AS rows, count(*) AS ids, 1::BIGINT AS first_id,
count(*) AS last_id, round(avg(final_premium),3) AS avg_premium FROM ap, (VALUES ('baseline'),('vehicle_power_decrease'),('vehicle_power_increase'),
('driver_age_decrease'),('driver_age_increase'),('bonus_malus_decrease'),('bonus_malus_increase')) t(scenario_name) GROUP BY 1""")


@query("predict_premiums_job")
def predict_premiums_job(spark, folder):
    """Loaded models applied to rows under other column names; rows without an id get one of their own below zero."""
    loaded = artifacts.load_artifacts(spark, _saved_models(spark, folder))
    rows = _complete_policies(spark, folder).select(
        F.when(F.col("IDpol") % 10 != 0, F.col("IDpol")).alias("policy_id"), *[F.col(c).alias(c.lower()) if c in ("Exposure", "Area", "Region", "Density") else F.col(c) for c in RATING_COLUMNS]
    )
    priced = score.predict_premiums(rows, loaded)
    return priced.groupBy("Area").agg(
        F.count_if(F.col("IDpol") > 0).alias("given_ids"), F.count_distinct(F.when(F.col("IDpol") < 0, F.col("IDpol"))).alias("made_ids"),
        F.round(F.avg("final_premium"), 3).alias("avg_premium"),
    )


sql("predict_premiums_job", f"""WITH {AREA_PRICED} SELECT Area, count(*) FILTER (IDpol%10<>0) AS given_ids, count(*) FILTER (IDpol%10=0) AS made_ids,
round(avg(final_premium),3) AS avg_premium FROM ap GROUP BY Area""")


@query("premium_comparison")
def premium_comparison(spark, folder):
    """The families' premium table under the job's own pricing, through its CSV; families without a model are empty."""
    frequency, severity = _area_models(spark, folder)
    attempts = {
        ("frequency", "poisson"): experiments.Attempt("success", 0.0, frequency), ("severity", "gamma"): experiments.Attempt("success", 0.0, severity),
    }
    target = scratch_path(spark, "comparison")
    artifacts.write_csv_report(experiments.premium_table(_policies(spark, folder), attempts, SAMPLE_PRICING), target, decimals=6)
    out = spark.read.option("header", True).csv(target)
    return out.select(
        F.col("policy_id").cast("long"), *[F.round(F.col(f"glm_{c}").cast("double"), 3).alias(f"glm_{c}") for c in ("predicted_frequency", "predicted_severity", "premium")],
        F.col("rf_premium").cast("double").alias("rf_premium"), F.col("xgb_premium").cast("double").alias("xgb_premium"),
    )


sql("premium_comparison", f"""WITH {AREA_PRICED} SELECT IDpol AS policy_id, round(round(f,6),3) AS glm_predicted_frequency, round(round(s,6),3) AS glm_predicted_severity,
round(round(final_premium,6),3) AS glm_premium, CAST(NULL AS DOUBLE) AS rf_premium, CAST(NULL AS DOUBLE) AS xgb_premium FROM ap""")


@query("top_premiums_file")
def top_premiums_file(spark, folder):
    target = scratch_path(spark, "top")
    artifacts.write_csv_report(pricing.top_premiums(_scored(spark, folder, own_baselines=True), 1000), target)
    out = spark.read.option("header", True).csv(target)
    numbers = [c for c in pricing.TOP_PREMIUM_COLUMNS if c not in ("IDpol", "risk_category")]
    typed = out.withColumns({"IDpol": F.col("IDpol").cast("long"), **{c: F.col(c).cast("double") for c in numbers}})
    return _round(typed, 4, *[c for c in numbers if c != "Exposure"])


sql("top_premiums_file", SQL["top_premiums"])


@query("run_records")
def run_records(spark, folder):
    """Two runs recorded and read back: ids, and the row counts inside the stored summary."""
    path = scratch_path(spark, "runs-table")
    counts = {"policy_rows": _policies(spark, folder).count(), "claim_rows": _claims(spark, folder).count()}
    for _ in range(2):
        artifacts.record_run(spark, path, dataset_summary=counts)
    rows = spark.read.parquet(path)
    return rows.groupBy(F.get_json_object("dataset_summary", "$.policy_rows").cast("long").alias("policy_rows"),
                        F.get_json_object("dataset_summary", "$.claim_rows").cast("long").alias("claim_rows")).agg(F.count("run_id").alias("runs"))


sql("run_records", f"WITH {POL} SELECT (SELECT count(*) FROM pol) AS policy_rows, (SELECT count(*) FROM sev) AS claim_rows, 2::BIGINT AS runs")


@query("glm_score_equations")
def glm_score_equations(spark, folder):
    """All factors, no penalty: for every level the fitted claims equal the observed ones, as the score equations ask."""
    policies = _policies(spark, folder)
    model = models.train_frequency_model(policies, alpha=0.0, drop_reference=True)
    scored = model.transform(policies).withColumn("fitted", F.col("predicted_annual_frequency") * F.col("Exposure"))
    levels = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in MODEL_CATEGORICAL])
    return scored.select("fitted", F.inline(levels)).groupBy("feature", "level").agg(F.round(F.sum("fitted"), 1).alias("claims"))


sql("glm_score_equations", f"WITH {POL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS level, round(sum(ClaimNb)::DOUBLE,1) AS claims FROM pol GROUP BY 2" for c in MODEL_CATEGORICAL))


def _one_tree() -> ModelConfig:
    from dataclasses import replace

    base = ModelConfig()
    one = ForestConfig(trees=1, bootstrap=False)
    return replace(base, frequency=replace(base.frequency, forest=one), severity=replace(base.severity, forest=one))


@query("single_tree_rates")
def single_tree_rates(spark, folder):
    """A tree that sees only the area, with all rows and no limit, gives every area its rate by exposure."""
    policies = _policies(spark, folder)
    model = models.train_frequency_model(policies, "random_forest", config=_one_tree(), numeric=[], categorical=["Area"])
    return _round(model.transform(policies).groupBy("Area").agg(F.avg("predicted_annual_frequency").alias("frequency")), 6, "frequency")


sql("single_tree_rates", f"WITH {SCORED} SELECT Area, round(rate_frequency,6) AS frequency FROM rf")


@query("single_tree_importance")
def single_tree_importance(spark, folder):
    """Importances of that tree: one per level, none negative, one in sum."""
    policies = _policies(spark, folder)
    model = models.train_frequency_model(policies, "random_forest", config=_one_tree(), numeric=[], categorical=["Area"])
    rows = models.feature_importance(model, spark)
    return rows.agg(F.count("*").alias("levels"), F.round(F.sum("importance"), 6).alias("total"), F.bool_and(F.col("importance") >= 0).alias("sound"))


sql("single_tree_importance", f"WITH {POL} SELECT count(DISTINCT Area) AS levels, 1.0::DOUBLE AS total, true AS sound FROM pol")


@query("approximate_deciles")
def approximate_deciles(spark, folder):
    """Buckets from a sketch: ten of them, each within one percent of a tenth of the rows."""
    rows = sample_book.raw_policies(spark, folder).select("premium_paid")
    counts = ranking.with_approx_bucket(rows, "premium_paid").groupBy("bucket").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bucket", (F.abs(F.col("n") / F.col("total") - 0.1) < 0.01).alias("near_a_tenth"))  # one row


sql("approximate_deciles", "SELECT CAST(range AS INT) AS bucket, true AS near_a_tenth FROM range(10)")


@query("training_job")
def training_job(spark, folder):
    """The whole training job with its default regressions: what it counted, wrote and recorded."""
    out = scratch_path(spark, "training")
    data = datasets.prepare_model_datasets(_complete_policies(spark, folder), sample_book.raw_claims(spark, folder))
    train.train_on(spark, data, out, experiments=ExperimentConfig(enabled=False), pricing=SAMPLE_PRICING)
    run = spark.read.parquet(f"{out}/runs")
    report = spark.read.option("header", True).csv(f"{out}/reports/top_premiums").agg(F.count("*").alias("top_rows"))
    loaded = artifacts.load_artifacts(spark, f"{out}/models")
    return run.crossJoin(report).select(  # one row each
        F.get_json_object("dataset_summary", "$.policy_rows").cast("long").alias("policy_rows"),
        F.get_json_object("dataset_summary", "$.claim_rows").cast("long").alias("claim_rows"),
        F.get_json_object("data_quality", "$.policies_with_claims").cast("long").alias("policies_with_claims"), "top_rows",
        F.lit(loaded["frequency_model"].name).alias("frequency_model"), F.lit(loaded["severity_model"].name).alias("severity_model"),
    )


sql("training_job", f"""WITH {POL} SELECT count(*) AS policy_rows, (SELECT count(*) FROM sev) AS claim_rows, count(*) FILTER (ClaimNb>0) AS policies_with_claims,
least(count(*),1000) AS top_rows, 'poisson' AS frequency_model, 'gamma' AS severity_model FROM pol""")


@query("retraining_counters")
def retraining_counters(spark, folder):
    """The counters of a retraining set beside those of training."""
    policies, claims = retraining.retraining_frames(sample_book.outcome_records(spark, folder))
    return retraining.retraining_quality(policies, claims)


sql("retraining_counters", f"""WITH {POLICIES_SRC}, r AS (SELECT CASE WHEN p.IDpol%4<>0 THEN p.ClaimNb>0 END AS c, cl.mean_amount AS a,
CASE WHEN p.IDpol%5<>0 THEN premium_paid END AS paid FROM policies_src p LEFT JOIN cl USING (IDpol)),
k AS (SELECT coalesce(c,false) OR coalesce(a,0)>0 AS claimed, coalesce(a,0)>0 AS has_amount, coalesce(paid,0)>0 AS has_paid FROM r)
SELECT count(*) AS frequency_rows, count(*) FILTER (has_amount) AS severity_rows, count(*) FILTER (claimed) AS policies_with_claims,
count(*) FILTER (has_amount) AS policies_with_paid_amounts, count(*) FILTER (claimed AND NOT has_amount) AS positive_claim_count_without_paid_amount,
0::BIGINT AS severity_rows_without_matching_policy, count(*) FILTER (has_amount) AS claim_rows_used_for_severity_model,
count(*) FILTER (has_paid) AS policies_with_paid_premium FROM k""")
