"""Named queries over the sample tables, each with SQL for an independent check.

Monetary and ratio outputs are rounded, because engines add floating-point numbers in different
order. Queries whose result no SQL engine can reproduce (fitted forests, penalised regressions)
have no SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORICAL_DEFAULTS, NUMERIC_DEFAULTS, RATING_COLUMNS, ExperimentConfig, ModelConfig, PricingConfig
from ..functions.rating import md5_order
from ..operators import book, datasets, diagnostics, drift, features, isolation, metrics, models, portfolios, pricing
from ..operators import ranking, retraining, sampling, scenarios, stats, validate
from ..runtime import scratch_path
from ..schemas import BATCH_REQUEST
from ..sources import readers, sample_book, store
from ..streaming import quotes as streams
from . import experiments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE_COLUMNS = ["IDpol", "ClaimNb", *RATING_COLUMNS]
# Sample claims are some ten times the size the risk bands are made for.
SAMPLE_PRICING = PricingConfig(fx_rate=0.1)

# ---- shared SQL building blocks ----------------------------------------------------------------
CLAIMS_SRC = """claims_src AS (
  SELECT l_orderkey AS IDpol, l_extendedprice*l_discount AS ClaimAmount, l_linenumber AS claim_seq
  FROM lineitem WHERE l_returnflag='R' AND l_linestatus='F'),
cl AS (SELECT IDpol, count(*) AS n, sum(ClaimAmount) AS total, avg(ClaimAmount) AS mean_amount
  FROM claims_src GROUP BY IDpol)"""
POLICIES_SRC = CLAIMS_SRC + """,
policies_src AS (
  SELECT o.o_orderkey AS IDpol, coalesce(cl.n,0) AS ClaimNb,
    CAST(1+o.o_orderkey%100 AS DOUBLE)/CAST(100 AS DOUBLE) AS Exposure,
    CAST(4+o.o_custkey%12 AS DOUBLE) AS VehPower,
    CAST(2001-year(o.o_orderdate) AS DOUBLE) AS VehAge,
    CAST(18+o.o_custkey%83 AS DOUBLE) AS DrivAge,
    CAST(50+o.o_orderkey%181 AS DOUBLE) AS BonusMalus,
    concat('B',CAST(1+o.o_custkey%14 AS VARCHAR)) AS VehBrand,
    CASE WHEN o.o_orderstatus='F' THEN 'Diesel' WHEN o.o_orderstatus='O' THEN 'Regular' END AS VehGas,
    substr('ABCDEF',CAST(1+o.o_custkey%6 AS INT),1) AS Area,
    CASE WHEN o.o_orderkey%97<>0 THEN o.o_totalprice/CAST(20 AS DOUBLE) END AS Density,
    n.n_name AS Region, o.o_totalprice/1000.0::DOUBLE AS premium_paid,
    CAST(year(o.o_orderdate) AS INT) AS policy_year
  FROM orders o JOIN customer c ON c.c_custkey=o.o_custkey
  JOIN nation n ON n.n_nationkey=c.c_nationkey LEFT JOIN cl ON cl.IDpol=o.o_orderkey)"""
# Features with the global constants as defaults.
POL = POLICIES_SRC + """,
pol AS (
  SELECT IDpol, ClaimNb, least(greatest(Exposure,1e-6),2.5) AS Exposure,
    least(greatest(VehPower,1),20) AS VehPower, least(greatest(VehAge,0),100) AS VehAge,
    least(greatest(DrivAge,18),100) AS DrivAge, least(greatest(BonusMalus,50),350) AS BonusMalus,
    VehBrand, coalesce(VehGas,'Regular') AS VehGas, Area,
    least(greatest(coalesce(Density,393.0::DOUBLE),0),27000) AS Density, Region, premium_paid, policy_year
  FROM policies_src),
sev AS (SELECT IDpol, ClaimAmount, claim_seq FROM claims_src WHERE ClaimAmount > 0),
tot AS (SELECT IDpol, sum(ClaimAmount) AS TotalClaimAmount, count(*) AS paid FROM sev GROUP BY IDpol)"""
# Policies priced with the observed rates of their area, frequency scaled by bonus-malus.
SCORED = POL + """,
rf AS (SELECT Area, sum(ClaimNb)/sum(Exposure) AS rate_frequency FROM pol GROUP BY Area),
rs AS (SELECT p.Area, avg(s.ClaimAmount) AS rate_severity FROM sev s JOIN pol p USING (IDpol) GROUP BY p.Area),
fs AS (SELECT pol.*, rate_frequency*(BonusMalus/140.0::DOUBLE) AS f, rate_severity*0.1::DOUBLE AS s FROM pol LEFT JOIN rf USING (Area) LEFT JOIN rs USING (Area)),
base AS (SELECT greatest(avg(f),1) AS bf, greatest(avg(s),1) AS bs, greatest(avg(f*s),1) AS bl FROM fs),
prem AS (SELECT fs.*, f*Exposure AS cnt, f*s AS ann, f*Exposure*s AS pure FROM fs),
scored AS (
  SELECT prem.*, pure*1.3+30 AS technical_premium, greatest(pure*1.3+30,100) AS final_premium,
    f/bf AS frequency_relativity, s/bs AS severity_relativity, 100*ann/bl AS risk_score,
    CASE WHEN ann<=160 THEN 'Low' WHEN ann<=430 THEN 'Medium' ELSE 'High' END AS risk_category
  FROM prem, base)"""


def sql(name: str, text: str) -> None:
    SQL[name] = text


def query(name: str):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def _round(df: DataFrame, decimals: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, decimals) for c in columns})


def _metadata() -> dict:
    return {"numeric_defaults": NUMERIC_DEFAULTS, "categorical_defaults": CATEGORICAL_DEFAULTS}


def _policies(spark: SparkSession, folder: str) -> DataFrame:
    """Engineered policies; defaults are given, so no job runs."""
    return features.engineer_features(
        sample_book.raw_policies(spark, folder), NUMERIC_DEFAULTS, CATEGORICAL_DEFAULTS, batch_defaults=False
    )


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.clean_severity_data(sample_book.raw_claims(spark, folder))


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    policies = _policies(spark, folder)
    rates = pricing.segment_rates(policies, _claims(spark, folder))
    rated = pricing.with_segment_rates(policies, rates)
    return rated.withColumn("rated_frequency", F.col("rate_frequency") * (F.col("BonusMalus") / F.lit(140.0)))


def _scored(spark: SparkSession, folder: str, own_baselines: bool = False) -> DataFrame:
    """Policies priced at their area's rates; baselines are left at one unless asked for."""
    fixed = None if own_baselines else dict.fromkeys(pricing.BASELINE_KEYS, 1.0)
    return pricing.calculate_premium(
        _rated(spark, folder), "rated_frequency", "rate_severity", SAMPLE_PRICING, baselines=fixed
    )


# ---- features, cleaning, validation -------------------------------------------------------------
@query("policy_engineer_features")
def policy_engineer_features(spark, folder):
    raw = sample_book.raw_policies(spark, folder).select(*BASE_COLUMNS)
    return _round(features.engineer_features(raw), 6, "Density", "LogDensity")


sql("policy_engineer_features", f"""WITH {POLICIES_SRC},
d AS (SELECT quantile_cont(Density,0.5) AS v FROM policies_src),
g AS (SELECT VehGas AS v FROM policies_src WHERE VehGas IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
x AS (SELECT p.*, least(greatest(coalesce(p.Density,d.v),0),27000) AS dens, coalesce(p.VehGas,g.v) AS gas
  FROM policies_src p, d, g)
SELECT IDpol, ClaimNb, Exposure, VehPower, VehAge, DrivAge, BonusMalus, VehBrand, gas AS VehGas, Area,
  round(dens,6) AS Density, Region, round(ln(1+dens),6) AS LogDensity FROM x""")


@query("policy_alias_input")
def policy_alias_input(spark, folder):
    """The same factors under their alternative input names, as text."""
    raw = sample_book.raw_policies(spark, folder)
    renamed = raw.select(
        F.col("IDpol").cast("string").alias("policy_id"), F.col("Exposure").cast("string").alias("exposure"),
        F.col("VehPower").cast("string").alias("vehicle_power"), F.col("VehAge").cast("string").alias("vehicle_age"),
        F.col("DrivAge").cast("string").alias("driver_age"), F.col("BonusMalus").cast("string").alias("bonus_malus"),
        F.concat(F.lit(" "), "VehBrand", F.lit("\t")).alias("vehicle_brand"), F.col("VehGas").alias("fuel_type"),
        F.col("Area").alias("area"), F.coalesce(F.col("Density").cast("string"), F.lit("n.a.")).alias("population_density"),
        F.col("Region").alias("region"), F.when(F.col("IDpol") % 2 == 0, F.lit("12")).alias("annual_mileage"),
    )
    prepared = features.build_inference_frame(renamed, _metadata(), check_rows=False, check_values=False, missing_ids="keep")
    return _round(
        prepared.select("IDpol", *RATING_COLUMNS, "LogDensity", "simulated_daily_mileage", "has_simulated_behavioral_inputs"),
        6, "Density", "LogDensity",
    )


sql("policy_alias_input", f"""WITH {POL}
SELECT IDpol, Exposure, VehPower, VehAge, DrivAge, BonusMalus, VehBrand, VehGas, Area, round(Density,6) AS Density, Region,
  round(ln(1+Density),6) AS LogDensity, CASE WHEN IDpol%2=0 THEN 12.0::DOUBLE END AS simulated_daily_mileage,
  CAST(IDpol%2=0 AS INT) AS has_simulated_behavioral_inputs FROM pol""")


@query("policy_clean_frequency")
def policy_clean_frequency(spark, folder):
    raw = sample_book.raw_policies(spark, folder).select(*BASE_COLUMNS)
    return _round(datasets.clean_frequency_data(raw), 6, "Density", "LogDensity", "observed_claim_frequency")


sql("policy_clean_frequency", f"""WITH {POLICIES_SRC},
d AS (SELECT quantile_cont(Density,0.5) AS v FROM policies_src),
x AS (SELECT p.*, least(greatest(coalesce(p.Density,d.v),0),27000) AS dens FROM policies_src p, d)
SELECT IDpol, CAST(ClaimNb AS INT) AS ClaimNb, Exposure, VehPower, VehAge, DrivAge, BonusMalus, VehBrand,
  coalesce(VehGas,'Unknown') AS VehGas, Area, round(dens,6) AS Density, Region, round(ln(1+dens),6) AS LogDensity,
  CAST(ClaimNb>0 AS INT) AS has_claim, round(ClaimNb/Exposure,6) AS observed_claim_frequency FROM x""")


@query("policy_dense_ids")
def policy_dense_ids(spark, folder):
    """Surrogate ids 1..n: every number is given once; rows that arrive in order are numbered in order."""
    raw = sample_book.raw_policies(spark, folder).withColumnRenamed("IDpol", "order_key").repartitionByRange("order_key").sortWithinPartitions("order_key")
    return features.fill_policy_ids(raw, "position").select("order_key", "IDpol")


sql("policy_dense_ids", """SELECT o_orderkey AS order_key, row_number() OVER (ORDER BY o_orderkey) AS IDpol FROM orders
JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey""")


@query("claims_clean_severity")
def claims_clean_severity(spark, folder):
    return _round(_claims(spark, folder).select("IDpol", "claim_seq", "ClaimAmount"), 4, "ClaimAmount")


sql("claims_clean_severity", f"""WITH {POL} SELECT IDpol, claim_seq, round(ClaimAmount,4) AS ClaimAmount FROM sev""")


@query("claims_total_by_policy")
def claims_total_by_policy(spark, folder):
    return _round(datasets.claim_totals(_claims(spark, folder)), 4, "TotalClaimAmount")


sql("claims_total_by_policy", f"""WITH {POL} SELECT IDpol, round(TotalClaimAmount,4) AS TotalClaimAmount FROM tot""")


@query("policy_claim_join")
def policy_claim_join(spark, folder):
    joined = datasets.attach_claim_totals(_policies(spark, folder), _claims(spark, folder))
    return _round(joined.select("IDpol", "ClaimNb", "TotalClaimAmount", "AverageClaimAmount"), 4, "TotalClaimAmount").withColumn(
        "AverageClaimAmount", F.round("AverageClaimAmount", 6)
    )


sql("policy_claim_join", f"""WITH {POL} SELECT IDpol, ClaimNb, round(coalesce(TotalClaimAmount,0),4) AS TotalClaimAmount,
round(CASE WHEN ClaimNb>0 THEN coalesce(TotalClaimAmount,0)/ClaimNb ELSE 0 END,6) AS AverageClaimAmount
FROM pol LEFT JOIN tot USING (IDpol)""")


@query("claim_feature_join")
def claim_feature_join(spark, folder):
    joined = datasets.claims_with_factors(_claims(spark, folder), _policies(spark, folder), hot=None)
    return _round(joined, 4, "ClaimAmount", "Density", "LogDensity")


sql("claim_feature_join", f"""WITH {POL} SELECT IDpol, round(ClaimAmount,4) AS ClaimAmount, claim_seq, Exposure, VehPower, VehAge,
DrivAge, BonusMalus, VehBrand, VehGas, Area, round(Density,4) AS Density, Region, round(ln(1+Density),4) AS LogDensity
FROM sev JOIN pol USING (IDpol)""")


@query("orphan_claims")
def orphan_claims(spark, folder):
    """Claims whose policy is not in force (urgent orders are left out of the book)."""
    kept = sample_book.table(spark, folder, "orders").where(F.col("o_orderpriority") != "1-URGENT")
    policies = kept.select(F.col("o_orderkey").alias("IDpol"))
    return _round(datasets.orphan_claims(_claims(spark, folder), policies), 4, "ClaimAmount")


sql("orphan_claims", f"""WITH {POL} SELECT IDpol, round(ClaimAmount,4) AS ClaimAmount, claim_seq FROM sev
WHERE IDpol NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')""")


@query("data_quality_summary")
def data_quality_summary(spark, folder):
    return datasets.data_quality(_policies(spark, folder), _claims(spark, folder))


sql("data_quality_summary", f"""WITH {POL}, j AS (SELECT pol.*, coalesce(TotalClaimAmount,0) AS t FROM pol LEFT JOIN tot USING (IDpol))
SELECT count(*) AS frequency_rows, (SELECT count(*) FROM sev) AS severity_rows,
  count(*) FILTER (ClaimNb>0) AS policies_with_claims, count(*) FILTER (t>0) AS policies_with_paid_amounts,
  count(*) FILTER (ClaimNb>0 AND t<=0) AS positive_claim_count_without_paid_amount,
  (SELECT count(*) FROM sev WHERE IDpol NOT IN (SELECT IDpol FROM pol)) AS severity_rows_without_matching_policy,
  (SELECT count(*) FROM sev JOIN pol USING (IDpol)) AS claim_rows_used_for_severity_model FROM j""")


@query("row_contract_violations")
def row_contract_violations(spark, folder):
    checked = validate.with_violations(sample_book.raw_policies(spark, folder))
    broken = checked.where(F.size("violations") > 0)
    return broken.select("IDpol", F.array_join("violations", ",").alias("violations"))


sql("row_contract_violations", f"""WITH {POLICIES_SRC}, v AS (SELECT IDpol, concat_ws(',',
  CASE WHEN NOT coalesce(Exposure>0 AND Exposure<=2.5,false) THEN 'Exposure_out_of_range' END,
  CASE WHEN NOT coalesce(VehPower>0 AND VehPower<=20,false) THEN 'VehPower_out_of_range' END,
  CASE WHEN NOT coalesce(VehAge BETWEEN 0 AND 100,false) THEN 'VehAge_out_of_range' END,
  CASE WHEN NOT coalesce(DrivAge BETWEEN 18 AND 100,false) THEN 'DrivAge_out_of_range' END,
  CASE WHEN NOT coalesce(BonusMalus BETWEEN 50 AND 350,false) THEN 'BonusMalus_out_of_range' END,
  CASE WHEN NOT coalesce(Density BETWEEN 0 AND 27000,false) THEN 'Density_out_of_range' END,
  CASE WHEN NOT coalesce(length(VehBrand)>0,false) THEN 'VehBrand_empty' END,
  CASE WHEN NOT coalesce(length(VehGas)>0,false) THEN 'VehGas_empty' END,
  CASE WHEN NOT coalesce(length(Area)>0,false) THEN 'Area_empty' END,
  CASE WHEN NOT coalesce(length(Region)>0,false) THEN 'Region_empty' END) AS violations FROM policies_src)
SELECT IDpol, violations FROM v WHERE violations <> ''""")


@query("missing_value_profile")
def missing_value_profile(spark, folder):
    raw = sample_book.raw_policies(spark, folder)
    return validate.value_profile(raw, BASE_COLUMNS, []).select("column_name", "rows", "missing")


sql("missing_value_profile", f"WITH {POLICIES_SRC} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*)-count({c}) AS missing FROM policies_src" for c in BASE_COLUMNS
))

COERCED = ["user_id", "event_type", "props", "value"]


@query("numeric_coercion_profile")
def numeric_coercion_profile(spark, folder):
    """How many values of text columns are numbers."""
    events = sample_book.table(spark, folder, "events")
    as_text = events.select(*[F.col(c).cast("string").alias(c) for c in COERCED])
    return validate.value_profile(as_text, COERCED, COERCED).select("column_name", "non_null", "numeric_ok")


sql("numeric_coercion_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS numeric_ok FROM events"
    for c in COERCED
))


@query("batch_requests")
def batch_requests(spark, folder):
    """JSON scoring requests, one per customer, exploded to policies."""
    raw = sample_book.raw_policies(spark, folder).select("IDpol", *RATING_COLUMNS)
    requests = raw.select(F.to_json(F.struct(
        F.array(F.struct("IDpol", *RATING_COLUMNS)).alias("policies"), (F.col("IDpol") % 3 == 0).alias("consent")
    )).alias("body"))
    parsed = requests.select(F.from_json("body", BATCH_REQUEST).alias("r")).select("r.*")
    return _round(readers.explode_requests(parsed), 4, "Density")


sql("batch_requests", f"""WITH {POLICIES_SRC} SELECT IDpol, Exposure, VehPower, VehAge, DrivAge, BonusMalus, VehBrand, VehGas,
Area, round(Density,4) AS Density, Region, IDpol%3=0 AS consent FROM policies_src""")


@query("table_fingerprint_stable")
def table_fingerprint_stable(spark, folder):
    """The content hash does not depend on row order or partitioning."""
    claims = sample_book.raw_claims(spark, folder)
    one = readers.table_fingerprint(claims).select("rows", F.col("fingerprint").alias("f1"))
    two = readers.table_fingerprint(claims.repartition("claim_seq")).select(F.col("fingerprint").alias("f2"))
    return one.crossJoin(two).select("rows", (F.col("f1") == F.col("f2")).alias("same"))


sql("table_fingerprint_stable", f"WITH {CLAIMS_SRC} SELECT count(*) AS rows, true AS same FROM claims_src")


# ---- statistics -----------------------------------------------------------------------------------
@query("defaults_metadata")
def defaults_metadata(spark, folder):
    raw = sample_book.raw_policies(spark, folder)
    medians = stats.numeric_medians(raw).select("feature", F.format_string("%.4f", F.round("value", 6)).alias("default_value"))
    return medians.unionByName(stats.categorical_modes(raw).withColumnRenamed("value", "default_value"))


sql("defaults_metadata", f"WITH {POLICIES_SRC} " + " UNION ALL ".join(
    [f"SELECT '{c}' AS feature, printf('%.4f', round(quantile_cont({c},0.5),6)) AS default_value FROM policies_src"
     for c in ("Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus", "Density")]
    + [f"SELECT '{c}' AS feature, (SELECT {c} FROM policies_src WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
       for c in ("VehBrand", "VehGas", "Area", "Region")]
))


@query("numeric_ranges")
def numeric_ranges(spark, folder):
    return _round(stats.numeric_ranges(_policies(spark, folder)), 4, "min_value", "max_value")


sql("numeric_ranges", f"WITH {POL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(min({c}),4) AS min_value, round(max({c}),4) AS max_value FROM pol"
    for c in ("Exposure", "VehPower", "VehAge", "DrivAge", "BonusMalus", "Density")
))


@query("categorical_options")
def categorical_options(spark, folder):
    return stats.categorical_options(_policies(spark, folder))


sql("categorical_options", f"WITH {POL} " + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS feature, {c} AS option FROM pol" for c in ("VehBrand", "VehGas", "Area", "Region")
))


@query("claim_quantiles")
def claim_quantiles(spark, folder):
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    return _round(ranking.exact_quantiles(_claims(spark, folder), ["ClaimAmount"], shares), 4, *shares)


sql("claim_quantiles", f"""WITH {POL} SELECT 'ClaimAmount' AS feature, count(*) AS rows, round(quantile_cont(ClaimAmount,0.1),4) AS p10,
round(quantile_cont(ClaimAmount,0.5),4) AS p50, round(quantile_cont(ClaimAmount,0.9),4) AS p90,
round(quantile_cont(ClaimAmount,0.99),4) AS p99 FROM sev""")


@query("global_premium_rank")
def global_premium_rank(spark, folder):
    raw = sample_book.raw_policies(spark, folder).select("IDpol", "premium_paid")
    return _round(ranking.global_rank(raw, ["-premium_paid", "IDpol"], "premium_rank"), 6, "premium_paid")


sql("global_premium_rank", f"""WITH {POLICIES_SRC} SELECT IDpol, round(premium_paid,6) AS premium_paid,
row_number() OVER (ORDER BY premium_paid DESC, IDpol) AS premium_rank FROM policies_src""")


# ---- pricing ----------------------------------------------------------------------------------------
RESULT_ROUNDING = [
    "predicted_annual_frequency", "predicted_claim_count", "predicted_claim_severity", "annualized_expected_loss",
    "expected_loss", "pure_premium", "technical_premium", "loaded_premium", "final_premium",
    "frequency_relativity", "severity_relativity", "risk_score",
]


@query("premium_scoring")
def premium_scoring(spark, folder):
    scored = _scored(spark, folder, own_baselines=True)
    return _round(scored.select("IDpol", *RESULT_ROUNDING, "risk_category"), 4, *RESULT_ROUNDING)


sql("premium_scoring", f"""WITH {SCORED} SELECT IDpol, round(f,4) AS predicted_annual_frequency, round(cnt,4) AS predicted_claim_count,
round(s,4) AS predicted_claim_severity, round(ann,4) AS annualized_expected_loss, round(pure,4) AS expected_loss,
round(pure,4) AS pure_premium, round(technical_premium,4) AS technical_premium, round(technical_premium,4) AS loaded_premium,
round(final_premium,4) AS final_premium, round(frequency_relativity,4) AS frequency_relativity,
round(severity_relativity,4) AS severity_relativity, round(risk_score,4) AS risk_score, risk_category FROM scored""")


@query("portfolio_baselines")
def portfolio_baselines(spark, folder):
    rated = _rated(spark, folder)
    severity = F.col("rate_severity") * F.lit(SAMPLE_PRICING.fx_rate)
    return _round(pricing.portfolio_baselines(rated, "rated_frequency", severity, SAMPLE_PRICING), 4, *pricing.BASELINE_KEYS)


sql("portfolio_baselines", f"""WITH {SCORED} SELECT round(bf,4) AS annual_frequency, round(bs,4) AS claim_severity,
round(bl,4) AS annualized_expected_loss FROM base""")


@query("premium_summary")
def premium_summary(spark, folder):
    return _round(pricing.premium_summary(_scored(spark, folder)), 4, "avg_premium", "min_premium", "max_premium")


sql("premium_summary", f"""WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (risk_category='Low') AS low_count,
count(*) FILTER (risk_category='Medium') AS medium_count, count(*) FILTER (risk_category='High') AS high_count,
round(avg(final_premium),4) AS avg_premium, round(min(final_premium),4) AS min_premium,
round(max(final_premium),4) AS max_premium FROM scored""")


@query("risk_band_counts")
def risk_band_counts(spark, folder):
    return pricing.risk_band_counts(_scored(spark, folder))


sql("risk_band_counts", f"""WITH {SCORED} SELECT b.o AS band_order, b.c AS risk_category, count(scored.IDpol) AS policies
FROM (VALUES (1,'Low'),(2,'Medium'),(3,'High')) b(o,c) LEFT JOIN scored ON risk_category=b.c GROUP BY 1,2""")


@query("top_premiums")
def top_premiums(spark, folder):
    rounded = [c for c in pricing.TOP_PREMIUM_COLUMNS if c not in ("IDpol", "risk_category", "Exposure")]
    return _round(pricing.top_premiums(_scored(spark, folder, own_baselines=True), 1000), 4, *rounded)


sql("top_premiums", f"""WITH {SCORED} SELECT IDpol, Exposure, round(f,4) AS predicted_annual_frequency,
round(cnt,4) AS predicted_claim_count, round(s,4) AS predicted_claim_severity, round(ann,4) AS annualized_expected_loss,
round(pure,4) AS expected_loss, round(pure,4) AS pure_premium, round(final_premium,4) AS final_premium,
round(risk_score,4) AS risk_score, risk_category FROM scored ORDER BY scored.final_premium DESC, IDpol LIMIT 1000""")


# ---- scenarios: fixed multiplicative factors stand in for a fitted model ------------------------------
def _tariff(df: DataFrame) -> DataFrame:
    frequency = (
        F.lit(0.05) + F.lit(0.004) * F.col("VehPower") + F.lit(0.001) * F.abs(F.col("DrivAge") - F.lit(45.0))
        + F.lit(0.0005) * F.col("BonusMalus")
    )
    severity = F.lit(800.0) + F.lit(25.0) * F.col("VehPower") + F.lit(0.5) * F.col("BonusMalus")
    fixed = dict.fromkeys(pricing.BASELINE_KEYS, 1.0)
    prepared = features.engineer_features(df, NUMERIC_DEFAULTS, CATEGORICAL_DEFAULTS, batch_defaults=False)
    return pricing.calculate_premium(prepared, frequency, severity, baselines=fixed)


SCENARIO_SQL = POLICIES_SRC + """,
spec AS (SELECT * FROM (VALUES ('baseline','none',1.0::DOUBLE,0.0::DOUBLE),
  ('vehicle_power_decrease','VehPower',0.8,0),('vehicle_power_increase','VehPower',1.2,0),
  ('driver_age_decrease','DrivAge',1,-10),('driver_age_increase','DrivAge',1,10),
  ('bonus_malus_decrease','BonusMalus',1,-20),('bonus_malus_increase','BonusMalus',1,20)) t(scenario_name,changed_feature,m,a)),
chg AS (SELECT p.IDpol, p.Exposure, p.VehPower AS vp, p.DrivAge AS da, p.BonusMalus AS bm, scenario_name, changed_feature,
  CASE changed_feature WHEN 'VehPower' THEN least(greatest(p.VehPower*m+a,1),20)
    WHEN 'DrivAge' THEN least(greatest(p.DrivAge*m+a,18),100)
    WHEN 'BonusMalus' THEN least(greatest(p.BonusMalus*m+a,50),350) END AS changed_value FROM policies_src p, spec),
eff AS (SELECT *, CASE WHEN changed_feature='VehPower' THEN changed_value ELSE vp END AS evp,
  CASE WHEN changed_feature='DrivAge' THEN changed_value ELSE da END AS eda,
  CASE WHEN changed_feature='BonusMalus' THEN changed_value ELSE bm END AS ebm FROM chg),
fs AS (SELECT *, 0.05::DOUBLE+0.004::DOUBLE*evp+0.001::DOUBLE*abs(eda-45)+0.0005::DOUBLE*ebm AS f,
  800::DOUBLE+25::DOUBLE*evp+0.5::DOUBLE*ebm AS s FROM eff),
pr AS (SELECT *, greatest(f*Exposure*s*1.3::DOUBLE+30,100) AS final_premium FROM fs),
bp AS (SELECT *, greatest((0.05::DOUBLE+0.004::DOUBLE*vp+0.001::DOUBLE*abs(da-45)+0.0005::DOUBLE*bm)*Exposure
  *(800::DOUBLE+25::DOUBLE*vp+0.5::DOUBLE*bm)*1.3::DOUBLE+30,100) AS base_premium FROM pr),
rep AS (SELECT *, final_premium-base_premium AS premium_delta,
  (final_premium-base_premium)/greatest(base_premium,1e-9)*100 AS premium_delta_pct FROM bp)"""


@query("scenario_report")
def scenario_report(spark, folder):
    raw = sample_book.raw_policies(spark, folder)
    report = scenarios.simulate_scenarios(raw, _tariff)
    return _round(report, 8, "changed_value", "predicted_frequency", "predicted_severity", "final_premium",
                  "premium_delta", "premium_delta_pct")


sql("scenario_report", f"""WITH {SCENARIO_SQL} SELECT IDpol AS policy_id, scenario_name, changed_feature,
round(changed_value,8) AS changed_value, round(f,8) AS predicted_frequency, round(s,8) AS predicted_severity,
round(final_premium,8) AS final_premium, round(premium_delta,8) AS premium_delta,
round(premium_delta_pct,8) AS premium_delta_pct FROM rep""")


@query("scenario_sensitivity")
def scenario_sensitivity(spark, folder):
    raw = sample_book.raw_policies(spark, folder)
    return _round(scenarios.sensitivity(scenarios.simulate_scenarios(raw, _tariff)), 4, "avg_premium", "avg_delta", "avg_delta_pct")


sql("scenario_sensitivity", f"""WITH {SCENARIO_SQL} SELECT scenario_name, changed_feature, count(*) AS policies,
round(avg(final_premium),4) AS avg_premium, round(avg(premium_delta),4) AS avg_delta,
round(avg(premium_delta_pct),4) AS avg_delta_pct FROM rep GROUP BY 1,2""")


@query("scenario_curves")
def scenario_curves(spark, folder):
    raw = sample_book.raw_policies(spark, folder)
    return _round(scenarios.premium_curves(scenarios.scored_scenarios(raw, _tariff)), 8, "feature_value", "final_premium")


sql("scenario_curves", f"""WITH {SCENARIO_SQL}
SELECT IDpol AS policy_id, 'VehPower' AS feature, round(evp,8) AS feature_value, round(final_premium,8) AS final_premium
FROM rep WHERE changed_feature IN ('none','VehPower') UNION ALL
SELECT IDpol, 'DrivAge', round(eda,8), round(final_premium,8) FROM rep WHERE changed_feature IN ('none','DrivAge') UNION ALL
SELECT IDpol, 'BonusMalus', round(ebm,8), round(final_premium,8) FROM rep WHERE changed_feature IN ('none','BonusMalus')""")


# ---- diagnostics ----------------------------------------------------------------------------------------
@query("frequency_calibration_deciles")
def frequency_calibration_deciles(spark, folder):
    table = diagnostics.calibration(_scored(spark, folder), "ClaimNb", "predicted_claim_count", "IDpol")
    return _round(table, 6, "actual_mean", "predicted_mean")


# The rank is taken over integers (claims per area x exposure in hundredths give the same order as
# the product only up to rounding), so both engines sort by the same product of doubles.
sql("frequency_calibration_deciles", f"""WITH {SCORED},
r AS (SELECT *, row_number() OVER (ORDER BY cnt, IDpol) AS rk, count(*) OVER () AS n FROM scored),
b AS (SELECT *, CAST(greatest(ceil((rk-1)*least(10,n)/CAST(n-1 AS DOUBLE)),1)-1 AS INT) AS bucket FROM r)
SELECT bucket, count(*) AS rows, round(avg(ClaimNb),6) AS actual_mean, round(avg(cnt),6) AS predicted_mean FROM b GROUP BY 1""")


def _histogram_sql(value: str, source: str, back: str = "{}", bins: int = 40) -> str:
    low, high = back.format("lo+i*(hi-lo)/%d" % bins), back.format("lo+(i+1)*(hi-lo)/%d" % bins)
    return f"""v AS (SELECT {value} AS v FROM {source}), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
h AS (SELECT CAST(least(floor((v-lo)/((hi-lo)/{bins})),{bins - 1}) AS INT) AS bin, count(*) AS c FROM v, e GROUP BY 1),
bins AS (SELECT CAST(i AS INT) AS bin, round({low},4) AS bin_low, round({high},4) AS bin_high FROM e, range({bins}) t(i)),
hist AS (SELECT bins.*, coalesce(c,0) AS rows FROM bins LEFT JOIN h USING (bin))"""


@query("premium_histogram")
def premium_histogram(spark, folder):
    return _round(diagnostics.premium_histogram(_scored(spark, folder)), 4, "bin_low", "bin_high")


sql("premium_histogram", f"WITH {SCORED}, {_histogram_sql('final_premium', 'scored')} SELECT * FROM hist")


@query("premium_histogram_log")
def premium_histogram_log(spark, folder):
    return _round(diagnostics.premium_histogram(_scored(spark, folder), log10=True), 4, "bin_low", "bin_high")


sql("premium_histogram_log",
    f"WITH {SCORED}, {_histogram_sql('log10(final_premium)', 'scored', 'power(10,{})')} SELECT * FROM hist")


def _claim_predictions(spark: SparkSession, folder: str) -> DataFrame:
    policies, claims = _policies(spark, folder), _claims(spark, folder)
    by_claim = datasets.claims_with_factors(claims, policies)
    rates = by_claim.groupBy("Area").agg(F.avg("ClaimAmount").alias("predicted_claim_severity"))
    return pricing.with_segment_rates(by_claim, rates)


CLAIM_PREDICTIONS = POL + """,
cp0 AS (SELECT s.IDpol, s.ClaimAmount, s.claim_seq, p.Area FROM sev s JOIN pol p USING (IDpol)),
cp AS (SELECT cp0.*, r.m AS predicted_claim_severity, ClaimAmount-r.m AS error FROM cp0
  JOIN (SELECT Area, avg(ClaimAmount) AS m FROM cp0 GROUP BY 1) r USING (Area))"""


@query("residual_histogram")
def residual_histogram(spark, folder):
    pairs = validate.prediction_pairs(_claim_predictions(spark, folder), check=False)
    return _round(diagnostics.residual_histogram(pairs), 4, "bin_low", "bin_high", "mean_error")


sql("residual_histogram", f"""WITH {CLAIM_PREDICTIONS}, {_histogram_sql('error', 'cp')}
SELECT hist.*, (SELECT round(avg(error),4)+0.0 FROM cp) AS mean_error FROM hist""")


@query("axis_extent")
def axis_extent(spark, folder):
    pairs = validate.prediction_pairs(_claim_predictions(spark, folder), check=False)
    return _round(diagnostics.axis_extent(pairs), 4, "axis_low", "axis_high")


sql("axis_extent", f"""WITH {CLAIM_PREDICTIONS}, e AS (SELECT least(min(ClaimAmount),min(predicted_claim_severity)) AS lo,
greatest(max(ClaimAmount),max(predicted_claim_severity)) AS hi FROM cp)
SELECT round(lo-greatest((hi-lo)*0.05,1),4) AS axis_low, round(hi+greatest((hi-lo)*0.05,1),4) AS axis_high FROM e""")


@query("diagnostic_sample")
def diagnostic_sample(spark, folder):
    key = F.concat_ws("-", F.col("IDpol").cast("string"), F.col("claim_seq").cast("string"))
    sample = diagnostics.diagnostic_pairs(_claim_predictions(spark, folder), key, sample_size=5000)
    return _round(sample, 4, "actual", "predicted", "error")


sql("diagnostic_sample", f"""WITH {CLAIM_PREDICTIONS} SELECT round(ClaimAmount,4) AS actual,
round(predicted_claim_severity,4) AS predicted, round(error,4) AS error FROM cp
ORDER BY md5(concat(IDpol,'-',claim_seq,':42')) LIMIT 5000""")


def comparison_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Run results as JSON documents (``payload``), one per order priority and status."""
    orders = sample_book.table(spark, folder, "orders")
    runs = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.stddev_pop("o_totalprice").alias("spread"))
    status = F.when(F.col("o_orderstatus") == "P", "skipped").otherwise("success")
    rmse = F.struct(F.struct("spread").alias("metrics"))
    body = F.to_json(F.map_from_arrays(
        F.array(F.concat_ws("_", "o_orderpriority", "o_orderstatus")),
        F.array(F.struct(
            status.alias("status"), F.col("o_orderpriority").alias("frequency_model"), F.lit("gamma").alias("severity_model"),
            F.struct(
                F.struct(F.struct(F.round("spread", 3).alias("rmse")).alias("metrics")).alias("frequency"),
                F.struct(F.struct(F.when(F.col("o_orderstatus") == "F", F.lit(2.5)).alias("rmse")).alias("metrics")).alias("severity"),
            ).alias("metrics"),
        )),
    ))
    return runs.select(body.alias("payload"))


@query("comparison_rmse_frame")
def comparison_rmse_frame(spark, folder):
    """Run results unpivoted to RMSE rows."""
    return diagnostics.comparison_rmse(comparison_payloads(spark, folder))


sql("comparison_rmse_frame", """WITH r AS (SELECT o_orderpriority AS p, o_orderstatus AS s, round(stddev_pop(o_totalprice),3) AS x
FROM orders GROUP BY 1,2)
SELECT p||'_'||s AS run_name, p||' + gamma' AS combo_label, 'Frequency' AS component, x AS rmse FROM r WHERE s<>'P'
UNION ALL SELECT p||'_'||s, p||' + gamma', 'Severity', 2.5::DOUBLE FROM r WHERE s='F'""")


@query("poisson_deviance")
def poisson_deviance(spark, folder):
    out = metrics.frequency_metrics_by_basis(_scored(spark, folder))
    return _round(out, 5, "rmse", "observed_mean", "predicted_mean", "poisson_deviance")


def _poisson_sql(basis: str, predicted: str) -> str:
    return f"""SELECT '{basis}' AS basis, count(*) AS sample_size, round(sqrt(avg((ClaimNb-{predicted})*(ClaimNb-{predicted}))),5) AS rmse,
round(avg(ClaimNb),5) AS observed_mean, round(avg({predicted}),5) AS predicted_mean,
round(avg(2*(CASE WHEN ClaimNb>0 THEN ClaimNb*ln(ClaimNb/{predicted}) ELSE 0 END-ClaimNb+{predicted})),5) AS poisson_deviance FROM scored"""


sql("poisson_deviance", f"""WITH {SCORED} {_poisson_sql('count', 'cnt')} UNION ALL {_poisson_sql('legacy', 'f')} UNION ALL
SELECT 'rate_weighted', count(*), round(sqrt(sum(Exposure*(ClaimNb/Exposure-f)*(ClaimNb/Exposure-f))/sum(Exposure)),5),
round(sum(ClaimNb)/sum(Exposure),5), round(sum(Exposure*f)/sum(Exposure),5),
round(sum(Exposure*2*(CASE WHEN ClaimNb>0 THEN ClaimNb/Exposure*ln(ClaimNb/Exposure/f) ELSE 0 END-ClaimNb/Exposure+f))/sum(Exposure),5)
FROM scored""")


@query("gamma_deviance_mae_rmse")
def gamma_deviance_mae_rmse(spark, folder):
    row = metrics.severity_metrics(_claim_predictions(spark, folder))
    return _round(row, 4, "rmse", "observed_mean", "predicted_mean", "mae", "gamma_deviance")


sql("gamma_deviance_mae_rmse", f"""WITH {CLAIM_PREDICTIONS}, g AS (SELECT ClaimAmount AS y, predicted_claim_severity AS p FROM cp)
SELECT count(*) AS sample_size, round(sqrt(avg((y-p)*(y-p))),4) AS rmse, round(avg(y),4) AS observed_mean,
round(avg(p),4) AS predicted_mean, round(avg(abs(y-p)),4) AS mae, round(avg(2*(ln(p/y)+y/p-1)),4) AS gamma_deviance FROM g""")


# ---- models -----------------------------------------------------------------------------------------------
@query("glm_frequency_onefactor")
def glm_frequency_onefactor(spark, folder):
    """An unpenalised one-factor Poisson model gives each area its observed rate."""
    policies = _policies(spark, folder).select("Area", "ClaimNb", "Exposure")
    model = models.train_frequency_model(policies, alpha=0.0, numeric=[], categorical=["Area"], drop_reference=True)
    scored = model.transform(policies).groupBy("Area").agg(F.avg("predicted_annual_frequency").alias("frequency"))
    return _round(scored, 4, "frequency")


sql("glm_frequency_onefactor", f"WITH {SCORED} SELECT Area, round(rate_frequency,4) AS frequency FROM rf")


@query("glm_severity_onefactor")
def glm_severity_onefactor(spark, folder):
    claims = datasets.claims_with_factors(_claims(spark, folder), _policies(spark, folder)).select("Area", "ClaimAmount")
    model = models.train_severity_model(claims, alpha=0.0, numeric=[], categorical=["Area"], drop_reference=True)
    scored = model.transform(claims).groupBy("Area").agg(F.avg("predicted_claim_severity").alias("severity"))
    return _round(scored, 3, "severity")


sql("glm_severity_onefactor", f"WITH {SCORED} SELECT Area, round(rate_severity,3) AS severity FROM rs")


def _area_boosting() -> ModelConfig:
    """Full steps on depth-1 trees over all rows and features."""
    full = {"trees": 120, "learning_rate": 1.0, "max_depth": 1, "subsample": 1.0, "colsample_bytree": 1.0, "reg_lambda": 0.0, "min_gain": 1e-13}
    base = ModelConfig()
    return replace(
        base, frequency=replace(base.frequency, boost=replace(base.frequency.boost, **full)),
        severity=replace(base.severity, boost=replace(base.severity.boost, **full)),
    )


@query("boosted_rates")
def boosted_rates(spark, folder):
    """Boosted depth-1 trees on one factor end at its observed frequencies and mean claims."""
    policies = _policies(spark, folder)
    claims = datasets.claims_with_factors(_claims(spark, folder), policies).select("Area", "ClaimAmount")
    config = _area_boosting()
    frequency = models.train_frequency_model(policies, "boosted", config=config, numeric=[], categorical=["Area"])
    severity = models.train_severity_model(claims, "boosted", config=config, numeric=[], categorical=["Area"])
    scored = severity.transform(frequency.transform(policies.select("Area").distinct()))
    return scored.select(
        "Area", F.round("predicted_annual_frequency", 4).alias("frequency"), F.round("predicted_claim_severity", 2).alias("severity")
    )


sql("boosted_rates", f"""WITH {SCORED} SELECT Area, round(rate_frequency,4) AS frequency, round(rate_severity,2) AS severity
FROM rf JOIN rs USING (Area)""")


def _fit_pair(spark: SparkSession, folder: str, frequency: str, severity: str, config: ModelConfig | None = None):
    policies, claims = _policies(spark, folder), _claims(spark, folder)
    by_claim = datasets.claims_with_factors(claims, policies)
    fitted = (
        models.train_frequency_model(policies, frequency, config=config),
        models.train_severity_model(by_claim, severity, config=config),
    )
    return policies, fitted


def _small_forest() -> ModelConfig:
    config = ExperimentConfig(forest_trees=20)
    base = experiments.comparison_model_config(ModelConfig(), config)
    return replace(
        base,
        frequency=replace(base.frequency, forest=replace(base.frequency.forest, max_depth=6)),
        severity=replace(base.severity, forest=replace(base.severity.forest, max_depth=6)),
    )


def _priced(policies: DataFrame, fitted) -> DataFrame:
    scored = fitted[1].transform(fitted[0].transform(policies))
    fixed = dict.fromkeys(pricing.BASELINE_KEYS, 1.0)
    return pricing.calculate_premium(scored, "predicted_annual_frequency", "predicted_claim_severity", baselines=fixed)


@query("glm_full_scoring")
def glm_full_scoring(spark, folder):
    policies, fitted = _fit_pair(spark, folder, "poisson", "gamma")
    return _priced(policies, fitted).select("IDpol", "predicted_annual_frequency", "predicted_claim_severity", "final_premium", "risk_category")


@query("glm_relativities")
def glm_relativities(spark, folder):
    policies = _policies(spark, folder)
    return models.glm_relativities(models.train_frequency_model(policies), spark)


@query("rf_scoring")
def rf_scoring(spark, folder):
    policies, fitted = _fit_pair(spark, folder, "random_forest", "random_forest", _small_forest())
    return _priced(policies, fitted).select("IDpol", "predicted_annual_frequency", "predicted_claim_severity", "final_premium", "risk_category")


@query("feature_importance")
def feature_importance(spark, folder):
    policies = _policies(spark, folder)
    return models.feature_importance(models.train_frequency_model(policies, "random_forest", config=_small_forest()), spark)


@query("model_grid")
def model_grid(spark, folder):
    """RMSE per successful pair; xgboost pairs are skipped where the package is absent."""
    policies = _policies(spark, folder).withColumn("has_claim", (F.col("ClaimNb") > 0).cast("int"))
    claims = datasets.claims_with_factors(_claims(spark, folder), policies)
    claim_key = F.concat_ws("-", F.col("IDpol").cast("string"), F.col("claim_seq").cast("string"))
    train_p, test_p = sampling.hash_split(policies, F.col("IDpol"))
    train_c, test_c = sampling.hash_split(claims, claim_key)
    results, _ = experiments.run_model_comparison(
        train_p, test_p, train_c, test_c, F.col("IDpol"), claim_key,
        ExperimentConfig(forest_trees=20), _small_forest(),
    )
    return diagnostics.comparison_rmse_of(spark, results)


# ---- sampling ------------------------------------------------------------------------------------------------
@query("stratified_split")
def stratified_split(spark, folder):
    policies = _policies(spark, folder).select("IDpol", (F.col("ClaimNb") > 0).cast("int").alias("has_claim"))
    return sampling.stratified_split_labels(policies, F.col("IDpol"), "has_claim")


sql("stratified_split", f"""WITH {POL}, k AS (SELECT IDpol, CAST(ClaimNb>0 AS INT) AS has_claim FROM pol),
r AS (SELECT *, row_number() OVER (PARTITION BY has_claim ORDER BY md5(concat(IDpol,':42'))) AS rk,
  count(*) OVER (PARTITION BY has_claim) AS n FROM k)
SELECT IDpol, has_claim, rk <= ceil(round(n*0.2,9)) AS is_test FROM r""")


@query("experiment_sample")
def experiment_sample(spark, folder):
    policies = _policies(spark, folder).select("IDpol", "Area")
    return sampling.experiment_sample(policies, F.col("IDpol"), 0.2, 30_000)


sql("experiment_sample", f"""WITH {POL}, n AS (SELECT least(greatest(1,CAST(floor(count(*)*0.2) AS INT)),30000) AS k FROM pol),
r AS (SELECT IDpol, Area, row_number() OVER (ORDER BY md5(concat(IDpol,':42'))) AS rk FROM pol)
SELECT IDpol, Area FROM r, n WHERE rk <= k""")


@query("plain_claim_split")
def plain_claim_split(spark, folder):
    """Hash split of the claims: the side of every claim."""
    claims = _claims(spark, folder)
    key = F.concat_ws("-", F.col("IDpol").cast("string"), F.col("claim_seq").cast("string"))
    train, test = sampling.hash_split(claims, key)
    sides = [df.select(F.lit(side).alias("side"), "IDpol", "claim_seq") for side, df in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1])


sql("plain_claim_split", f"""WITH {POL}, h AS (SELECT
('0x'||substr(md5(concat(IDpol,'-',claim_seq,':42')),1,12))::BIGINT/281474976710656.0::DOUBLE < 0.2 AS t, IDpol, claim_seq FROM sev)
SELECT CASE WHEN t THEN 'test' ELSE 'train' END AS side, IDpol, claim_seq FROM h""")


# ---- foreign portfolios -----------------------------------------------------------------------------------------
@query("dutch_portfolio")
def dutch_portfolio(spark, folder):
    out = portfolios.dutch_portfolio(sample_book.raw_dutch(spark, folder))
    return _round(out, 6, "Exposure", "VehPower", "BonusMalus", "claim_amount").withColumn("DrivAge", F.col("DrivAge").cast("double"))


DUTCH = CLAIMS_SRC + """,
raw AS (SELECT CAST(18+o_custkey%70 AS DOUBLE) AS age, coalesce(n,0) AS nclaims, CAST(o_orderkey%100 AS DOUBLE)/100 AS exposure,
  coalesce(total,0) AS amount, CAST(20+o_custkey%130 AS DOUBLE) AS power, CAST(1+o_orderkey%23 AS DOUBLE) AS bm, o_custkey%5 AS zip
  FROM orders LEFT JOIN cl ON cl.IDpol=o_orderkey),
kept AS (SELECT * FROM raw WHERE exposure>0),
ext AS (SELECT min(power) AS pl, max(power) AS ph, min(bm) AS bl, max(bm) AS bh FROM kept),
dutch AS (SELECT exposure AS Exposure, 4+(power-pl)*16/(ph-pl) AS VehPower, 6.0::DOUBLE AS VehAge, age AS DrivAge,
  50+(bm-bl)*180/(bh-bl) AS BonusMalus, 'B12' AS VehBrand, 'Regular' AS VehGas,
  CASE zip WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' END AS Area, 393.0::DOUBLE AS Density, 'Centre' AS Region,
  nclaims>0 AS claim_occurred, amount/greatest(nclaims,1) AS claim_amount, 0.0::DOUBLE AS premium_paid FROM kept, ext)"""
sql("dutch_portfolio", f"""WITH {DUTCH} SELECT round(Exposure,6) AS Exposure, round(VehPower,6) AS VehPower, VehAge, DrivAge,
round(BonusMalus,6) AS BonusMalus, VehBrand, VehGas, Area, Density, Region, claim_occurred, round(claim_amount,6) AS claim_amount,
premium_paid FROM dutch""")

SUMMARY_ROUNDING = [
    "avg_severity", "avg_premium_paid", "min_VehPower", "max_VehPower", "min_DrivAge", "max_DrivAge",
    "min_BonusMalus", "max_BonusMalus",
]


@query("dutch_portfolio_summary")
def dutch_portfolio_summary(spark, folder):
    out = portfolios.portfolio_summary(portfolios.dutch_portfolio(sample_book.raw_dutch(spark, folder)))
    return _round(out, 4, *SUMMARY_ROUNDING)


def _summary_sql(source: str) -> str:
    ranges = ", ".join(
        f"round({f}({c}),4) AS {f}_{c}" for c in ("VehPower", "DrivAge", "BonusMalus") for f in ("min", "max")
    )
    return f"""SELECT count(*) AS policies, count(*) FILTER (claim_occurred) AS policies_with_claims,
count(*) FILTER (claim_amount>0) AS severity_rows, round(avg(claim_amount) FILTER (claim_amount>0),4) AS avg_severity,
round(avg(premium_paid),4) AS avg_premium_paid, {ranges} FROM {source}"""


sql("dutch_portfolio_summary", f"WITH {DUTCH} {_summary_sql('dutch')}")


@query("spanish_portfolio")
def spanish_portfolio(spark, folder):
    out = portfolios.spanish_portfolio(sample_book.raw_spanish(spark, folder))
    return _round(out, 6, "VehPower", "claim_amount", "premium_paid")


SPANISH = CLAIMS_SRC + """,
raw AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey%53<>0 THEN o_totalprice/1000.0::DOUBLE END AS premium,
  CAST(o_custkey%97 AS DOUBLE) AS power, 1995+o_orderkey%26 AS ymat, year(o_orderdate) AS cy,
  CASE WHEN o_orderkey%41<>0 THEN 1930+o_custkey%70 END AS birth, CASE WHEN o_orderkey%7<>0 THEN o_custkey%25 END AS hist,
  CASE o_orderkey%3 WHEN 0 THEN 'Regular' WHEN 1 THEN 'Diesel' ELSE 'Regular' END AS fuel,
  CASE WHEN o_orderkey%11<>0 AND o_custkey%3=1 THEN 'B' ELSE 'A' END AS area, coalesce(n,0) AS nc,
  coalesce(CASE WHEN o_orderkey%13=0 THEN 75.5 ELSE total END,0) AS cost
  FROM orders LEFT JOIN cl ON cl.IDpol=o_orderkey),
kept AS (SELECT * FROM raw WHERE premium IS NOT NULL),
med AS (SELECT quantile_cont(power,0.5) AS m FROM kept WHERE power>0),
pw AS (SELECT kept.*, CASE WHEN power=0 THEN m ELSE power END AS p FROM kept, med),
ext AS (SELECT min(p) AS pl, max(p) AS ph FROM pw),
spanish AS (SELECT id AS IDpol, 1.0::DOUBLE AS Exposure, 4+(p-pl)*16/(ph-pl) AS VehPower, greatest(2018-ymat,0)::DOUBLE AS VehAge,
  least(greatest(coalesce(cy-birth,40),18),100)::DOUBLE AS DrivAge, least(greatest(50+9*coalesce(hist,0),50),230)::DOUBLE AS BonusMalus,
  'B12' AS VehBrand, fuel AS VehGas, area AS Area, 393.0::DOUBLE AS Density, 'Centre' AS Region, nc>0 AS claim_occurred,
  cost/greatest(nc,1) AS claim_amount, premium AS premium_paid FROM pw, ext)"""
sql("spanish_portfolio", f"""WITH {SPANISH} SELECT IDpol, Exposure, round(VehPower,6) AS VehPower, VehAge, DrivAge, BonusMalus,
VehBrand, VehGas, Area, Density, Region, claim_occurred, round(claim_amount,6) AS claim_amount, round(premium_paid,6) AS premium_paid
FROM spanish""")


@query("spanish_portfolio_summary")
def spanish_portfolio_summary(spark, folder):
    out = portfolios.portfolio_summary(portfolios.spanish_portfolio(sample_book.raw_spanish(spark, folder)))
    return _round(out, 4, *SUMMARY_ROUNDING)


sql("spanish_portfolio_summary", f"WITH {SPANISH} {_summary_sql('spanish')}")


@query("spanish_fuel_distribution")
def spanish_fuel_distribution(spark, folder):
    return portfolios.category_distribution(portfolios.spanish_portfolio(sample_book.raw_spanish(spark, folder)), "VehGas")


sql("spanish_fuel_distribution", f"WITH {SPANISH} SELECT VehGas AS value, count(*) AS policies FROM spanish GROUP BY 1")


# ---- retraining and drift ----------------------------------------------------------------------------------------
RECORDS = POLICIES_SRC + """,
rec AS (SELECT CASE WHEN p.IDpol%2=0 THEN CAST(p.IDpol AS VARCHAR) ELSE 'q-'||p.IDpol END AS id,
  CASE WHEN p.IDpol%10<>0 THEN Exposure END AS exposure, VehPower, CASE WHEN VehAge>3 THEN VehAge ELSE 0 END AS vehage,
  CASE WHEN p.IDpol%9<>0 THEN DrivAge END AS drivage, BonusMalus, VehBrand, VehGas, Area, Density, Region,
  CASE WHEN p.IDpol%4<>0 THEN ClaimNb>0 END AS claim_occurred, mean_amount AS claim_amount,
  CASE WHEN p.IDpol%5<>0 THEN premium_paid END AS premium_paid
  FROM policies_src p LEFT JOIN cl ON cl.IDpol=p.IDpol),
recpol AS (SELECT CASE WHEN id LIKE 'q-%' THEN -(('0x'||substr(md5(id),1,15))::BIGINT+1) ELSE TRY_CAST(id AS BIGINT) END AS IDpol,
  CAST(coalesce(claim_occurred,false) OR coalesce(claim_amount,0)>0 AS INT) AS ClaimNb, coalesce(nullif(exposure,0),1) AS Exposure,
  coalesce(VehPower,6) AS VehPower, coalesce(vehage,6) AS VehAge, coalesce(drivage,40) AS DrivAge, coalesce(BonusMalus,60) AS BonusMalus,
  VehBrand, coalesce(VehGas,'Regular') AS VehGas, Area, coalesce(Density,500) AS Density, Region,
  coalesce(premium_paid,0) AS premium_paid, claim_amount FROM rec)"""


@query("retrain_policy_frame")
def retrain_policy_frame(spark, folder):
    records = sample_book.outcome_records(spark, folder)
    return _round(retraining.policy_records(records), 6, "Density", "premium_paid")


sql("retrain_policy_frame", f"""WITH {RECORDS} SELECT IDpol, ClaimNb, Exposure, VehPower, VehAge, DrivAge, BonusMalus, VehBrand,
VehGas, Area, round(Density,6) AS Density, Region, round(premium_paid,6) AS premium_paid FROM recpol""")


@query("retrain_policy_frame_legacy")
def retrain_policy_frame_legacy(spark, folder):
    """Zeros read as missing, as the original record reader does."""
    records = sample_book.outcome_records(spark, folder)
    frame = retraining.policy_records(records, legacy_zero_as_missing=True)
    return frame.groupBy("VehAge").agg(F.count(F.lit(1)).alias("policies"))


sql("retrain_policy_frame_legacy", f"""WITH {RECORDS} SELECT coalesce(nullif(VehAge,0),6) AS VehAge, count(*) AS policies
FROM recpol GROUP BY 1""")


@query("retrain_claim_frame")
def retrain_claim_frame(spark, folder):
    claims = retraining.claim_records(sample_book.outcome_records(spark, folder))
    return claims.select("IDpol", F.round("ClaimAmount", 6).alias("ClaimAmount"), "Exposure", "VehAge", "DrivAge")


sql("retrain_claim_frame", f"""WITH {RECORDS} SELECT IDpol, round(claim_amount,6) AS ClaimAmount, Exposure, VehAge, DrivAge FROM recpol
WHERE coalesce(claim_amount,0)>0""")


@query("retrain_union")
def retrain_union(spark, folder):
    """Quality counters of collected records blended with the bundled book."""
    policies, claims = _policies(spark, folder), _claims(spark, folder)
    blended = retraining.retraining_frames(
        sample_book.outcome_records(spark, folder), policies.drop("premium_paid", "policy_year"),
        datasets.claims_with_factors(claims, policies),
    )
    return retraining.retraining_quality(*blended)


sql("retrain_union", f"""WITH {RECORDS}, pos AS (SELECT count(*) AS c FROM claims_src WHERE ClaimAmount>0),
a AS (SELECT count(*) AS n, count(*) FILTER (ClaimNb>0) AS w, count(*) FILTER (premium_paid>0) AS pp,
  count(*) FILTER (coalesce(claim_amount,0)>0) AS c, count(*) FILTER (ClaimNb>0 AND coalesce(claim_amount,0)<=0) AS u FROM recpol),
paid AS (SELECT DISTINCT IDpol FROM claims_src WHERE ClaimAmount>0),
b AS (SELECT count(*) AS n, count(*) FILTER (ClaimNb>0) AS w, count(paid.IDpol) AS k,
  count(*) FILTER (ClaimNb>0 AND paid.IDpol IS NULL) AS u FROM policies_src p LEFT JOIN paid ON paid.IDpol=p.IDpol)
SELECT a.n+b.n AS frequency_rows, a.w+b.w AS policies_with_claims, a.pp AS policies_with_paid_premium, a.c+pos.c AS severity_rows,
a.c+pos.c AS claim_rows_used_for_severity_model, a.c+b.k AS policies_with_paid_amounts, a.u+b.u AS positive_claim_count_without_paid_amount,
0::BIGINT AS severity_rows_without_matching_policy FROM a, b, pos""")


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Priced policies with outcomes: mean claim amount and claim flag."""
    scored = _scored(spark, folder)
    totals = datasets.claim_totals(_claims(spark, folder))
    return scored.join(totals, "IDpol", "left").select(
        "IDpol", F.nullif(F.col("Exposure"), F.lit(1.0)).alias("Exposure"), (F.col("ClaimNb") > 0).alias("claim_occurred"),
        F.col("TotalClaimAmount").alias("claim_amount"), "predicted_annual_frequency", "predicted_claim_severity",
    )


OUTCOMES = SCORED + """,
oc AS (SELECT scored.IDpol, nullif(Exposure,1.0) AS Exposure, ClaimNb>0 AS claim_occurred, TotalClaimAmount AS claim_amount, f, s
  FROM scored LEFT JOIN tot USING (IDpol))"""


@query("drift_severity")
def drift_severity(spark, folder):
    return _round(drift.severity_drift(_outcomes(spark, folder)), 5, "median_ratio", "mean_ratio", "p10_ratio", "p90_ratio")


sql("drift_severity", f"""WITH {OUTCOMES}, r AS (SELECT claim_amount/nullif(s,0) AS ratio FROM oc WHERE claim_amount>0),
q AS (SELECT count(*) AS matched_claims, quantile_cont(ratio,0.5) AS m, avg(ratio) AS a, quantile_cont(ratio,0.1) AS p1,
  quantile_cont(ratio,0.9) AS p9 FROM r)
SELECT matched_claims, round(m,5) AS median_ratio, round(a,5) AS mean_ratio, round(p1,5) AS p10_ratio, round(p9,5) AS p90_ratio,
CASE WHEN matched_claims=0 THEN 'no_data' WHEN m>1.2 THEN 'under_predicted' WHEN m<0.8 THEN 'over_predicted' ELSE 'within_band' END AS status
FROM q""")


@query("drift_frequency")
def drift_frequency(spark, folder):
    return _round(drift.frequency_drift(_outcomes(spark, folder)), 5, "observed_mean", "predicted_mean", "ratio")


sql("drift_frequency", f"""WITH {OUTCOMES}, r AS (SELECT CAST(coalesce(claim_occurred,false) OR coalesce(claim_amount,0)>0 AS INT)
  /coalesce(nullif(Exposure,0),1) AS o, f AS p FROM oc), q AS (SELECT count(*) AS policies, avg(o) AS om, avg(p) AS pm FROM r)
SELECT policies, round(om,5) AS observed_mean, round(pm,5) AS predicted_mean, round(om/pm,5) AS ratio,
CASE WHEN om/pm>1.2 OR om/pm<0.8 THEN 'drift' ELSE 'within_band' END AS status FROM q""")


# ---- quote store -------------------------------------------------------------------------------------------------
def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    return sample_book.quotes_from_events(sample_book.table(spark, folder, "events"))


@query("recent_quotes")
def recent_quotes(spark, folder):
    newest = store.recent_quotes(_quotes(spark, folder), 5000)
    return newest.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "source", "Exposure", "DrivAge")


sql("recent_quotes", """SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts,'%Y-%m-%d %H:%M:%S') AS created_at, event_type AS source,
CAST(1+user_id%100 AS DOUBLE)/100 AS Exposure, CAST(18+user_id%83 AS DOUBLE) AS DrivAge FROM events
ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 5000""")


@query("consented_quotes")
def consented_quotes(spark, folder):
    return store.consented(_quotes(spark, folder)).select("id", "source", "VehBrand", "Area")


sql("consented_quotes", """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS source, concat('B',CAST(1+user_id%14 AS VARCHAR)) AS VehBrand,
substr('ABCDEF',CAST(1+user_id%6 AS INT),1) AS Area FROM events WHERE event_id%3=0""")


@query("quote_store_round_trip")
def quote_store_round_trip(spark, folder):
    """Priced quotes written to the store and read back, per table and source; written twice, stored once."""
    root = scratch_path(spark, "store")
    priced = _tariff(_quotes(spark, folder))
    for _ in range(2):
        store.save_quotes(priced, root, F.col("source"), F.col("consent"), batch_id="backfill")
    out = None
    for name in ("quotes", "training_data"):
        rows = store.read_table(spark, root, name).groupBy("source").agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.sum("exposure"), 4).alias("exposure")
        ).select(F.lit(name).alias("table_name"), "source", "rows", "exposure")
        out = rows if out is None else out.unionByName(rows)
    return out


sql("quote_store_round_trip", """WITH e AS (SELECT event_type AS source, event_id%3=0 AS consent, CAST(1+user_id%100 AS DOUBLE)/100 AS x FROM events)
SELECT 'quotes' AS table_name, source, count(*) AS rows, round(sum(x),4) AS exposure FROM e GROUP BY 2
UNION ALL SELECT 'training_data', source, count(*), round(sum(x),4) FROM e WHERE consent GROUP BY 2""")


@query("table_counts")
def table_counts(spark, folder):
    quotes = _quotes(spark, folder)
    return store.table_counts({
        "quotes": quotes, "training_data": store.consented(quotes), "b2b_portfolios": sample_book.raw_policies(spark, folder),
    })


sql("table_counts", """SELECT 'quotes' AS table_name, count(*) AS rows FROM events UNION ALL
SELECT 'training_data', count(*) FROM events WHERE event_id%3=0 UNION ALL
SELECT 'b2b_portfolios', count(*) FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey""")


# ---- streams -----------------------------------------------------------------------------------------------------
def _quote_stream(spark: SparkSession, folder: str) -> DataFrame:
    events = streams.read_parquet_stream(spark, folder, sample_book.EVENT_SCHEMA, "events.parquet")
    return sample_book.quotes_from_events(events)


def _closing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The quote stream with a heartbeat three days behind the last event of each type.

    The heartbeat carries the watermark past all events, so every window, session and unmatched quote comes out. Its own
    rows belong to user -1 and stay open in windows and sessions.
    """
    events = sample_book.table(spark, folder, "events")
    last = events.agg(F.max("ts").alias("last"))
    beats = events.select("event_type").distinct().crossJoin(F.broadcast(last)).select(  # one row
        F.lit(None).cast("long").alias("event_id"), (F.col("last") + F.expr("INTERVAL 3 DAYS")).alias("ts"),
        F.lit(-1).cast("long").alias("user_id"), "event_type", F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"),
    )
    path = scratch_path(spark, "heartbeat")
    beats.coalesce(1).write.parquet(path)
    stream = streams.read_parquet_stream(spark, folder, sample_book.EVENT_SCHEMA, "events.parquet")
    return sample_book.quotes_from_events(stream.unionByName(streams.read_parquet_stream(spark, path, sample_book.EVENT_SCHEMA)))


def _run(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    return streams.run_to_table(stream, scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint"))


@query("stream_daily_quotes")
def stream_daily_quotes(spark, folder):
    daily = _run(spark, streams.volume_by_window(_closing_stream(spark, folder)), "daily")
    return _round(daily.drop("window_end"), 3, "total_value").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
    )


sql("stream_daily_quotes", f"""SELECT strftime(date_trunc('day',ts),'%Y-%m-%d %H:%M:%S') AS window_start, event_type AS source,
count(*) AS quotes, round(sum(value),3) AS total_value FROM events GROUP BY 1,2""")


@query("stream_sliding_quotes")
def stream_sliding_quotes(spark, folder):
    sliding = streams.volume_by_window(_closing_stream(spark, folder), "1 day", "12 hours")
    return _run(spark, sliding, "sliding").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "source", "quotes"
    )


sql("stream_sliding_quotes", f"""WITH s AS (SELECT event_type AS source, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - k*INTERVAL 12 HOUR AS w
FROM events, (VALUES (0),(1)) t(k))
SELECT strftime(w,'%Y-%m-%d %H:%M:%S') AS window_start, source, count(*) AS quotes FROM s GROUP BY 1,2""")


@query("stream_consent_fanout")
def stream_consent_fanout(spark, folder):
    root = scratch_path(spark, "fanout")
    scored = _tariff(_quote_stream(spark, folder))
    running = streams.store_quotes(
        scored, root, scratch_path(spark, "fanout-checkpoint"), F.col("source"), F.col("consent"), available_now=True
    )
    running.awaitTermination()
    parts = [
        store.read_table(spark, root, n).select(F.lit(n).alias("table_name"), "id", "source", "consent", F.round("exposure", 4).alias("exposure"))
        for n in ("quotes", "training_data")
    ]
    return parts[0].unionByName(parts[1])


sql("stream_consent_fanout", """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS source, event_id%3=0 AS consent,
round(CAST(1+user_id%100 AS DOUBLE)/100,4) AS exposure FROM events)
SELECT 'quotes' AS table_name, * FROM e UNION ALL SELECT 'training_data', * FROM e WHERE consent""")


@query("stream_dedup")
def stream_dedup(spark, folder):
    """Every quote delivered twice, stored once."""
    doubled = _quote_stream(spark, folder).unionByName(_quote_stream(spark, folder))
    return _run(spark, streams.deduplicate(doubled.select("id", "created_at", "source")), "dedup").select("id", "source")


sql("stream_dedup", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS source FROM events")


@query("stream_outcome_match")
def stream_outcome_match(spark, folder):
    """Every view with the purchases of the same user within two hours, or with none."""
    viewed = _closing_stream(spark, folder).where(F.col("source") == "view").select("id", "user_id", "created_at")
    bought = _closing_stream(spark, folder).where(F.col("source") == "purchase").select(
        F.col("id").alias("outcome_id"), "user_id", "created_at"
    )
    matched = _run(spark, streams.match_outcomes(viewed, bought, "user_id"), "match").where("user_id >= 0")
    return matched.select("id", "user_id", "outcome_id")


sql("stream_outcome_match", """WITH v AS (SELECT * FROM events WHERE event_type='view'), p AS (SELECT * FROM events WHERE event_type='purchase')
SELECT CAST(v.event_id AS VARCHAR) AS id, v.user_id, CAST(p.event_id AS VARCHAR) AS outcome_id
FROM v LEFT JOIN p ON p.user_id=v.user_id AND p.ts>=v.ts AND p.ts<=v.ts + INTERVAL 2 HOUR""")


@query("stream_first_outcome")
def stream_first_outcome(spark, folder):
    """Every view with the first purchase of the same user within two hours, and how many there were."""
    events = _closing_stream(spark, folder)
    viewed = events.where(F.col("source") == "view").select("id", "user_id", "created_at")
    bought = _closing_stream(spark, folder).where(F.col("source") == "purchase").select("id", "user_id", "created_at")
    matched = _run(spark, streams.first_outcomes(viewed, bought, "user_id"), "first-outcome").where("user_id >= 0")
    return matched.select("id", "user_id", "first_outcome", "outcomes")


sql("stream_first_outcome", """WITH v AS (SELECT * FROM events WHERE event_type='view'), p AS (SELECT * FROM events WHERE event_type='purchase')
SELECT CAST(v.event_id AS VARCHAR) AS id, v.user_id, first(CAST(p.event_id AS VARCHAR) ORDER BY p.ts, CAST(p.event_id AS VARCHAR)) AS first_outcome,
CAST(count(p.event_id) AS INT) AS outcomes
FROM v LEFT JOIN p ON p.user_id=v.user_id AND p.ts>=v.ts AND p.ts<=v.ts + INTERVAL 2 HOUR GROUP BY v.event_id, v.user_id""")


@query("stream_median_drift")
def stream_median_drift(spark, folder):
    """Median of observed over predicted value per day in a stream, and its verdict."""
    stream = _closing_stream(spark, folder).withColumn("predicted", F.lit(40.0) + F.col("user_id") % 21)
    sketches = _run(spark, streams.windowed_ratio_sketches(stream, "value", "predicted"), "median-drift")
    daily = streams.drift_of_sketches(sketches)
    return _round(daily, 6, "p10_ratio", "median_ratio", "p90_ratio").withColumn(
        "period_start", F.date_format("period_start", "yyyy-MM-dd HH:mm:ss")
    )


sql("stream_median_drift", """WITH r AS (SELECT date_trunc('day',ts) AS d, value/(40.0::DOUBLE+user_id%21) AS q FROM events WHERE value IS NOT NULL),
a AS (SELECT d, count(*) AS matched, quantile_disc(q,0.1) AS p10, quantile_disc(q,0.5) AS p50, quantile_disc(q,0.9) AS p90 FROM r GROUP BY d)
SELECT strftime(d,'%Y-%m-%d %H:%M:%S') AS period_start, matched, round(p10,6) AS p10_ratio, round(p50,6) AS median_ratio, round(p90,6) AS p90_ratio,
CASE WHEN p50>1.2 THEN 'under_predicted' WHEN p50<0.8 THEN 'over_predicted' ELSE 'within_band' END AS status FROM a""")


@query("stream_sessions")
def stream_sessions(spark, folder):
    sessions = _run(spark, streams.quoting_sessions(_closing_stream(spark, folder)), "sessions")
    return sessions.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "quotes")


sql("stream_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE
THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
a AS (SELECT user_id, k, min(ts) AS st, max(ts) + INTERVAL 30 MINUTE AS en, count(*) AS quotes FROM s GROUP BY 1,2)
SELECT user_id, strftime(st,'%Y-%m-%d %H:%M:%S') AS session_start, quotes FROM a""")


@query("stream_windowed_drift")
def stream_windowed_drift(spark, folder):
    """Observed value against a prediction by user, per day."""
    stream = _closing_stream(spark, folder).withColumn("predicted", F.lit(40.0) + F.col("user_id") % 21)
    out = _run(spark, streams.windowed_drift(stream, "value", "predicted"), "drift")
    return _round(out, 5, "ratio").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


sql("stream_windowed_drift", f"""SELECT strftime(date_trunc('day',ts),'%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS matched,
round(sum(value)/sum(40.0::DOUBLE+user_id%21),5) AS ratio FROM events GROUP BY 1""")


@query("stream_scoring")
def stream_scoring(spark, folder):
    """Quotes scored in a stream by models fitted on the book."""
    _, (frequency, severity) = _fit_pair(spark, folder, "poisson", "gamma")
    metadata = {**_metadata(), "portfolio_baselines": dict.fromkeys(pricing.BASELINE_KEYS, 1.0)}
    scored = streams.score_stream(_quote_stream(spark, folder), frequency, severity, metadata)
    return _run(spark, scored.select("id", "source", "final_premium", "risk_category"), "scoring")


# ---- the priced book ------------------------------------------------------------------------------------------------
@query("isolation_outliers")
def isolation_outliers(spark, folder):
    """Policies with several factors moved to their far ends together: the forest ranks all of them first."""
    moved = F.col("IDpol") % 3000 == 0
    ends = {"DrivAge": 100.0, "VehAge": 100.0, "BonusMalus": 350.0, "VehPower": 20.0}
    book = _policies(spark, folder).withColumns({c: F.when(moved, F.lit(v)).otherwise(F.col(c)) for c, v in ends.items()})
    scored = isolation.isolation_scores(book, list(ends), "IDpol").select("IDpol", "isolation_score")
    planted = book.where(moved).count()
    return scored.orderBy(F.desc("isolation_score"), "IDpol").limit(planted).select("IDpol")


sql("isolation_outliers", f"WITH {POL} SELECT IDpol FROM pol WHERE IDpol%3000=0")


@query("lorenz_gini")
def lorenz_gini(spark, folder):
    scored = _with_totals(spark, folder)
    row = diagnostics.gini(scored, "annualized_expected_loss", "TotalClaimAmount", "Exposure", "IDpol")
    return _round(row, 6, "gini").withColumns({"total_loss": F.round("total_loss", 2), "total_exposure": F.round("total_exposure", 2)})


def _with_totals(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.attach_claim_totals(_scored(spark, folder), _claims(spark, folder))


WITH_TOTALS = SCORED + ", wt AS (SELECT scored.*, coalesce(TotalClaimAmount,0) AS TotalClaimAmount FROM scored LEFT JOIN tot USING (IDpol))"
LORENZ = WITH_TOTALS + """,
lz AS (SELECT Exposure AS e, TotalClaimAmount AS l, sum(Exposure) OVER w AS ce, sum(TotalClaimAmount) OVER w AS cl2,
  sum(Exposure) OVER () AS te, sum(TotalClaimAmount) OVER () AS tl FROM wt
  WINDOW w AS (ORDER BY Area_rank, IDpol ROWS UNBOUNDED PRECEDING))"""
LORENZ = LORENZ.replace("Area_rank", "ann")
sql("lorenz_gini", f"""WITH {LORENZ} SELECT count(*) AS policies, round(max(tl),2) AS total_loss, round(max(te),2) AS total_exposure,
round(1-2*sum(e*(2*cl2-l)/2)/(max(te)*max(tl)),6) AS gini FROM lz""")


@query("lorenz_curve")
def lorenz_curve(spark, folder):
    curve = diagnostics.lorenz_curve(_with_totals(spark, folder), "annualized_expected_loss", "TotalClaimAmount", "Exposure", "IDpol")
    return _round(curve, 5, "exposure_share", "loss_share")


sql("lorenz_curve", f"""WITH {LORENZ} SELECT CAST(least(ceil(round(ce/te*20,9)),20) AS INT) AS point, round(max(ce/te),5) AS exposure_share,
round(max(cl2/tl),5) AS loss_share FROM lz GROUP BY 1""")


@query("portfolio_overview")
def portfolio_overview(spark, folder):
    row = book.portfolio_overview(_scored(spark, folder))
    return _round(row, 4, "claim_rate", "avg_frequency", "avg_severity").withColumn("total_expected_loss", F.round("total_expected_loss", 2))


sql("portfolio_overview", f"""WITH {SCORED} SELECT count(*) AS policies, round(sum(ClaimNb)/sum(Exposure),4) AS claim_rate,
round(avg(f),4) AS avg_frequency, round(avg(s),4) AS avg_severity, round(sum(pure),2) AS total_expected_loss FROM scored""")


@query("repriced_book")
def repriced_book(spark, folder):
    out = book.repriced_book(_scored(spark, folder)).select(
        "IDpol", "premium_paid", "recommended_premium", "premium_change", "premium_change_pct"
    )
    return _round(out, 6, "premium_paid", "recommended_premium", "premium_change", "premium_change_pct")


REPRICED = SCORED + """, rp AS (SELECT *, technical_premium-nullif(premium_paid,0) AS chg,
(technical_premium-nullif(premium_paid,0))/nullif(premium_paid,0)*100 AS pct FROM scored)"""
sql("repriced_book", f"""WITH {REPRICED} SELECT IDpol, round(premium_paid,6) AS premium_paid, round(technical_premium,6) AS recommended_premium,
round(chg,6) AS premium_change, round(pct,6) AS premium_change_pct FROM rp""")


@query("segment_guidance")
def segment_guidance(spark, folder):
    out = book.segment_guidance(book.repriced_book(_scored(spark, folder)), ["Area", "VehGas"], cube=True)
    return _round(out, 3, "charged", "recommended", "recommended_change_pct")


sql("segment_guidance", f"""WITH {REPRICED} SELECT Area, VehGas, count(*) AS policies, round(sum(premium_paid),3) AS charged,
round(sum(technical_premium),3) AS recommended, round((sum(technical_premium)-sum(premium_paid))/sum(premium_paid)*100,3) AS recommended_change_pct
FROM rp WHERE pct IS NOT NULL GROUP BY CUBE(Area, VehGas)""")


@query("adverse_selection")
def adverse_selection(spark, folder):
    flagged = book.adverse_selection(book.repriced_book(_scored(spark, folder)))
    return flagged.groupBy("risk_category", "selection_flag").agg(F.count(F.lit(1)).alias("policies"))


sql("adverse_selection", f"""WITH {REPRICED} SELECT risk_category, CASE WHEN risk_category='Low' AND pct<-20 THEN 'low_risk_overcharged'
WHEN risk_category='High' AND pct>20 THEN 'high_risk_undercharged' ELSE 'none' END AS selection_flag, count(*) AS policies FROM rp GROUP BY 1,2""")


@query("band_backtest")
def band_backtest(spark, folder):
    return _round(book.band_backtest(_with_totals(spark, folder)), 4, "observed_frequency", "observed_severity", "observed_loss")


sql("band_backtest", f"""WITH {WITH_TOTALS} SELECT risk_category, count(*) AS policies, round(sum(ClaimNb)/sum(Exposure),4) AS observed_frequency,
round(sum(TotalClaimAmount)/nullif(sum(ClaimNb),0),4) AS observed_severity, round(sum(TotalClaimAmount)/sum(Exposure),4) AS observed_loss
FROM wt GROUP BY 1""")


@query("yoy_trend")
def yoy_trend(spark, folder):
    out = book.yearly_trend(_with_totals(spark, folder))
    return _round(out, 4, *[c for c in out.columns if c not in ("policy_year", "policies")])


sql("yoy_trend", f"""WITH {WITH_TOTALS}, y AS (SELECT policy_year, count(*) AS policies, count(*) FILTER (risk_category='High')/count(*) AS hs,
sum(ClaimNb)/sum(Exposure) AS fr, sum(TotalClaimAmount)/nullif(sum(ClaimNb),0) AS se FROM wt GROUP BY 1)
SELECT policy_year, policies, round(hs,4) AS high_share, round(fr,4) AS frequency, round(se,4) AS severity,
round(hs-lag(hs) OVER (ORDER BY policy_year),4) AS high_share_change, round(fr-lag(fr) OVER (ORDER BY policy_year),4) AS frequency_change,
round(se-lag(se) OVER (ORDER BY policy_year),4) AS severity_change FROM y""")


@query("premium_waterfall")
def premium_waterfall(spark, folder):
    return _round(book.premium_waterfall(_scored(spark, folder)), 4, "amount")


sql("premium_waterfall", f"""WITH {SCORED} SELECT IDpol, 1 AS step_order, 'expected_loss' AS step, round(pure,4) AS amount FROM scored UNION ALL
SELECT IDpol, 2, 'expense_loading', round(pure*0.3,4) FROM scored UNION ALL SELECT IDpol, 3, 'fixed_expense', 30.0::DOUBLE FROM scored UNION ALL
SELECT IDpol, 4, 'minimum_top_up', round(final_premium-technical_premium,4) FROM scored UNION ALL
SELECT IDpol, 5, 'final_premium', round(final_premium,4) FROM scored""")


@query("psi")
def psi(spark, folder):
    """Stability of the charged premium: policies up to 1998 against later ones."""
    raw = sample_book.raw_policies(spark, folder).select("premium_paid", "policy_year")
    table = diagnostics.population_stability(
        raw.where(F.col("policy_year") <= 1998), raw.where(F.col("policy_year") > 1998), "premium_paid"
    )
    return _round(table, 6, "expected_share", "actual_share", "psi_term")


sql("psi", f"""WITH {POLICIES_SRC}, ex AS (SELECT premium_paid AS v FROM policies_src WHERE policy_year<=1998),
ac AS (SELECT premium_paid AS v FROM policies_src WHERE policy_year>1998),
q AS (SELECT quantile_cont(v,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM ex),
b AS (SELECT len(list_filter(e, lambda x: x < v)) AS bucket, 1 AS x FROM ex, q UNION ALL SELECT len(list_filter(e, lambda x: x < v)), 0 FROM ac, q),
c AS (SELECT bucket, count(*) FILTER (x=1) AS en, count(*) FILTER (x=0) AS an FROM b GROUP BY 1),
s AS (SELECT bucket, greatest(en/sum(en) OVER (),1e-6) AS es, greatest(an/sum(an) OVER (),1e-6) AS sa FROM c)
SELECT CAST(bucket AS INT) AS bucket, round(es,6) AS expected_share, round(sa,6) AS actual_share, round((sa-es)*ln(sa/es),6) AS psi_term FROM s""")


@query("coverage_recommendation")
def coverage_recommendation(spark, folder):
    scored = _tariff(sample_book.raw_policies(spark, folder))
    advised = book.coverage_recommendations(scored)
    return advised.select("IDpol", F.array_join("coverage", ",").alias("coverage"))


TARIFF_SQL = POLICIES_SRC + """,
tf AS (SELECT *, (0.05::DOUBLE+0.004::DOUBLE*VehPower+0.001::DOUBLE*abs(DrivAge-45)+0.0005::DOUBLE*BonusMalus)
  *(800::DOUBLE+25::DOUBLE*VehPower+0.5::DOUBLE*BonusMalus) AS ann FROM policies_src)"""
sql("coverage_recommendation", f"""WITH {TARIFF_SQL} SELECT IDpol, concat_ws(',',
CASE WHEN ann<=160 THEN 'third_party,basic_own_damage,higher_voluntary_deductible' WHEN ann<=430 THEN 'comprehensive,zero_depreciation'
ELSE 'comprehensive,zero_depreciation,engine_protection,roadside_assistance,consider_telematics' END,
CASE WHEN VehAge>10 THEN 'consider_third_party_only' END) AS coverage FROM tf""")


@query("survey_mapping")
def survey_mapping(spark, folder):
    """Event users as questionnaire answers, mapped to rating factors."""
    user = F.col("user_id")
    levels = F.array(F.lit("Low"), F.lit("Medium"), F.lit("High"))
    kinds = F.array(*[F.lit(k) for k in ("Sedan", "SUV", "Hatchback", "Motorcycle", "Other")])
    survey = sample_book.table(spark, folder, "events").select(
        "event_id", (F.lit(18) + user % 83).alias("age"), F.get(kinds, (user % 5).cast("int")).alias("vehicle_type"),
        (user % 15).alias("vehicle_age"), (user % 70).alias("daily_km"),
        F.get(levels, (user % 3).cast("int")).alias("night_driving"), F.get(levels, (F.col("event_id") % 3).cast("int")).alias("harsh_braking"),
        (F.col("event_id") % 4).alias("accidents_2yr"), (F.col("event_id") % 2 == 0).alias("claim_filed"),
        (user % 45).alias("experience_years"),
    )
    return _round(book.survey_to_policies(survey).select("event_id", *RATING_COLUMNS), 4, "Exposure", "BonusMalus")


sql("survey_mapping", """WITH s AS (SELECT event_id, user_id AS u, event_id%4 AS acc, CAST(event_id%2=0 AS INT) AS c, user_id%3+event_id%3 AS pts FROM events)
SELECT event_id, round(least(greatest((u%70)/20.0::DOUBLE,0.1),2.5),4) AS Exposure,
CAST([6,8,5,4,6][u%5+1] AS DOUBLE) AS VehPower, CAST(u%15 AS DOUBLE) AS VehAge, CAST(18+u%83 AS DOUBLE) AS DrivAge,
round(least(greatest(50+acc*14+c*18-least(u%45,30)*0.6::DOUBLE,50),350),4) AS BonusMalus,
['B12','B11','B10','B2','B12'][u%5+1] AS VehBrand, CASE WHEN u%5=3 THEN 'Diesel' ELSE 'Regular' END AS VehGas,
substr('ABCDEF',CAST(least(pts+acc+c,5)+1 AS INT),1) AS Area, 393.0::DOUBLE+acc*180+c*140 AS Density, 'Centre' AS Region FROM s""")


@query("anomaly_flags")
def anomaly_flags(spark, folder):
    raw = sample_book.raw_policies(spark, folder).select("IDpol", "premium_paid")
    flagged = diagnostics.anomaly_flags(raw, ["premium_paid"])
    return _round(flagged, 6, "premium_paid", "robust_z_premium_paid")


sql("anomaly_flags", f"""WITH {POLICIES_SRC}, m AS (SELECT quantile_cont(premium_paid,0.5) AS m FROM policies_src),
d AS (SELECT quantile_cont(abs(premium_paid-m.m),0.5) AS d FROM policies_src, m)
SELECT IDpol, round(premium_paid,6) AS premium_paid, round(0.6745::DOUBLE*(premium_paid-m.m)/nullif(d.d,0),6) AS robust_z_premium_paid,
coalesce(abs(0.6745::DOUBLE*(premium_paid-m.m)/nullif(d.d,0))>3.5,false) AS is_anomaly FROM policies_src, m, d""")
