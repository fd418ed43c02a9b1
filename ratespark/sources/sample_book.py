"""Views the star-schema sample tables as policies, claims, quotes and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import to_number

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Returned, fulfilled order lines as claims on their order."""
    lines = table(spark, folder, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
    return lines.select(
        F.col("l_orderkey").alias("IDpol"), (F.col("l_extendedprice") * F.col("l_discount")).alias("ClaimAmount"),
        F.col("l_linenumber").alias("claim_seq"),
    )


def _cycle(column: str, length: int, start: int) -> Column:
    return (F.lit(start) + F.col(column) % F.lit(length)).cast("double")


def raw_policies(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as policies with factors derived from their keys; fuel and density have gaps."""
    claims = raw_claims(spark, folder).groupBy("IDpol").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, folder, "orders")
    owners = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined = (
        orders.join(owners, orders.o_custkey == owners.c_custkey)
        .join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(claims, orders.o_orderkey == claims.IDpol, "left")
    )
    return joined.select(
        F.col("o_orderkey").alias("IDpol"),
        F.coalesce("n", F.lit(0)).alias("ClaimNb"),
        (_cycle("o_orderkey", 100, 1) / F.lit(100.0)).alias("Exposure"),
        _cycle("o_custkey", 12, 4).alias("VehPower"),
        (F.lit(2001) - F.year("o_orderdate")).cast("double").alias("VehAge"),
        _cycle("o_custkey", 83, 18).alias("DrivAge"),
        _cycle("o_orderkey", 181, 50).alias("BonusMalus"),
        F.concat(F.lit("B"), (F.lit(1) + F.col("o_custkey") % F.lit(14)).cast("string")).alias("VehBrand"),
        F.when(F.col("o_orderstatus") == "F", "Diesel").when(F.col("o_orderstatus") == "O", "Regular").alias("VehGas"),
        F.substring(F.lit("ABCDEF"), (F.lit(1) + F.col("o_custkey") % F.lit(6)).cast("int"), 1).alias("Area"),
        F.when(F.col("o_orderkey") % F.lit(97) != 0, F.col("o_totalprice") / F.lit(20.0)).alias("Density"),
        F.col("n_name").alias("Region"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("premium_paid"),
        F.year("o_orderdate").alias("policy_year"),
    )


def quotes_from_events(events: DataFrame) -> DataFrame:
    """Events as quotes: a third with consent, rating factors by the user's number."""
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("source"),
        (F.col("event_id") % F.lit(3) == 0).alias("consent"),
        "user_id", "value",
        (_cycle("user_id", 100, 1) / F.lit(100.0)).alias("Exposure"),
        _cycle("user_id", 12, 4).alias("VehPower"),
        _cycle("user_id", 30, 0).alias("VehAge"),
        _cycle("user_id", 83, 18).alias("DrivAge"),
        _cycle("user_id", 181, 50).alias("BonusMalus"),
        F.concat(F.lit("B"), (F.lit(1) + F.col("user_id") % F.lit(14)).cast("string")).alias("VehBrand"),
        F.when(F.col("user_id") % F.lit(2) == 0, "Diesel").otherwise("Regular").alias("VehGas"),
        F.substring(F.lit("ABCDEF"), (F.lit(1) + F.col("user_id") % F.lit(6)).cast("int"), 1).alias("Area"),
        _cycle("user_id", 5000, 10).alias("Density"),
        F.lit("Centre").alias("Region"),
    )


def raw_dutch(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in the shape of the Dutch portfolio, with zero exposures and unknown zip codes."""
    claims = raw_claims(spark, folder).groupBy("IDpol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ClaimAmount").alias("total")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(claims, orders.o_orderkey == claims.IDpol, "left").select(
        F.col("o_orderkey").alias("row_key"),
        (F.lit(18) + F.col("o_custkey") % F.lit(70)).alias("age_policyholder"),
        F.coalesce("n", F.lit(0)).alias("nclaims"),
        ((F.col("o_orderkey") % F.lit(100)).cast("double") / F.lit(100.0)).alias("exposure"),
        F.coalesce("total", F.lit(0.0)).alias("amount"),
        (F.lit(20) + F.col("o_custkey") % F.lit(130)).alias("power"),
        (F.lit(1) + F.col("o_orderkey") % F.lit(23)).alias("bm"),
        (F.col("o_custkey") % F.lit(5)).alias("zip"),
    )


def raw_spanish(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in the shape of the Spanish portfolio: text dates, gaps, zero power, unknown codes."""
    claims = raw_claims(spark, folder).groupBy("IDpol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ClaimAmount").alias("total")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    birth = F.concat(F.lit("01/01/"), (F.lit(1930) + owner % F.lit(70)).cast("string"))
    return orders.join(claims, orders.o_orderkey == claims.IDpol, "left").select(
        key.alias("ID"),
        F.when(key % F.lit(53) != 0, F.col("o_totalprice") / F.lit(1000.0)).alias("Premium"),
        (owner % F.lit(97)).alias("Power"),
        (F.lit(1995) + key % F.lit(26)).alias("Year_matriculation"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date_start_contract"),
        F.when(key % F.lit(41) != 0, birth).otherwise(F.lit("unknown")).alias("Date_birth"),
        F.when(key % F.lit(7) != 0, owner % F.lit(25)).alias("N_claims_history"),
        F.when(key % F.lit(3) == 0, "P").when(key % F.lit(3) == 1, "D").alias("Type_fuel"),
        F.when(key % F.lit(11) != 0, owner % F.lit(3)).alias("Area"),
        F.col("n").alias("N_claims_year"),
        F.when(key % F.lit(13) == 0, F.lit(75.5)).otherwise(F.col("total")).alias("Cost_claims_year"),
    )


def outcome_records(spark: SparkSession, folder: str) -> DataFrame:
    """Claims history as stored outcome records: lower-case names, text ids, gaps and zeros."""
    claims = raw_claims(spark, folder).groupBy("IDpol").agg(F.avg("ClaimAmount").alias("mean_amount"))
    policies = raw_policies(spark, folder).withColumnRenamed("ClaimNb", "n")
    key = F.col("IDpol")
    joined = policies.join(claims, "IDpol", "left")
    return joined.select(
        F.when(key % F.lit(2) == 0, key.cast("string")).otherwise(F.concat(F.lit("q-"), key.cast("string"))).alias("id"),
        F.when(key % F.lit(10) != 0, F.col("Exposure")).alias("exposure"),
        F.col("VehPower").alias("vehpower"),
        F.when(F.col("VehAge") > 3, F.col("VehAge")).otherwise(F.lit(0.0)).alias("vehage"),
        F.when(key % F.lit(9) != 0, F.col("DrivAge")).alias("drivage"),
        F.col("BonusMalus").alias("bonusmalus"),
        F.col("VehBrand").alias("vehbrand"), F.col("VehGas").alias("vehgas"), F.col("Area").alias("area"),
        F.col("Density").alias("density"), F.col("Region").alias("region"),
        F.when(key % F.lit(4) != 0, F.col("n") > 0).alias("claim_occurred"),
        to_number("mean_amount").alias("claim_amount"),
        F.when(key % F.lit(5) != 0, F.col("premium_paid")).alias("premium_paid"),
    )
