"""Small policies and claims made from hashes of the row number."""

from __future__ import annotations

from pyspark.sql import functions as F


def pick(values, salt):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def between(low, high, salt):
    return (F.lit(low) + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1))).cast("double")


def make_policies(spark, rows=30):
    return spark.range(1, rows + 1).select(
        F.col("id").alias("IDpol"),
        between(0, 2, 1).cast("int").alias("ClaimNb"),
        (between(10, 100, 2) / 100).alias("Exposure"),
        between(4, 11, 3).alias("VehPower"),
        between(0, 14, 4).alias("VehAge"),
        between(21, 69, 5).alias("DrivAge"),
        between(50, 119, 6).alias("BonusMalus"),
        pick(["B1", "B2", "B12"], 7).alias("VehBrand"),
        pick(["Regular", "Diesel"], 8).alias("VehGas"),
        pick(["A", "B", "C"], 9).alias("Area"),
        between(20, 1999, 10).alias("Density"),
        pick(["Centre", "Rhone-Alpes", "Bretagne"], 11).alias("Region"),
    )


def make_claims(policies):
    amount = (F.lit(200) + F.pmod(F.xxhash64("IDpol"), F.lit(2301))).cast("double")
    return policies.where("ClaimNb > 0").select("IDpol", amount.alias("ClaimAmount"))
