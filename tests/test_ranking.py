import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratespark.operators import ranking, sampling, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value."""
    return spark.range(0, 5003, 1, 9).select(
        "id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(997)).cast("double")).alias("v")
    ).cache()


def test_global_rank_is_row_number(skewed):
    ranked = ranking.global_rank(skewed, ["v", "id"], "r", "n").toPandas().sort_values(["v", "id"])
    assert (ranked["r"].to_numpy() == np.arange(1, 5004)).all() and (ranked["n"] == 5003).all()


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 10, 11, 25, 103])
def test_buckets_match_pandas_qcut(spark, rows):
    df = spark.range(rows).select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("v"))
    got = ranking.with_quantile_bucket(df, ["v", "id"], 10).toPandas().sort_values(["v", "id"])
    ranks = pd.Series(np.arange(1, rows + 1))
    expected = pd.qcut(ranks, q=min(10, rows), labels=False, duplicates="drop") if rows > 1 else [0]
    assert list(got["bucket"]) == list(expected)


def test_prefix_sums_per_group(skewed):
    df = skewed.withColumn("g", (F.col("id") % 2).cast("int"))
    out = ranking.prefix_sums(
        df, ["g", "v", "id"], {"s": F.col("v"), "k": F.lit(1)}, by=["g"], totals={"s": "t"}
    ).toPandas().sort_values(["g", "v", "id"])
    expected = out.groupby("g")["v"].cumsum()
    assert np.allclose(out["s"], expected) and (out["k"] == out.groupby("g").cumcount() + 1).all()
    assert np.allclose(out["t"], out.groupby("g")["v"].transform("sum"))


def row_exchanges(df):
    """Exchanges by hash or range that carry rows, not sums made before them."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    moves = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
    return [plan[i] for i in moves if "Aggregate" not in plan[i + 1] and "__parts" not in plan[i + 1] and "Window" not in plan[i + 1]]


def test_rows_are_exchanged_once(skewed):
    raw = skewed.select("id", "v", F.lit("payload").alias("p"))
    for df in (
        ranking.global_rank(raw, ["v", "id"], "r", "n"), ranking.prefix_sums(raw, ["v", "id"], {"s": F.col("v")}, totals={"s": "t"})
    ):
        assert len(row_exchanges(df)) == 1 and "__part" in row_exchanges(df)[0]
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()  # no written copy


@pytest.mark.parametrize("order", [["v", "id"], ["-v", "id"], ["t", "-id"], ["-t", "v", "id"]])
def test_ranks_with_nulls_text_and_descending_keys(spark, order):
    df = spark.range(0, 900, 1, 5).select(
        "id", F.when(F.col("id") % 4 != 0, F.pmod(F.xxhash64("id"), F.lit(9)) - F.lit(4.5)).alias("v"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("é"), (F.col("id") % 5).cast("string"))).alias("t"),
    )
    from pyspark.sql import Window

    keys = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in order]
    want = df.select("id", F.row_number().over(Window.orderBy(*keys)).alias("r"))
    got = ranking.global_rank(df, order, "r").select("id", "r")
    assert got.exceptAll(want).count() == 0 and got.count() == 900


def test_prefix_sums_of_groups_smaller_and_larger_than_a_part(spark):
    df = spark.range(0, 3000, 1, 7).select(
        "id", F.when(F.col("id") < 1200, F.lit(-1)).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 400).alias("g"),
        (F.col("id") % 11).alias("x"),
    )
    out = ranking.prefix_sums(df, ["g", "id"], {"s": F.col("x")}, by=["g"], totals={"s": "t"}).toPandas().sort_values(["g", "id"])
    assert len(out) == 3000
    assert (out["s"] == out.groupby("g", dropna=False)["x"].cumsum()).all()
    assert (out["t"] == out.groupby("g", dropna=False)["x"].transform("sum")).all()


def test_ranks_of_an_empty_frame(spark):
    none = spark.range(0)
    assert ranking.global_rank(none, ["id"]).count() == 0
    assert ranking.prefix_sums(none, ["id"], {"s": F.col("id")}, totals={"s": "t"}).count() == 0


@pytest.mark.parametrize("bins", [2, 7, 2048])
def test_quantiles_of_hard_values(spark, monkeypatch, bins):
    monkeypatch.setattr(ranking, "BINS", bins)
    rng = np.random.default_rng(3)
    columns = {
        "heavy": np.exp(rng.normal(0, 40, 2001)), "two": np.repeat([1.0, np.nextafter(1.0, 2.0)], [1000, 1001]),
        "wide": rng.choice([-1.7e308, -1.0, 0.0, 1e-320, 2e-320, 1.7e308], 2001), "flat": np.full(2001, 7.25),
        "signs": rng.normal(0, 1e-9, 2001),
    }
    pdf = pd.DataFrame(columns)
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.501, "e": 1.0}
    got = {r.feature: r for r in ranking.exact_quantiles(spark.createDataFrame(pdf), list(columns), shares).collect()}
    for name in columns:
        ordered = np.sort(pdf[name].to_numpy())
        for label, share in shares.items():
            at = 2000 * share
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert got[name][label] == low + (high - low) * (at - np.floor(at))


def test_quantiles_with_infinities_and_gaps(spark):
    values = [float("-inf")] * 3 + [None] * 5 + [1.0, 2.0, 4.0] + [float("inf")] * 2
    df = spark.createDataFrame([(v, None) for v in values], "v double, none double")
    row = ranking.exact_quantiles(df, ["v", "none"], {"m": 0.5, "x": 3 / 7}).collect()
    assert [(r.feature, r.rows, r.m) for r in row] == [("v", 8, 1.5)]


def test_quantiles_move_no_rows(spark, skewed):
    found = ranking.exact_quantiles(skewed, ["v"], {"m": 0.5})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_exact_quantiles_match_pandas(spark, skewed):
    df = skewed.withColumn("w", F.when(F.col("id") % 7 != 0, F.col("id") * 1.5))
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.feature: r for r in ranking.exact_quantiles(df, ["v", "w"], shares).collect()}
    pdf = df.toPandas()
    for column in ("v", "w"):
        for label, share in shares.items():
            assert got[column][label] == pytest.approx(pdf[column].quantile(share), rel=1e-12)
        assert got[column]["rows"] == pdf[column].count()


def test_approximate_quantiles_are_close(skewed):
    row = ranking.approx_quantiles(skewed, ["v"], {"m": 0.5}).first()
    assert row["m"] == pytest.approx(skewed.toPandas()["v"].median(), abs=2.0)


def test_modes_take_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", " x "), ("a", "x"), ("a", ""), ("b", "y")], "p string, q string")
    assert {r.feature: r.value for r in stats.categorical_modes(df, ["p", "q"]).collect()} == {"p": "a", "q": "x"}


def test_dense_ids_follow_the_order_of_arrival(spark):
    out = ranking.dense_ids(spark.range(0, 500, 1, 6), "n")
    assert out.where("n != id + 1").count() == 0


def test_seeded_sample_is_exact_and_repeatable(spark, skewed):
    one = sampling.seeded_sample(skewed, F.col("id"), 700)
    two = sampling.seeded_sample(skewed.repartition(3), F.col("id"), 700)
    assert one.count() == 700 and one.exceptAll(two).count() == 0
    other = sampling.seeded_sample(skewed, F.col("id"), 700, seed=7)
    assert one.exceptAll(other).count() > 0
    assert sampling.seeded_sample(skewed, F.col("id"), 9999).count() == 5003
    assert sampling.experiment_sample(skewed, F.col("id"), 0.2, 0).count() == 1000
    assert sampling.experiment_sample(skewed, F.col("id"), 0.2, 30).count() == 30


def test_the_number_of_bins_changes_nothing(spark, monkeypatch, skewed):
    monkeypatch.setattr(sampling, "BINS", 1)
    assert sampling.seeded_sample(skewed, F.col("id"), 700).count() == 700


def test_stratified_split_is_exact_per_stratum(spark, skewed):
    df = skewed.withColumn("s", (F.col("id") % 10 == 0).cast("int"))
    train, test = sampling.stratified_split(df, F.col("id"), "s")
    per = {r.s: r["count"] for r in test.groupBy("s").count().collect()}
    rows = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert per == {s: -(-n * 2 // 10) for s, n in rows.items()}
    assert train.count() + test.count() == 5003 and train.join(test, "id").count() == 0


@pytest.mark.parametrize("strata", ["IF(id % 10 = 0, NULL, 'a')", "id % 10 = 0", "IF(id % 3 = 0, NULL, IF(id = 7, 1, 2))", "id % 3 * 0.5"])
def test_few_strata_move_no_rows_and_change_nothing(monkeypatch, skewed, strata):
    rows = skewed.withColumn("s", F.expr(strata))
    few = sampling.stratified_split_labels(rows, F.col("id"), "s")
    if not strata.endswith("0.5"):  # decimals are joined
        assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    monkeypatch.setattr(sampling, "FEW_STRATA", 1)
    many = sampling.stratified_split_labels(rows, F.col("id"), "s")
    assert "Join" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(few.collect(), key=lambda r: r.id) == sorted(many.collect(), key=lambda r: r.id)


def test_split_of_an_empty_frame(skewed):
    assert sampling.stratified_split_labels(skewed.where("id < 0").withColumn("s", F.lit(1)), F.col("id"), "s").count() == 0


def test_hash_split_keeps_its_side(skewed):
    train, test = sampling.hash_split(skewed, F.col("id"))
    part = sampling.hash_split(skewed.where("id < 1000"), F.col("id"))[1]
    assert part.exceptAll(test).count() == 0 and train.count() + test.count() == 5003
    assert 0.17 < test.count() / 5003 < 0.23


def test_metadata(policies):
    meta = stats.build_metadata(policies, note=1)
    pdf = policies.toPandas()
    assert meta["note"] == 1
    assert meta["numeric_defaults"]["Density"] == pdf["Density"].median()
    assert meta["categorical_defaults"]["Area"] == pdf["Area"].mode().iloc[0]
    options = stats.categorical_options(policies).where("feature = 'Region'").collect()
    assert sorted(r.option for r in options) == sorted(pdf["Region"].unique())
    assert meta["numeric_ranges"]["DrivAge"] == {"min": pdf["DrivAge"].min(), "max": pdf["DrivAge"].max()}
