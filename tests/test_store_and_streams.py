import json

import pytest
from pyspark.sql import functions as F

from ratespark.config import CATEGORICAL_DEFAULTS, NUMERIC_DEFAULTS
from ratespark.operators import drift, pricing, retraining
from ratespark.operators.features import engineer_features
from ratespark.operators.validate import UnusableDataError
from ratespark.schemas import QUOTES, conform
from ratespark.sources import readers, store
from ratespark.streaming import quotes as streams

FIXED = {"annual_frequency": 1.0, "claim_severity": 1.0, "annualized_expected_loss": 1.0}


@pytest.fixture(scope="module")
def scored(raw_policies):
    prepared = engineer_features(raw_policies, NUMERIC_DEFAULTS, CATEGORICAL_DEFAULTS)
    return pricing.calculate_premium(prepared, F.lit(0.2), F.lit(900.0), baselines=FIXED)


def test_quotes_and_training_data_share_ids(spark, scored, tmp_path):
    root = str(tmp_path)
    store.save_quotes(scored, root, "batch", F.col("IDpol") % 3 == 0)
    quotes, training = (store.read_table(spark, root, n) for n in ("quotes", "training_data"))
    assert quotes.count() == 30 and training.count() == 10
    assert training.join(quotes, "id", "left_anti").count() == 0
    assert "idpol" not in quotes.columns and "exposure" in quotes.columns
    counts = {r.table_name: r.rows for r in store.table_counts({"quotes": quotes, "training_data": training}).collect()}
    assert counts == {"quotes": 30, "training_data": 10}


def test_repeated_batch_is_stored_once(spark, scored, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        store.save_quotes(scored, root, batch_id="one")
    store.save_quotes(scored, root, batch_id="two")
    assert store.read_table(spark, root, "quotes").count() == 60
    assert store.read_table(spark, root, "training_data").count() == 0


def test_older_files_show_nulls_for_newer_columns(spark, tmp_path):
    old = spark.createDataFrame([("a", 0.5)], "id string, Exposure double")
    conform(old, QUOTES).drop("portfolio_name", "claim_amount").write.parquet(f"{tmp_path}/quotes")
    row = store.read_table(spark, str(tmp_path), "quotes").first()
    assert row["exposure"] == 0.5 and row["claim_amount"] is None


def test_recent_quotes(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") % 50).alias("created_at"))
    assert [r.id for r in store.recent_quotes(df, 3).collect()] == ["49", "99", "48"]


def test_csv_ingest(spark, scored, tmp_path):
    scored.select("Exposure", "VehPower", "VehBrand", "final_premium", "risk_category").write.option("header", True).csv(f"{tmp_path}/in")
    store.ingest_quotes_csv(spark, f"{tmp_path}/in", f"{tmp_path}/store")
    row = store.read_table(spark, f"{tmp_path}/store", "quotes").first()
    assert row["source"] == "backfill" and row["consent"] is False and row["final_premium"] >= 100
    (tmp_path / "b2b.csv").write_text("Exposure,VehPower,claim_occurred,claim_amount,premium_paid\n1,6,True,120.5,300\n0.5,7,,,200\n")
    store.ingest_b2b_csv(spark, f"{tmp_path}/b2b.csv", f"{tmp_path}/store", "Acme Q3")
    rows = store.read_table(spark, f"{tmp_path}/store", "b2b_portfolios").orderBy("premium_paid").collect()
    assert [r.claim_occurred for r in rows] == [False, True] and rows[1].claim_amount == 120.5
    assert {r.portfolio_name for r in rows} == {"Acme Q3"}


def test_csv_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("IDpol,VehPower\n1,NA\n2,x,extra\n3,7\n")
    good, bad = readers.split_malformed(readers.read_csv_text(spark, f"{tmp_path}/p.csv", keep_corrupt=True))
    assert good.count() == 2 and good.where("IDpol = '1' AND VehPower IS NULL").count() == 1
    assert bad.count() == 1 and bad.first()["_corrupt_record"] == "2,x,extra"
    (tmp_path / "s.csv").write_text("ID;Premium\n1;10,5\n")
    assert readers.read_spanish_csv(spark, f"{tmp_path}/s.csv").columns == ["ID", "Premium"]


def test_request_without_policies_is_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"policies": [], "consent": true}')
    with pytest.raises(Exception, match="at least one policy"):
        readers.read_batch_requests(spark, f"{tmp_path}/r.json").collect()


def test_replayed_batch_replaces_all_dates_and_lists_its_own_path_only(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-31 23:59:00"), ("b", "2024-01-31 23:59:30")], "id string, t string")
    quotes = rows.select("id", F.col("t").cast("timestamp").alias("created_at"))
    root = str(tmp_path)
    for shift in (0, 1):
        store.save_quotes(quotes.withColumn("created_at", F.col("created_at") + F.expr(f"INTERVAL {shift} DAYS")), root, consent=True, batch_id="x")
    store.save_quotes(quotes, root, batch_id="y")
    for name, count in (("quotes", 4), ("training_data", 2)):
        assert store.read_table(spark, root, name).count() == count
    batch = store.read_batch(spark, root, "quotes", "x")
    assert batch.count() == 2 and all("batch_id=x" in f for f in batch.inputFiles())


def test_json_requests(spark, tmp_path):
    policy = {"Exposure": 1, "VehPower": 6, "VehBrand": "B12"}
    (tmp_path / "r.json").write_text(json.dumps({"policies": [policy, policy], "consent": True}) + "\n" + json.dumps({"policies": [policy]}))
    rows = readers.read_batch_requests(spark, f"{tmp_path}/r.json").collect()
    assert [r.consent for r in rows] == [True, True, False] and rows[0].VehPower == 6.0


def test_file_versions_and_fingerprint(spark, tmp_path):
    for name, text in (("a.csv", "hello\nthere"), ("b.csv", "hello\nthere"), ("c.csv", "hello\nThere")):
        (tmp_path / name).write_text(text)
    rows = readers.file_versions(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["exists"], r["size_bytes"]) for r in rows] == [(True, 11)] * 3
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] != rows[2]["fingerprint"]
    absent = readers.file_versions(spark, str(tmp_path / "none")).collect()
    assert [(r["exists"], r["fingerprint"]) for r in absent] == [(False, None)]
    df = spark.range(100)
    one, two = (readers.table_fingerprint(d).first() for d in (df, df.repartition(5)))
    assert one == two and readers.table_fingerprint(df.where("id > 0")).first() != one


RECORDS = "id string, exposure double, vehage double, claim_occurred boolean, claim_amount double, premium_paid double"


def full_record(spark, rows):
    df = spark.createDataFrame(rows, RECORDS)
    return df.withColumns({
        "vehpower": F.lit(None).cast("double"), "drivage": F.lit(33.0), "bonusmalus": F.lit(50.0), "vehbrand": F.lit("B1"),
        "vehgas": F.lit(""), "area": F.lit("A"), "density": F.lit(0.0), "region": F.lit("Centre"),
    })


def test_records_become_training_rows(spark):
    rows = [("7", 0.0, 0.0, None, None, None), ("uuid-1", 0.5, 3.0, False, 80.0, 10.0), ("uuid-2", None, None, True, None, 5.0)]
    records = full_record(spark, rows)
    by_exposure = retraining.policy_records(records).orderBy("Exposure").collect()
    assert [r.ClaimNb for r in by_exposure].count(1) == 2
    plain = {r.IDpol: r for r in by_exposure}
    assert plain[7]["Exposure"] == 1.0 and plain[7]["VehAge"] == 0.0 and plain[7]["VehPower"] == 6.0 and plain[7]["VehGas"] == "Regular"
    assert sum(i < 0 for i in plain) == 2
    legacy = {r.IDpol: r for r in retraining.policy_records(records, legacy_zero_as_missing=True).collect()}
    assert legacy[7]["VehAge"] == 6.0 and legacy[7]["Density"] == 500.0
    claims = retraining.claim_records(records).collect()
    assert [c.ClaimAmount for c in claims] == [80.0] and claims[0].IDpol in plain
    with pytest.raises(UnusableDataError, match="fewer than 200"):
        retraining.require_min_rows(records)


def test_blending_keeps_all_columns(spark, policies, raw_claims):
    records = full_record(spark, [("1", 1.0, 1.0, True, 10.0, 5.0)])
    claims = raw_claims.join(policies.drop("ClaimNb"), "IDpol")
    blended, blended_claims = retraining.retraining_frames(records, policies, claims)
    assert blended.count() == 31 and blended.where("premium_paid IS NULL").count() == 30
    quality = retraining.retraining_quality(blended, blended_claims).first()
    assert quality["frequency_rows"] == 31 and quality["policies_with_paid_premium"] == 1
    assert quality["severity_rows"] == raw_claims.count() + 1


@pytest.mark.parametrize("scale, verdict", [(1.0, "within_band"), (2.0, "under_predicted"), (0.5, "over_predicted")])
def test_severity_drift(spark, scale, verdict):
    df = spark.range(1, 101).select((F.col("id") * scale).alias("claim_amount"), F.col("id").cast("double").alias("predicted_claim_severity"))
    empty_amount = df.limit(1).withColumn("claim_amount", F.lit(None).cast("double"))
    row = drift.severity_drift(df.unionByName(empty_amount)).first()
    assert row["matched_claims"] == 100 and row["median_ratio"] == pytest.approx(scale) and row["status"] == verdict
    assert drift.severity_drift(df.where("false")).first()["status"] == "no_data"


def test_frequency_drift_and_report(spark):
    df = spark.createDataFrame(
        [(0.5, True, None, 1.0, 10.0), (None, False, 5.0, 1.0, 5.0), (0.0, None, None, 1.0, 5.0)],
        "Exposure double, claim_occurred boolean, claim_amount double, predicted_annual_frequency double, predicted_claim_severity double",
    )
    row = drift.frequency_drift(df).first()
    assert row["observed_mean"] == pytest.approx(1.0) and row["status"] == "within_band"
    report = drift.drift_report(df).collect()
    assert {(r.component, r.metric) for r in report} >= {("severity", "p90_ratio"), ("frequency", "ratio")}


# ---- streams ----------------------------------------------------------------------------------------
SCHEMA = "id string, created_at timestamp, source string, value double"


def events(spark, *rows):
    return spark.createDataFrame(rows, "id string, t string, source string, value double").select(
        "id", F.to_timestamp("t").alias("created_at"), "source", "value"
    )


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_rows_are_dropped(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))

    def run():
        windows = streams.volume_by_window(stream(spark, folder), "1 hour", delay="1 hour")
        return {r.window_start.hour: r.quotes for r in streams.run_to_table(windows, out, checkpoint).collect()}

    events(spark, ("a", "2024-01-01 00:10:00", "s", 1.0), ("b", "2024-01-01 05:00:00", "s", 1.0)).coalesce(1).write.mode("append").parquet(folder)
    assert run() == {0: 1}
    events(spark, ("late", "2024-01-01 00:18:00", "s", 1.0), ("c", "2024-01-01 09:00:00", "s", 1.0)).coalesce(1).write.mode("append").parquet(folder)
    assert run() == {0: 1, 5: 1}


def test_deduplicate_across_files(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for _ in range(3):
        events(spark, ("a", "2024-01-01 00:10:00", "s", 1.0), ("b", "2024-01-01 00:20:00", "s", 1.0)).write.mode("append").parquet(folder)
    out = streams.run_to_table(streams.deduplicate(stream(spark, folder)), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.id for r in out.collect()) == ["a", "b"]


def test_stream_store_survives_a_replay(spark, raw_policies, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/store"
    raw_policies.withColumn("created_at", F.to_timestamp(F.lit("2024-01-01"))).repartition(3).write.parquet(folder)
    source = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    prepared = engineer_features(source, NUMERIC_DEFAULTS, CATEGORICAL_DEFAULTS, batch_defaults=False)
    scored = pricing.calculate_premium(prepared, F.lit(0.2), F.lit(900.0), baselines=FIXED)
    for checkpoint in ("cp1", "cp2"):  # a lost checkpoint starts again at batch 0
        query = streams.store_quotes(scored, root, f"{tmp_path}/{checkpoint}", consent=F.col("IDpol") <= 5, available_now=True)
        query.awaitTermination()
    assert store.read_table(spark, root, "quotes").count() == 30
    assert store.read_table(spark, root, "training_data").count() == 5


def test_outcome_matching(spark, tmp_path):
    quotes, outcomes = f"{tmp_path}/q", f"{tmp_path}/o"
    events(
        spark, ("u1", "2024-01-01 01:59:00", "q", 1.0), ("u2", "2024-01-01 01:00:00", "q", 2.0),
        ("u1", "2024-01-01 03:30:00", "q", 3.0), ("u9", "2024-01-02 00:00:00", "q", 9.0),
    ).coalesce(1).write.parquet(quotes)
    events(
        spark, ("u1", "2024-01-01 03:59:00", "o", 0.0), ("u2", "2024-01-01 03:00:01", "o", 0.0), ("u9", "2024-01-02 00:00:00", "o", 0.0),
    ).coalesce(1).write.parquet(outcomes)
    bought = stream(spark, outcomes).select("id", "created_at", F.lit(True).alias("bought"))
    matched = streams.match_outcomes(stream(spark, quotes).select("id", "created_at", "value"), bought, "id")
    rows = streams.run_to_table(matched, f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert sorted((r.value, r.bought) for r in rows if r.bought) == [(1.0, True), (3.0, True), (9.0, True)]
    assert [r.value for r in rows if not r.bought] == [2.0]


def test_sessions(spark, tmp_path):
    rows = [("u", f"2024-01-01 0{h}:{m:02d}:00", "s", 1.0) for h, m in ((1, 0), (1, 20), (3, 0), (9, 0))]
    events(spark, *rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    sessions = streams.quoting_sessions(stream(spark, f"{tmp_path}/in"), "id")
    out = streams.run_to_table(sessions, f"{tmp_path}/out", f"{tmp_path}/cp").orderBy("session_start").collect()
    assert [r.quotes for r in out] == [2, 1]


def test_one_row_per_quote_with_its_first_outcome(spark, tmp_path):
    quotes, outcomes = f"{tmp_path}/q", f"{tmp_path}/o"
    busy = [("u1", f"2024-01-01 01:{m:02d}:00", "q", float(m)) for m in range(0, 60, 2)]
    bought = [("u1", f"2024-01-01 0{h}:{m:02d}:00", "o", 60.0 * h + m) for h in (1, 2, 3, 4) for m in range(1, 60, 4)]
    late = [("u9", "2024-01-03 00:00:00", "q", -1.0)]
    events(spark, *busy, ("u2", "2024-01-01 01:00:00", "q", 500.0), *late).coalesce(1).write.parquet(quotes)
    events(spark, *bought, ("u2", "2024-01-01 00:59:59", "o", 1.0), ("u2", "2024-01-01 03:00:01", "o", 2.0), *late).coalesce(1).write.parquet(outcomes)
    left, right = (stream(spark, p).select("id", "created_at", "value") for p in (quotes, outcomes))
    matched = streams.first_outcomes(left, right, "id", outcome_id="value")
    rows = [r for r in streams.run_to_table(matched, f"{tmp_path}/out", f"{tmp_path}/cp").collect() if r.value >= 0]
    times = [60 * h + m for h in (1, 2, 3, 4) for m in range(1, 60, 4)]
    for row in rows:
        if row.id == "u2":
            assert (row.first_outcome, row.outcomes) == (None, 0)
        else:
            after = [t for t in times if 60 + row.value <= t <= 180 + row.value]
            assert (row.first_outcome, row.outcomes) == (min(after), len(after))
    assert sorted(r.value for r in rows) == sorted([float(m) for m in range(0, 60, 2)] + [500.0])


def test_late_rows_are_dropped_once_the_watermark_has_passed(spark, tmp_path):
    folder = f"{tmp_path}/in"
    events(spark, ("a", "2024-01-01 10:00:00", "s", 1.0), ("b", "2024-01-05 00:00:00", "s", 1.0)).coalesce(1).write.parquet(folder)
    daily = streams.volume_by_window(stream(spark, folder))
    first = streams.run_to_table(daily, f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert [r.quotes for r in first] == [1]
    events(spark, ("late", "2024-01-01 11:00:00", "s", 1.0), ("c", "2024-01-09 00:00:00", "s", 1.0)).coalesce(1).write.mode("append").parquet(folder)
    again = streams.run_to_table(streams.volume_by_window(stream(spark, folder)), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert sorted((str(r.window_start)[:10], r.quotes) for r in again) == [("2024-01-01", 1), ("2024-01-05", 1)]


def test_median_drift_of_merged_windows(spark, tmp_path):
    rows = [(f"p{d}-{i}", f"2024-01-{d:02d} 0{i % 9}:00:00", "s", float(i * d)) for d in (1, 2, 20) for i in range(1, 60)]
    events(spark, *rows, ("z", "2024-03-01 00:00:00", "s", 1.0)).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = stream(spark, f"{tmp_path}/in").withColumn("predicted", F.when(F.col("id") != "p1-1", 30.0))
    sketches = streams.run_to_table(streams.windowed_ratio_sketches(source, "value", "predicted"), f"{tmp_path}/out", f"{tmp_path}/cp")
    daily = {str(r.period_start)[:10]: r for r in streams.drift_of_sketches(sketches).collect()}
    assert [daily[d].matched for d in ("2024-01-01", "2024-01-02", "2024-01-20")] == [58, 59, 59]
    assert daily["2024-01-02"].median_ratio == 2.0 and daily["2024-01-02"].status == "under_predicted"
    month = streams.drift_of_sketches(sketches, "month").collect()
    everything = sorted(r[3] / 30 for r in rows if r[0] != "p1-1")
    assert len(month) == 1 and month[0].matched == 176 and month[0].median_ratio == everything[87]
