"""Quote streams: scoring, de-duplication, storage, outcome matching and monitoring.

All operators but the sink are plain DataFrame functions, so the same code runs on a batch
backfill. Defaults and baselines must come from metadata: a stream has no batch to average.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import PricingConfig
from ..operators.drift import ratio_status
from ..operators.features import build_inference_frame
from ..operators.pricing import calculate_premium
from ..sources.store import consented, quote_rows, read_batch, write_table

EVENT_TIME = "created_at"


def read_parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, name_glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name_glob).parquet(folder)


def read_kafka_requests(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON quote requests from Kafka (needs the Kafka connector on the cluster)."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    )
    parsed = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), "timestamp")
    return parsed.select("r.*", F.col("timestamp").alias(EVENT_TIME))


def with_event_time(df: DataFrame, column: str) -> DataFrame:
    """``created_at`` as a time-zoned timestamp, which watermarks require."""
    return df.withColumn(EVENT_TIME, F.col(column).cast("timestamp"))


def score_stream(
    requests: DataFrame,
    frequency_model,
    severity_model,
    metadata: Mapping,
    config: PricingConfig = PricingConfig(),
) -> DataFrame:
    """Features, both models and premiums, all stateless."""
    prepared = build_inference_frame(
        requests, metadata, check_rows=False, check_values=False, batch_defaults=False, missing_ids="hash"
    )
    scored = severity_model.transform(frequency_model.transform(prepared))
    return calculate_premium(
        scored, "predicted_annual_frequency", "predicted_claim_severity", config,
        metadata.get("risk_thresholds"), metadata["portfolio_baselines"],
    )


def deduplicate(quotes: DataFrame, key: str = "id", delay: str = "1 hour", salts: int = 8) -> DataFrame:
    """First copy of each id; copies must arrive within ``delay``, which bounds the state.

    Copies are first thinned out per (id, salt), so that a much repeated id is worked off by
    ``salts`` tasks and the last step sees at most that many copies of it.
    """
    stamped = quotes.withWatermark(EVENT_TIME, delay)
    if salts > 1:
        salted = stamped.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        stamped = salted.dropDuplicatesWithinWatermark([key, "__salt"]).drop("__salt")
    return stamped.dropDuplicatesWithinWatermark([key])


def store_quotes(
    scored: DataFrame, root: str, checkpoint: str, source: str | Column = "stream",
    consent: bool | Column = False, available_now: bool = False,
) -> StreamingQuery:
    """Write every quote, and consented quotes to training data, exactly once per micro-batch.

    A micro-batch owns its ``batch_id`` folder in both tables: when it is replayed after a failure
    it replaces both folders, whichever of the two writes had been done and whatever the date.
    """
    def write(batch: DataFrame, number: int) -> None:
        name = f"stream-{number:012d}"
        write_table(quote_rows(batch, source, consent), root, "quotes", name)
        write_table(consented(read_batch(batch.sparkSession, root, "quotes", name)), root, "training_data", name)

    writer = scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def volume_by_window(
    quotes: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour", by: tuple[str, ...] = ("source",)
) -> DataFrame:
    """Quotes and mean value per (sliding) window; rows later than ``delay`` are dropped."""
    time_window = F.window(EVENT_TIME, window, slide) if slide else F.window(EVENT_TIME, window)
    return (
        quotes.withWatermark(EVENT_TIME, delay).groupBy(time_window.alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("quotes"), F.sum("value").alias("total_value"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "quotes", "total_value")
    )


def windowed_drift(
    matched: DataFrame, actual: str, predicted: str, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Actual over predicted per window, from sums (medians are not incremental)."""
    return (
        matched.withWatermark(EVENT_TIME, delay).groupBy(F.window(EVENT_TIME, window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("matched"), F.sum(actual).alias("actual_total"),
            F.sum(predicted).alias("predicted_total"),
        )
        .select(
            F.col("w.start").alias("window_start"), "matched",
            F.try_divide("actual_total", "predicted_total").alias("ratio"),
        )
    )


def match_outcomes(
    quotes: DataFrame, outcomes: DataFrame, key: str, within_seconds: int = 7200, delay: str = "1 hour"
) -> DataFrame:
    """Each quote with the outcomes of the same key in the time after it; none gives nulls.

    Both sides carry a watermark, so a quote leaves the state once its time span has passed.
    The join key includes a time slot as long as the span: a quote lies in one slot and an
    outcome is copied to the two slots whose quotes it can follow. Pairs still meet exactly
    once, and the history of a very active key is spread over many tasks.
    """
    def slot(column: str) -> Column:
        return F.floor(F.unix_seconds(column) / F.lit(within_seconds))

    left = quotes.withWatermark(EVENT_TIME, delay).withColumn("__slot", slot(EVENT_TIME)).alias("q")
    renamed = outcomes.withColumnRenamed(EVENT_TIME, "outcome_at").withColumnRenamed(key, "__key")
    right = renamed.withWatermark("outcome_at", delay).withColumn(
        "__outcome_slot", F.explode(F.array(slot("outcome_at") - F.lit(1), slot("outcome_at")))
    ).alias("o")
    condition = (
        (F.col(f"q.{key}") == F.col("o.__key"))
        & (F.col("q.__slot") == F.col("o.__outcome_slot"))
        & (F.col("o.outcome_at") >= F.col(f"q.{EVENT_TIME}"))
        & (F.col("o.outcome_at") <= F.col(f"q.{EVENT_TIME}") + F.expr(f"INTERVAL {within_seconds} SECONDS"))
    )
    return left.join(right, condition, "leftOuter").drop("__key", "__slot", "__outcome_slot")


def first_outcomes(
    quotes: DataFrame, outcomes: DataFrame, key: str, within_seconds: int = 7200, delay: str = "1 hour", outcome_id: str = "id"
) -> DataFrame:
    """One row per quote: its columns, the first outcome of the same key in the time after it, and how many there were.

    Two stateful steps follow each other. Outcomes are gathered per key and time slot under their watermark, so a slot
    of a very active key is one row with the sorted times; each outcome counts for the two slots whose quotes it can
    follow. A quote lies in one slot and so meets at most one such row: output and join state grow with the quotes and the
    outcomes, never with their product. Of outcomes at the same time the one with the smaller id is first. A quote
    without an outcome has a null outcome and zero. A slot's list holds one key's outcomes of twice ``within_seconds``.
    """
    span = F.expr(f"INTERVAL {within_seconds} SECONDS")
    size = f"{within_seconds} seconds"
    # an outcome belongs to the slot of its own time and to the one before
    copies = F.explode(F.array(F.col(EVENT_TIME), F.col(EVENT_TIME) - span))
    placed = outcomes.select(
        F.col(key).alias("__key"), F.struct(F.col(EVENT_TIME).alias("at"), F.col(outcome_id).alias("id")).alias("outcome"), copies.alias("__slot_time")
    )
    # the copies lag by the span, and so does their watermark
    gathered = (
        placed.withWatermark("__slot_time", f"{within_seconds + _seconds(delay)} seconds")
        .groupBy("__key", F.window("__slot_time", size).alias("__slot"))
        .agg(F.array_sort(F.collect_list("outcome")).alias("__outcomes"))
    )
    # a stream may have one event time: the slot's
    left = quotes.withColumn("__event", F.col(EVENT_TIME)).withWatermark("__event", delay).select(
        *quotes.columns, F.window("__event", size).alias("__quote_slot")
    )
    joined = left.join(gathered, (F.col(key).eqNullSafe(F.col("__key"))) & (F.col("__quote_slot") == F.col("__slot")), "leftOuter")
    after = F.filter("__outcomes", lambda o: (o["at"] >= F.col(EVENT_TIME)) & (o["at"] <= F.col(EVENT_TIME) + span))
    return joined.withColumn("__after", F.coalesce(after, F.array().cast(_list_type(outcomes, outcome_id)))).select(
        *quotes.columns, F.get("__after", F.lit(0))["id"].alias("first_outcome"), F.get("__after", F.lit(0))["at"].alias("first_outcome_at"),
        F.size("__after").alias("outcomes"),
    )


def _list_type(outcomes: DataFrame, outcome_id: str) -> T.ArrayType:
    """The type of a list of outcomes: their time and id."""
    fields = [T.StructField("at", outcomes.schema[EVENT_TIME].dataType), T.StructField("id", outcomes.schema[outcome_id].dataType)]
    return T.ArrayType(T.StructType(fields))


def _seconds(interval: str) -> int:
    """Seconds of an interval such as '1 hour'."""
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


#: Values that a window's sketch keeps at its widest level: medians are exact up to so many, beyond with a rank error of
#: about 2.3 / SKETCH_SIZE.
SKETCH_SIZE = 4096


def windowed_ratio_sketches(
    matched: DataFrame, actual: str, predicted: str, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """(window_start, sketch): a mergeable quantile sketch of actual / predicted per window, the whole state of a window."""
    ratio = F.try_divide(F.col(actual).cast("double"), F.nullif(F.col(predicted).cast("double"), F.lit(0.0)))
    return (
        matched.withColumn("__ratio", ratio).where(F.col("__ratio").isNotNull())
        .withWatermark(EVENT_TIME, delay).groupBy(F.window(EVENT_TIME, window).alias("w"))
        .agg(F.kll_sketch_agg_double("__ratio", SKETCH_SIZE).alias("sketch"))
        .select(F.col("w.start").alias("window_start"), "sketch")
    )


def drift_of_sketches(sketches: DataFrame, period: str = "day") -> DataFrame:
    """(period_start, matched, p10_ratio, median_ratio, p90_ratio, status) of the windows' merged sketches.

    ``period`` is a unit of ``date_trunc``; merging moves one sketch per window and task.
    """
    merged = sketches.groupBy(F.date_trunc(period, "window_start").alias("period_start")).agg(
        F.kll_merge_agg_double("sketch").alias("sketch")
    )
    at = {"p10_ratio": 0.1, "median_ratio": 0.5, "p90_ratio": 0.9}
    found = merged.select(
        "period_start", F.kll_sketch_get_n_double("sketch").alias("matched"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias(name) for name, share in at.items()],
    )
    return found.withColumn("status", ratio_status(F.col("median_ratio")))


def quoting_sessions(quotes: DataFrame, key: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of quotes per user, closed after ``gap`` without a quote."""
    return (
        quotes.withWatermark(EVENT_TIME, delay).groupBy(F.session_window(EVENT_TIME, gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("quotes"))
        .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "quotes")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available into a Parquet folder and return that folder's rows."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)

