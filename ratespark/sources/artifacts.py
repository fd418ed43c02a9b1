"""Model artifacts, run records and report files."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..operators.models import FREQUENCY, SEVERITY, FittedModel, load_model


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """One small JSON document, on whatever file system ``path`` names."""
    text = json.dumps(value, default=lambda o: asdict(o) if is_dataclass(o) else str(o))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_artifacts(
    spark: SparkSession, root: str, frequency: FittedModel, severity: FittedModel, metadata: dict, metrics: dict,
    options: DataFrame | None = None,
) -> None:
    """Both models, metadata, metrics and, as a table, the category options."""
    names = {"frequency_model": frequency.name, "severity_model": severity.name}
    frequency.save(f"{root}/frequency_model")
    severity.save(f"{root}/severity_model")
    write_json(spark, {**metadata, "fitted_models": names}, f"{root}/metadata")
    write_json(spark, metrics, f"{root}/metrics")
    if options is not None:
        options.write.mode("overwrite").parquet(f"{root}/categorical_options")


def load_options(spark: SparkSession, root: str) -> DataFrame:
    """(feature, option): the categories seen in training."""
    return spark.read.schema("feature string, option string").parquet(f"{root}/categorical_options")


def load_artifacts(spark: SparkSession, root: str) -> dict[str, Any]:
    """Both models, metadata and (when saved) metrics; FileNotFoundError when incomplete."""
    try:
        metadata = read_json(spark, f"{root}/metadata")
        names = metadata["fitted_models"]
        frequency = load_model(spark, FREQUENCY, names["frequency_model"], f"{root}/frequency_model")
        severity = load_model(spark, SEVERITY, names["severity_model"], f"{root}/severity_model")
    except Exception as problem:  # the reader's error class depends on which part is missing
        raise FileNotFoundError(f"No complete set of models under {root}.") from problem
    try:
        metrics = read_json(spark, f"{root}/metrics")
    except AnalysisException:
        metrics = {}
    return {
        "frequency_model": frequency,
        "severity_model": severity,
        "metadata": metadata,
        "metrics": metrics,
    }


RUN_SCHEMA = T.StructType([
    T.StructField(name, T.StringType())
    for name in (
        "run_id", "generated_at_utc", "model_parameters", "evaluation_metrics", "dataset_version",
        "dataset_summary", "data_quality", "pricing_config",
    )
])


def record_run(spark: SparkSession, runs_path: str, **sections: Any) -> str:
    """Append one row to the runs table; sections are stored as JSON text. Returns the run id."""
    now = datetime.now(timezone.utc)
    run_id = now.strftime("%Y%m%dT%H%M%SZ")
    values = [
        json.dumps(sections.get(f.name, {}), default=lambda o: asdict(o) if is_dataclass(o) else str(o))
        for f in RUN_SCHEMA.fields[2:]
    ]
    spark.createDataFrame([(run_id, now.isoformat(), *values)], RUN_SCHEMA).write.mode("append").parquet(runs_path)
    return run_id


def write_csv_report(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """CSV with header; ``decimals`` rounds the floating-point columns."""
    if decimals is not None:
        df = df.withColumns({
            f.name: F.round(f.name, decimals) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
        })
    df.write.mode("overwrite").option("header", True).csv(path)
