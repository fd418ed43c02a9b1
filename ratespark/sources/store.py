"""The quote, training and portfolio tables (Parquet under one root folder).

Every write belongs to a batch id and replaces just that batch's partitions, so a repeated write
after a failure cannot duplicate rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OUTCOME_COLUMNS, RATING_COLUMNS, RESULT_COLUMNS
from ..functions.cleaning import to_number
from ..schemas import TABLES, conform
from .readers import read_csv_text

# Below the batch id, which is always the outermost folder.
PARTITIONS = {"quotes": "created_date", "training_data": "created_date", "b2b_portfolios": "portfolio_name"}


def payload(df: DataFrame, columns: list[str]) -> list[Column]:
    """The named columns only, in lower case; absent ones are null."""
    present = {name.lower(): name for name in df.columns}
    return [
        (F.col(f"`{present[c.lower()]}`") if c.lower() in present else F.lit(None)).alias(c.lower()) for c in columns
    ]


def quote_rows(scored: DataFrame, source: str | Column = "single", consent: bool | Column = False) -> DataFrame:
    """Anonymised quotes: rating factors and results, id and time added when absent."""
    def given(name: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(name), otherwise) if name in scored.columns else otherwise

    return scored.select(
        given("id", F.uuid()).alias("id"),
        given("created_at", F.current_timestamp()).alias("created_at"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        (F.lit(consent) if isinstance(consent, bool) else F.coalesce(consent, F.lit(False))).alias("consent"),
        *payload(scored, [*RATING_COLUMNS, *RESULT_COLUMNS]),
    )


def write_table(df: DataFrame, root: str, table: str, batch_id: str) -> None:
    """Write one batch of a table into its own folder; writing the same batch again replaces the folder as a whole.

    Dates and ids made anew by the second attempt therefore cannot leave rows of the first behind.
    """
    inner = PARTITIONS[table]
    stamped = df.withColumn("batch_id", F.lit(batch_id))
    if inner == "created_date":
        stamped = stamped.withColumn(inner, F.to_date("created_at"))
    # Rows of one folder are brought together, or each task would leave a file in every folder;
    # adaptive execution splits a folder that is too large for one task.
    gathered = conform(stamped, TABLES[table]).drop("batch_id").hint("rebalance", inner)
    gathered.write.mode("overwrite").partitionBy(inner).parquet(_batch_path(root, table, batch_id))


def _batch_path(root: str, table: str, batch_id: str) -> str:
    return f"{root}/{table}/batch_id={batch_id}"


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table under its declared schema: older files lack newer columns and show nulls."""
    return spark.read.schema(TABLES[table]).parquet(f"{root}/{table}")


def read_batch(spark: SparkSession, root: str, table: str, batch_id: str) -> DataFrame:
    """One batch, found by its own path: nothing else of the table is listed."""
    reader = spark.read.schema(TABLES[table]).option("basePath", f"{root}/{table}")
    return reader.parquet(_batch_path(root, table, batch_id))


def save_quotes(
    scored: DataFrame, root: str, source: str | Column = "single", consent: bool | Column = False,
    batch_id: str | None = None,
) -> str:
    """Append to quotes, and the consented ones to training data. Returns the batch id.

    Training rows are read back from the stored quotes: both tables then hold the same ids and
    the scoring plan runs once.
    """
    batch = batch_id or uuid.uuid4().hex
    write_table(quote_rows(scored, source, consent), root, "quotes", batch)
    write_table(consented(read_batch(scored.sparkSession, root, "quotes", batch)), root, "training_data", batch)
    return batch


def consented(quotes: DataFrame) -> DataFrame:
    return quotes.where(F.col("consent"))


def b2b_rows(df: DataFrame, portfolio_name: str = "untitled") -> DataFrame:
    """Insured policies with outcomes; a missing claim flag counts as no claim."""
    columns = payload(df, [*RATING_COLUMNS, *OUTCOME_COLUMNS, *RESULT_COLUMNS])
    return df.select(
        F.uuid().alias("id"), F.current_timestamp().alias("created_at"), *columns,
        F.lit(portfolio_name).alias("portfolio_name"), F.lit("single").alias("source"), F.lit(False).alias("consent"),
    ).withColumn("claim_occurred", F.coalesce(F.col("claim_occurred").try_cast("boolean"), F.lit(False)))


def save_b2b_portfolio(df: DataFrame, root: str, portfolio_name: str = "untitled", batch_id: str | None = None) -> str:
    batch = batch_id or uuid.uuid4().hex
    write_table(b2b_rows(df, portfolio_name), root, "b2b_portfolios", batch)
    return batch


def ingest_quotes_csv(spark: SparkSession, path: str, root: str) -> str:
    """Backfill quotes from a CSV of scored policies."""
    numbers = [*RATING_COLUMNS, *RESULT_COLUMNS]
    return save_quotes(_numeric(read_csv_text(spark, path), numbers), root, source="backfill")


def ingest_b2b_csv(spark: SparkSession, path: str, root: str, portfolio_name: str) -> str:
    """Load an insurer's portfolio CSV."""
    numbers = [*RATING_COLUMNS, "claim_amount", "premium_paid"]
    return save_b2b_portfolio(_numeric(read_csv_text(spark, path), numbers), root, portfolio_name)


def _numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in TABLES["quotes"].fields}
    return df.withColumns({
        c: to_number(c) for c in columns if c in df.columns and kinds[c.lower()] == "double"
    })


def recent_quotes(quotes: DataFrame, limit: int = 5000) -> DataFrame:
    """The newest quotes (ties by id)."""
    return quotes.orderBy(F.desc("created_at"), "id").limit(limit)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def fetch_training_data(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in ("training_data", "b2b_portfolios")}
