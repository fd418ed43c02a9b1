"""File readers. Everything is read as text by header name and coerced later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..config import CLAIM_AMOUNT, CLAIM_COUNT, FREQUENCY_COLUMNS, POLICY_ID, RATED_NUMERIC, SEVERITY_COLUMNS
from ..operators.ranking import with_file_lines
from ..operators.validate import require_pricing_columns, validate_schema
from ..schemas import BATCH_REQUEST

CORRUPT = "_corrupt_record"

# --- Fixed values: texts that a CSV reader takes as missing ---------------------------------------
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv_text(spark: SparkSession, path: str, sep: str = ",", keep_corrupt: bool = False) -> DataFrame:
    """All columns as strings under their header names; no inference pass over the data.

    Headers of all files must agree. ``keep_corrupt`` adds the raw text of malformed rows.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("enforceSchema", False)
    names = reader.csv(path).columns  # looks at one header line only
    fields = [T.StructField(name, T.StringType()) for name in names]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
        # Only a row parsed in full shows whether it is malformed.
        reader = reader.option("columnPruning", False)
    frame = (
        reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .schema(T.StructType(fields)).csv(path)
    )
    return frame.withColumns({
        name: F.when(~F.col(f"`{name}`").isin(MISSING_TEXTS), F.col(f"`{name}`")) for name in names
    })


def load_frequency_data(spark: SparkSession, path: str) -> DataFrame:
    """Policy table, checked: columns there, numbers coercible, nothing missing."""
    df = read_csv_text(spark, path)
    validate_schema(df, "Frequency dataset", FREQUENCY_COLUMNS, [POLICY_ID, CLAIM_COUNT, *RATED_NUMERIC])
    return df


def load_severity_data(spark: SparkSession, path: str) -> DataFrame:
    """Claim table, checked like the policy table."""
    df = read_csv_text(spark, path)
    validate_schema(df, "Severity dataset", SEVERITY_COLUMNS, [POLICY_ID, CLAIM_AMOUNT])
    return df


def split_malformed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, malformed rows) of a frame read with ``keep_corrupt``.

    The test also looks at a data column, because the CSV source refuses queries on the raw text
    column alone.
    """
    first = F.col(f"`{raw.columns[0]}`")
    malformed = F.length(F.concat_ws("|", first, CORRUPT)) > F.length(F.concat_ws("|", first))
    return raw.where(~malformed).drop(CORRUPT), raw.where(malformed)


def read_scoring_csv(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(policies to score, malformed rows) of a batch or scenario input."""
    raw = read_csv_text(spark, path, sep, keep_corrupt=True)
    require_pricing_columns(raw)
    return split_malformed(raw)


def read_dutch_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_text(spark, path)


def read_spanish_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_text(spark, path, sep=";")


def explode_requests(requests: DataFrame) -> DataFrame:
    """One row per policy of the batch requests, each with its request's consent.

    A request without policies fails the query when its row is reached, as it is an error of the sender.
    """
    filled = F.when(F.size("policies") > 0, F.col("policies")).otherwise(
        F.raise_error(F.lit("A batch request needs at least one policy."))
    )
    return requests.withColumn("policies", filled).select(
        F.coalesce("consent", F.lit(False)).alias("consent"), F.explode("policies").alias("policy")
    ).select("policy.*", "consent")


def read_batch_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON requests ``{"policies": [...], "consent": ...}``, one document per line."""
    return explode_requests(spark.read.schema(BATCH_REQUEST).json(path))


def read_comparison_runs(spark: SparkSession, path: str) -> DataFrame:
    """JSON result documents of model comparisons, one per file, in a column ``payload``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def file_versions(spark: SparkSession, path: str) -> DataFrame:
    """(path, exists, size_bytes, modified_utc, fingerprint) per input file, for files of any size.

    The fingerprint is the digest of :func:`file_digests`, so a file is hashed in pieces by many tasks. A path without files gives one row with ``exists``
    false.
    """
    try:
        # The listing only: no content is read for these columns.
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
        present = not files.isEmpty()
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem.getCondition()):
            raise
        present = False
    if not present:
        return spark.createDataFrame([(path, False)], "path string, exists boolean").select(
            "path", "exists", F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_utc"),
            F.lit(None).cast("string").alias("fingerprint"),
        )
    listing = files.select(
        "path", F.lit(True).alias("exists"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_utc")
    )
    hashed = file_digests(spark, path).select("path", F.col("digest").alias("fingerprint"))
    return listing.join(hashed, "path", "left")


#: Rows of a file under one digest of the tree.
TREE_WIDTH = 4096
def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines, digest): SHA-256 of each text file's lines in their order, as a hash tree.

    Each line has a digest; the digests of ``TREE_WIDTH`` lines that follow one another make one digest, and so on until
    one is left, so any change, insertion or swap of lines changes it, whatever blocks the file is read in. Lines end at a
    line feed; whether the last one does is not seen. No task holds more than ``TREE_WIDTH`` digests, and no line leaves its
    task. An empty file has no lines and no row.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    level = with_file_lines(lines, rows_alias="lines").select(
        F.col("__file").alias("path"), "lines", (F.col("line") - F.lit(1)).alias("spot"), F.sha2("value", 256).alias("digest")
    )
    # The longest file's lines, counted without hashing or numbering them.
    counts = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    width = counts.agg(F.max("lines")).first()[0] or 0
    while width > 1:
        level = _tree_level(level)
        width = -(-width // TREE_WIDTH)
    return level.select("path", "lines", "digest")


def _tree_level(level: DataFrame) -> DataFrame:
    """The digests of runs of ``TREE_WIDTH`` digests; a run of one stays as it is."""
    runs = level.groupBy("path", "lines", F.floor(F.col("spot") / F.lit(TREE_WIDTH)).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("spot", "digest"))).alias("members")
    )
    joined = F.sha2(F.array_join(F.col("members.digest"), ""), 256)
    digest = F.when(F.size("members") == 1, F.col("members.digest")[0]).otherwise(joined)
    return runs.select("path", "lines", F.col("run").alias("spot"), digest.alias("digest"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): order-independent content hash of a table of any size."""
    hashes = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), hashes.alias("fingerprint"))
