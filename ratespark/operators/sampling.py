"""Seeded samples and train/test splits that do not depend on partitioning.

A row's place is its md5 of (key, seed), so the same rows are chosen on any cluster and by any
engine. An exact number of rows is reached through a cutoff hash per stratum: the frame is then
filtered in place, and no task ever gathers the sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RANDOM_SEED, TEST_SIZE
from ..functions.rating import md5_order

BINS = 1 << 16
#: Strata whose cutoffs are written into the expression that chooses a row; more of them stay a table.
FEW_STRATA = 64


def hash_share(order: Column) -> Column:
    """A uniform number in [0, 1) from the first 12 hex digits of an md5."""
    return F.conv(F.substring(order, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def hash_split(
    df: DataFrame, key: Column, test_size: float = TEST_SIZE, seed: int = RANDOM_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash alone: no job, and a row keeps its side when the data grows."""
    is_test = hash_share(md5_order(key, seed)) < F.lit(float(test_size))
    return df.where(~is_test), df.where(is_test)


def hash_cutoffs(
    df: DataFrame, key: Column, quota: Callable[[Column], Column], by: str | None = None, seed: int = RANDOM_SEED
) -> DataFrame:
    """(__stratum, __cutoff): the hash up to which exactly ``quota(rows)`` rows of the stratum lie.

    Rows are counted by stratum and hash bin before anything moves; running sums over the bins name the one bin that
    holds a stratum's cutoff, and only that bin's rows, one in ``BINS``, are ranked. A stratum with quota 0 has no row.
    """
    keyed = _keyed(df, key, by, seed)
    near = keyed.join(_cuts(keyed, quota), F.col("__stratum").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b")))
    return _ranked(near)


def _keyed(df: DataFrame, key: Column, by: str | None, seed: int) -> DataFrame:
    stratum = F.col(by) if by else F.lit(0)
    order = md5_order(key, seed)
    return df.select(
        stratum.alias("__stratum"), order.alias("__order"), F.floor(hash_share(order) * BINS).cast("int").alias("__bin")
    )


def _cuts(keyed: DataFrame, quota: Callable[[Column], Column]) -> DataFrame:
    """(__s, __b, __rank): the bin that holds a stratum's cutoff, and the cutoff's rank in it."""
    counts = keyed.groupBy("__stratum", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__stratum")
    upto = F.sum("__n").over(whole.orderBy("__bin"))
    placed = counts.withColumns({"__before": upto - F.col("__n"), "__rows": F.sum("__n").over(whole)})
    rank = F.least(quota(F.col("__rows")), F.col("__rows")) - F.col("__before")
    return placed.withColumn("__rank", rank).where("__rank > 0 AND __rank <= __n").select(
        F.col("__stratum").alias("__s"), F.col("__bin").alias("__b"), "__rank"
    )


def _ranked(near: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("__stratum").orderBy("__order"))
    ranked = near.withColumn("__at", at).where(F.col("__at") == F.col("__rank"))
    return ranked.select("__stratum", F.col("__order").alias("__cutoff"))


def _few_cutoffs(df: DataFrame, key: Column, quota: Callable[[Column], Column], by: str, seed: int) -> Column | None:
    """The cutoff of a row's stratum as an expression, or None when there are more strata than ``FEW_STRATA``.

    A join brings all rows of a stratum to one task, so two strata would leave two tasks for the whole table. Here no row moves
    but those of the bins that hold the cutoffs.
    """
    keyed = _keyed(df, key, by, seed)
    if not isinstance(keyed.schema["__stratum"].dataType, (T.IntegralType, T.StringType, T.BooleanType)):
        return None
    cuts = _cuts(keyed, quota).limit(FEW_STRATA + 1).collect()
    if len(cuts) > FEW_STRATA:
        return None
    rank = F.lit(None).cast("long")
    for stratum, place, wanted in cuts:
        rank = F.when(F.col("__stratum").eqNullSafe(F.lit(stratum)) & (F.col("__bin") == F.lit(place)), F.lit(wanted)).otherwise(rank)
    cutoff = F.lit(None).cast("string")
    for stratum, limit in _ranked(keyed.withColumn("__rank", rank).where("__rank IS NOT NULL")).collect():
        cutoff = F.when(F.col(by).eqNullSafe(F.lit(stratum)), F.lit(limit)).otherwise(cutoff)
    return cutoff


def _chosen(df: DataFrame, key: Column, quota: Callable[[Column], Column], by: str | None, seed: int) -> DataFrame:
    """``df`` with ``__chosen``."""
    if by is None:
        joined = df.join(F.broadcast(hash_cutoffs(df, key, quota, by, seed)), F.lit(True), "left")  # one row at most
    elif (cutoff := _few_cutoffs(df, key, quota, by, seed)) is not None:
        joined = df.withColumn("__cutoff", cutoff)
    else:
        joined = df.join(hash_cutoffs(df, key, quota, by, seed), F.col(by).eqNullSafe(F.col("__stratum")), "left")
    chosen = F.coalesce(md5_order(key, seed) <= F.col("__cutoff"), F.lit(False))
    return joined.withColumn("__chosen", chosen).drop("__stratum", "__cutoff")


def sample_size(rows: Column, fraction: float, max_rows: int) -> Column:
    """The smallest of all rows, the wanted share (at least one row) and the limit; zero switches a limit off."""
    limits = [rows]
    if 0.0 < fraction < 1.0:
        limits.append(F.greatest(F.floor(rows * fraction), F.lit(1)))
    if max_rows > 0:
        limits.append(F.lit(max_rows))
    return F.least(*limits) if len(limits) > 1 else rows


def experiment_sample(
    df: DataFrame, key: Column, fraction: float, max_rows: int, seed: int = RANDOM_SEED
) -> DataFrame:
    """The model-comparison sample: a fraction of the rows under an upper limit.

    ``key`` must tell rows apart; then the number of rows is exact.
    """
    chosen = _chosen(df, key, lambda rows: sample_size(rows, fraction, max_rows), None, seed)
    return chosen.where("__chosen").drop("__chosen")


def seeded_sample(df: DataFrame, key: Column, n: int, seed: int = RANDOM_SEED) -> DataFrame:
    """``n`` rows without replacement, or all of them when there are fewer."""
    return experiment_sample(df, key, 0.0, n, seed)


def stratified_split_labels(
    df: DataFrame, key: Column, stratum: str, test_size: float = TEST_SIZE, seed: int = RANDOM_SEED
) -> DataFrame:
    """Add ``is_test``: exactly ceil(test_size x rows) of every stratum."""
    wanted = lambda rows: F.ceil(F.round(rows * test_size, 9))
    return _chosen(df, key, wanted, stratum, seed).withColumnRenamed("__chosen", "is_test")


def stratified_split(
    df: DataFrame, key: Column, stratum: str, test_size: float = TEST_SIZE, seed: int = RANDOM_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the same share of every stratum."""
    labelled = stratified_split_labels(df, key, stratum, test_size, seed)
    return labelled.where(~F.col("is_test")).drop("is_test"), labelled.where("is_test").drop("is_test")
