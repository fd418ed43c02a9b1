"""Mixing sources to target weights by weighted random order without replacement.

Every document gets the key -ln(u) / w of Efraimidis and Spirakis, u from its id and w its quality weight; ascending keys
give a weighted random order. A source whose target is e whole epochs and a rest gives every document e times and the
first documents of that order once more, up to the rest. Keys are folded into buckets, sizes are summed by bucket before
they move, and only the bucket in which a source's rest ends is put in exact order, so no task holds a whole source.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, last; a null id draws like
the id -1; repeated rows are documents of their own; an empty table gives an empty result. A source of no words has
target 0. The rest ends at the document whose inclusion comes nearest to it, so a source misses its target by at most
half of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratespark.llm.quality import symbol_count
from ratespark.llm.text import count_words, stored

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
BUCKETS = 1 << 16
#: Parts of a source when its documents meet its plan, so that no source is one join key.
SALTS = 64


def uniform(doc_id: Column, seed: int) -> Column:
    """A number inside (0, 1) from the id, the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-1"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain text, down to 0.1 as symbols approach one per word."""
    return F.greatest(F.lit(0.1), 1 - symbol_count(text) / F.greatest(size, F.lit(1)))


def source_targets(sources: DataFrame, weights: tuple = SOURCE_WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``source``, ``source_size`` with ``target``: the share of all words by weight, at most ``most`` times the size.

    Sources by code point take the weights in turn. What a full source leaves goes to the others by weight; ordered by
    the level at which they fill up, the sources that are full form a prefix, so one pass of running sums finds it.
    One row per source passes through these windows.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight.cast("double"))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= most * F.col("source_size"))
    # The first source that isn't full sets the level of all that follow it.
    final = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, 0)
    )
    target = F.when(final.isNull(), F.col("source_size") * float(most)).otherwise(final * F.col("weight"))
    return levels.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(rows: DataFrame, seed: int = 17, **rules) -> DataFrame:
    """``rows`` (``source``, ``size``, ``doc_id``, ``weight`` and any others) with ``source_size``, ``target``, ``copies``.

    ``copies`` is how often the mix takes the document. ``rows`` is read three times, so it should be a stored table.
    """
    bucket = F.least((F.lit(BUCKETS) * (1 - F.pow(uniform(F.col("doc_id"), seed), 1 / F.col("weight")))).cast("int"), F.lit(BUCKETS - 1))
    keyed = rows.withColumn("__key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("weight")).withColumn("__bucket", bucket)
    sums = keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), **rules)
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("target") - F.col("__epochs") * F.col("source_size")
    cuts = (
        sums.withColumn("__before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(_renamed(targets, "source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        .withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("__rest", rest)
        .where((F.col("__before") <= F.col("__rest")) & (F.col("__before") + F.col("words") > F.col("__rest")))
        .groupBy("source").agg(F.min(F.struct("__bucket", "__before")).alias("__cut"))
    )
    plan = (
        targets.join(_renamed(cuts, "source"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        .withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("__rest", rest)
    )
    copies = _renamed(plan, "source").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    part = F.col("__bucket") % SALTS
    placed = keyed.join(copies, F.col("source").eqNullSafe(F.col("__source")) & (part == F.col("__salt"))).drop("__source", "__salt")
    at = F.col("__bucket") - F.coalesce(F.col("__cut.__bucket"), F.lit(BUCKETS))
    within = Window.partitionBy("source").orderBy("__key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ends = placed.where(at == 0).withColumn("__sum", F.col("__cut.__before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    once_more = F.col("__sum") + F.col("size") / 2 <= F.col("__rest")
    ends = ends.withColumn("__more", F.when(once_more, 1).otherwise(0)).drop("__sum")
    others = placed.where(at != 0).withColumn("__more", F.when(at < 0, 1).otherwise(0))
    taken = F.when(F.col("size") > 0, F.col("__epochs") + F.when(F.col("__rest") > 0, F.col("__more")).otherwise(0)).otherwise(0)
    kept = [c for c in rows.columns if c not in ("source_size", "target", "copies")]
    return others.unionByName(ends).select(*kept, "source_size", "target", taken.cast("int").alias("copies"))


def _renamed(df: DataFrame, name: str) -> DataFrame:
    return df.withColumnRenamed(name, f"__{name}")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The narrow rows that ``mix`` works on, stored once so that the texts are read once."""
    size = count_words(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.col(text).alias("__text"))
    return stored(rows.select("doc_id", "source", "size", quality_weight(F.col("__text"), F.col("size")).alias("weight")))


def mixture(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken words for every row."""
    return mix(sized(docs), seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def take_mixture(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: left out, once or repeated, with their columns as they came.

    Copies are decided per id, so rows that repeat an id with the same size share one decision.
    """
    copies = mix(sized(docs), seed).where("copies > 0").groupBy("doc_id", "size").agg(F.max("copies").alias("__copies"))
    copies = copies.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), "__copies")
    numbered = docs.withColumn("__words", count_words(F.col("text")))
    joined = numbered.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(docs[c] for c in docs.columns))
