"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut into 2^bits steps: categories by their share of the rows in code point order, sizes by logarithm.
Rows are ordered by the index of their cell on the curve and cut into runs of equal row counts, so each file covers a
compact box of every dimension and readers can skip files by minimum and maximum.

The order needs no global sort. Rows are counted by cell, and inside a cell by the leading bits of a hash of the id; two
running sums over these counts give each fold its first place, and only rows of one fold are sorted together. A cell that
holds a third of all rows is spread over all of its folds.

Defined cases: a null dimension is a category of its own, last; a null text has no bytes; a null id is ordered last in
fold 0; rows alike in everything take neighbouring places in any order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ("source", "lang")
BITS = 5
#: Folds of one cell: the rows of a fold are sorted in one task.
FOLDS = 1 << 12
SHARDS = 24


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve through the grid of ``len(axes)`` dimensions with 2^bits steps each.

    From the highest bit down, each axis whose bit is set turns the lower bits of the first axis over, and each other
    axis swaps its lower bits with the first's; the Gray code of the result, undone, is read bit by bit across the axes.
    One fold over (bit, axis) keeps the coordinates in an array, so the expression stays small.
    """
    n = len(axes)
    steps = F.array(*(F.struct(F.lit(1 << b).alias("bit"), F.lit(a).alias("axis")) for b in range(bits - 1, 0, -1) for a in range(n)))

    def turn(x: Column, step: Column) -> Column:
        low = step["bit"] - 1
        mine, first = F.get(x, step["axis"]), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(mine).bitwiseAND(low)
        flipped = F.transform(x, lambda v, i: F.when(i == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(
            x, lambda v, i: F.when((i == 0) & (step["axis"] != 0), v.bitwiseXOR(swap))
            .when((i == step["axis"]) & (i != 0), v.bitwiseXOR(swap)).otherwise(v)
        )
        return F.when(mine.bitwiseAND(step["bit"]) != 0, flipped).otherwise(swapped)

    def gray(x: Column) -> Column:
        running = F.aggregate(x, F.array().cast("array<int>"), lambda a, v: F.array_append(
            a, v.bitwiseXOR(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))
        return running

    def interleaved(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        turned = F.aggregate(
            F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), F.lit(0),
            lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )
        order = F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(a).alias("axis")) for b in range(bits - 1, -1, -1) for a in range(n)))

        def place(t: Column) -> Column:
            return F.aggregate(order, F.lit(0).cast("long"), lambda out, step: out * 2 + F.get(x, step["axis"]).bitwiseXOR(t)
                               .bitwiseAND(F.element_at(powers, step["bit"] + 1)).cast("boolean").cast("long"))

        powers = F.array(*(F.lit(1 << b) for b in range(bits)))
        return F.get(F.transform(F.array(turned), place), F.lit(0))

    start = F.array(*(axis.cast("int") for axis in axes))
    turned = F.aggregate(steps, start, turn)
    return F.get(F.transform(F.transform(F.array(turned), gray), interleaved), F.lit(0))


def category_steps(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """Each value of ``column`` with its step: the share of rows before it, in code point order, times 2^bits."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col(column).asc_nulls_last())
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = F.floor(before * (1 << bits) / F.sum("n").over(Window.partitionBy()))
    return counts.select(F.col(column).alias("__value"), step.cast("int").alias(f"__step_{column}"))


def size_step(size: Column, bits: int) -> Column:
    """Logarithm of the size in steps; 2^22 bytes and more share the last."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1))) * ((1 << bits) / 22)).cast("int"), F.lit((1 << bits) - 1))


def hilbert_shards(
    rows: DataFrame, shards: int = SHARDS, size: str = "size", doc_id: str = "doc_id",
    categories: tuple[str, ...] = CATEGORIES, bits: int = BITS,
) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the gapless place inside the shard; shards differ by one row at most."""
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    celled = rows
    for column in categories:
        steps = category_steps(rows, column, bits)
        celled = celled.join(steps, F.col(column).eqNullSafe(F.col("__value"))).drop("__value")
    axes = [F.col(f"__step_{c}") for c in categories] + [size_step(F.col(size), bits)]
    fold = F.coalesce(F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 64 - FOLDS.bit_length() + 1).cast("int"), F.lit(0))
    celled = celled.withColumn("__cell", hilbert_index(axes, bits)).withColumn(
        "__fold", F.when(F.col(doc_id).isNull(), 0).otherwise(fold)
    ).drop(*(f"__step_{c}" for c in categories))
    counts = celled.groupBy("__cell", "__fold").agg(F.count("*").alias("n"))
    cells = counts.groupBy("__cell").agg(F.sum("n").alias("n"))

    def before(window) -> Column:
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    cells = cells.select(
        F.col("__cell").alias("__c"), before(Window.orderBy("__cell")).alias("__cell_start"),
        F.sum("n").over(Window.partitionBy()).alias("__rows"),
    )
    starts = counts.withColumn("__fold_start", before(Window.partitionBy("__cell").orderBy("__fold"))).drop("n")
    starts = starts.join(cells, F.col("__cell") == F.col("__c")).select(
        F.col("__cell").alias("__c"), F.col("__fold").alias("__f"), (F.col("__cell_start") + F.col("__fold_start")).alias("__start"), "__rows"
    )
    order = Window.partitionBy("__cell", "__fold").orderBy(F.col(doc_id).asc_nulls_last(), size)
    numbered = celled.withColumn("__at", F.row_number().over(order) - 1)
    placed = numbered.join(starts, (F.col("__cell") == F.col("__c")) & (F.col("__fold") == F.col("__f")))
    rank = F.col("__start") + F.col("__at")
    placed = placed.withColumn("__rank", rank).withColumn("__shard", F.expr(f"CAST(__rank * {shards} DIV __rows AS INT)"))
    first = F.expr(f"(CAST(__shard AS BIGINT) * __rows + {shards - 1}) DIV {shards}")
    return placed.select(*own, F.col("__shard").alias("shard"), (F.col("__rank") - first).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return hilbert_shards(rows, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs``, columns as they came but for ``shard`` and ``slot``, which are new."""
    rows = docs.withColumn("__size", F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 8)
    return hilbert_shards(rows, shards, size="__size").drop("__size")
