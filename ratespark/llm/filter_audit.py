"""How filters interact in every order: sorted posting lists of the documents that fail.

Every document gets a place (its row number in the stored flags); places are cut into ranges of fixed width. For each part
and range, each filter keeps the sorted list of the places that fail it. The size of the union of any filters' lists comes
from a galloping k-way merge: the list with the smallest head runs ahead, by doubling steps and then bisection, to the
smallest head of the others. Sizes of unions are added over the ranges of a part; what a filter removes after others is the
difference of two unions, and all 120 orders of five filters need only 32 unions. The same merges over the lists cut to
documents of good or toxic label give the losses.

Bounded: a list holds at most RANGE places however large its part, and a part is spread over its ranges. Sums per part are
added up before they are shuffled. Copies of a text are found by the smallest id per SHA-256 of the text, added up before
the shuffle; texts that many documents share (at most a thousand) are looked up by broadcast.

Defined cases: a null text is empty and fails only A and, beside a smaller id with an empty text, E; null and empty sources
are one part, the empty string. A document without an id is no copy and has no label; rows that repeat an id are documents
of their own, equal ids are not smaller than each other. A document counts as good (toxic) if any row of ``labels`` for its
id says so. Words are counted over whole texts. Empty documents give no rows. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratespark.llm.text import UPPER, let, looked_up, plain_words, stored

FILTERS = "ABCDE"
#: Places in one range, a power of two.
RANGE_BITS = 16
_FAMILIES = ("all", "good", "toxic")


def text_flags(text: Column) -> Column:
    """Which of the filters A to D a text fails, as a struct."""
    filled = F.coalesce(text, F.lit(""))
    words = let(plain_words(filled), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(filled) - F.length(F.translate(filled, UPPER, ""))
    return let(words, lambda w: F.struct(
        (w["n"] < 200).alias("A"),
        (F.lit(100) * w["distinct"] < F.lit(50) * w["n"]).alias("B"),
        (F.lit(100).cast("long") * capitals > F.lit(2) * F.length(filled)).alias("C"),
        filled.rlike("[#$%&*|]").alias("D"),
    ))


def failing_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: (place, part, A, B, C, D, E, good, toxic)."""
    flagged = documents.select(
        F.col("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text_flags(F.col("text")).alias("flags"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"),
    )
    flagged = stored(flagged.select(F.monotonically_increasing_id().alias("place"), "doc_id", "part", "flags.*", "digest"))
    copies = flagged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("weight")).where("weight > 1")
    marked = looked_up(flagged, copies, ["digest"], "weight")
    marked = marked.withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    said = marked.join(known, F.col("doc_id") == F.col("labelled"), "left")
    return said.select("place", "part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def posting_lists(failing: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part and range of places: documents, one sorted list of failing places per filter, and of labelled ones."""
    def places(flag: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(flag), F.col("place")))).alias(flag)

    return failing.groupBy("part", F.shiftright("place", RANGE_BITS).alias("range")).agg(
        F.count(F.lit(1)).alias("documents"), *[places(f) for f in filters], places("good"), places("toxic")
    )


def gallop(places: list[int], value: int, start: int) -> int:
    """The first index from ``start`` on whose place is not below ``value``: doubling steps, then bisection."""
    step, high = 1, start
    while high < len(places) and places[high] < value:
        start, high, step = high + 1, high + step, step * 2
    return bisect_left(places, value, start, min(high, len(places)))


def union_size(lists: Sequence[list[int]]) -> int:
    """Number of different places in sorted lists of different places, by a galloping k-way merge."""
    cursors = [[places[0], 0, places] for places in lists if places]
    size = 0
    while len(cursors) > 1:
        cursors.sort(key=lambda c: c[0])
        head, at, places = cursors[0]
        limit = cursors[1][0]
        # a head that several lists share is counted with the last of them
        to = gallop(places, limit, at) if head < limit else at + 1
        size += to - at if head < limit else 0
        if to < len(places):
            cursors[0][:2] = places[to], to
        else:
            del cursors[0]
    return size + sum(len(places) - at for _, at, places in cursors)


def intersection(left: list[int], right: list[int]) -> list[int]:
    """Places in both sorted lists, by galloping in turns."""
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            out.append(left[i])
            i, j = i + 1, j + 1
        elif left[i] < right[j]:
            i = gallop(left, right[j], i)
        else:
            j = gallop(right, left[i], j)
    return out


def subsets(filters: Sequence[str]) -> list[str]:
    """All subsets, as strings in the filters' order."""
    return ["".join(chosen) for size in range(len(filters) + 1) for chosen in combinations(filters, size)]


def union_sizes(postings: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part and subset of the filters: documents of the part, and how many fail any filter of the subset.

    ``all``, ``good`` and ``toxic`` count all failing documents and those of each label.
    """
    names = subsets(filters)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lists = {"all": [row[f] for f in filters]}
                lists |= {label: [intersection(places, row[label]) for places in lists["all"]] for label in _FAMILIES[1:]}
                chosen = [[filters.index(f) for f in name] for name in names]
                yield pa.record_batch({
                    "part": pa.array([row["part"]] * len(names), pa.string()),
                    "documents": pa.array([row["documents"]] * len(names), pa.int64()), "subset": pa.array(names, pa.string()),
                    **{k: pa.array([union_size([v[i] for i in c]) for c in chosen], pa.int64()) for k, v in lists.items()},
                })

    sizes = postings.mapInArrow(merged, "part string, documents long, subset string, all long, good long, toxic long")
    return sizes.groupBy("part", "subset").agg(F.sum("documents").alias("documents"), *[F.sum(c).alias(c) for c in _FAMILIES])


def interactions(documents: DataFrame, labels: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step; see the module for how documents are counted."""
    return order_report(union_sizes(posting_lists(failing_documents(documents, labels), filters), filters), filters)


def order_report(sizes: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """Every order and step from the sizes of the unions: (part, filter_order, step, kept, removed, redundant, ...)."""
    one = F.map_from_entries(F.collect_list(F.struct("subset", F.struct("all", "good", "toxic"))))
    parts = sizes.groupBy("part").agg(F.max("documents").alias("documents"), one.alias("union"))  # one entry per subset
    everything = "".join(filters)

    def ordered(chosen) -> str:
        return "".join(f for f in filters if f in chosen)

    steps = []
    for order in permutations(filters):
        for k, last in enumerate(order):
            steps.append(("".join(order), k + 1, ordered(order[:k]), ordered(order[: k + 1]), last, ordered(set(filters) - {last})))
    plan = F.broadcast(sizes.sparkSession.createDataFrame(  # five steps of 120 orders
        steps, "filter_order string, step int, before string, after string, last string, others string"
    ))
    union = lambda name, kind="all": F.col("union")[name][kind]
    removed = union(F.col("after")) - union(F.col("before"))
    rows = parts.crossJoin(plan)
    # what a filter removes, summed over all orders: each set of earlier filters comes first in so many of them
    shapley = F.lit(0).cast("long")
    for name in filters:
        total = F.lit(0).cast("long")
        for earlier in subsets([f for f in filters if f != name]):
            times = factorial(len(earlier)) * factorial(len(filters) - 1 - len(earlier))
            total = total + F.lit(times) * (union(F.lit(ordered({*earlier, name}))) - union(F.lit(earlier)))
        shapley = F.when(F.col("last") == F.lit(name), total).otherwise(shapley)
    return rows.select(
        "part", "filter_order", "step", (F.col("documents") - union(F.col("after"))).alias("kept"), removed.alias("removed"),
        (union(F.col("last")) - removed).alias("redundant"),
        (union(F.lit(everything)) - union(F.col("others"))).alias("unique_fails"),
        (union(F.col("after"), "good") - union(F.col("before"), "good")).alias("good_lost"),
        (union(F.col("after"), "toxic") - union(F.col("before"), "toxic")).alias("toxic_lost"), shapley.alias("shapley"),
    )

