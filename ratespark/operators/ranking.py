"""Exact global order statistics without a one-partition window and without a written copy.

Ranks and running sums: a hash sample of the rows fixes range bounds on the whole sort key as literals, so a row's part is an
expression of the row alone, the same after any recomputation. One aggregate counts (or sums) the parts, and one exchange
brings each part together; what lies in earlier parts is a small row per part. A value shared by a third of all rows is
spread over many parts as long as the key ends in an id.

Quantiles: values are counted in bins, and only the bins that hold a wanted position are cut further, until such a bin
holds one value. No row is moved or sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise

_PLACE = "__place"
_PART = "__part"
_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above 33 position bits
#: Sampled rows for each part; parts for each shuffle partition.
SAMPLE_PER_PART, PARTS_PER_TASK = 16, 2
#: Bins into which an interval is cut in one pass, and the accuracy of the sketch that gives the first intervals.
BINS, SKETCH_ACCURACY = 2048, 10_000
_LARGEST = 1.7976931348623157e308


def _sort(order_by: Sequence[str]) -> list[Column]:
    """Column names, with a leading minus for descending order; nulls come first, or last when descending."""
    return [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in order_by]


def range_bounds(df: DataFrame, order_by: Sequence[str], parts: int) -> list[tuple]:
    """Up to ``parts`` - 1 sort keys in order that cut ``df`` into about equal parts.

    The sample is the row of least hash in each of a fixed number of hash groups: one pass, a bounded number of rows
    (``SAMPLE_PER_PART`` for each part), and the same rows however the input is partitioned.
    """
    keys = [k.lstrip("-") for k in order_by]
    hashed = F.xxhash64(*keys)
    one = F.min_by(F.struct(*keys), F.col("__h")).alias("key")
    groups = F.pmod("__h", F.lit(parts * SAMPLE_PER_PART))
    sample = df.select(*keys, hashed.alias("__h")).groupBy(groups.alias("__g")).agg(one).select("key.*")
    rows = [tuple(r) for r in sample.orderBy(*_sort(order_by)).collect()]
    picks = sorted({len(rows) * i // parts for i in range(1, parts)} - {0})
    return [rows[i] for i in picks if i < len(rows)]


def _before(order_by: Sequence[str], bound: tuple) -> Column:
    """Whether a row sorts before ``bound``."""
    result = F.lit(False)
    for name, value in reversed(list(zip(order_by, bound))):
        column, limit = F.col(name.lstrip("-")), F.lit(value)
        if name.startswith("-"):
            less = column.isNotNull() if value is None else F.coalesce(column > limit, F.lit(False))
        else:
            less = F.lit(False) if value is None else F.coalesce(column < limit, F.lit(True))
        result = less | (column.eqNullSafe(limit) & result)
    return result


def range_part(order_by: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """Number of bounds that do not sort after the row, found by bisection."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_before(order_by, bounds[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def with_range_part(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``df`` with ``__part``: the parts follow one another in the order of ``order_by``."""
    parts = max(2, PARTS_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.withColumn(_PART, range_part(order_by, range_bounds(df, order_by, parts)))


def global_rank(df: DataFrame, order_by: Sequence[str], alias: str = "rank", rows_alias: str | None = None) -> DataFrame:
    """Exact ``row_number() over (order by ...)`` from 1, with ``order_by`` unique per row.

    ``rows_alias`` also adds the number of rows, at no extra cost.
    """
    parted = with_range_part(df, order_by)
    local = F.row_number().over(Window.partitionBy(_PART).orderBy(*_sort(order_by)))
    added = {alias: F.col("__start") + local}
    if rows_alias:
        added[rows_alias] = F.col("__total")
    return parted.join(F.broadcast(_starts(parted)), _PART).withColumns(added).drop(_PART, "__start", "__total")


def _starts(parted: DataFrame) -> DataFrame:
    """(__part, __start, __total): rows in earlier parts and in all; one row per part."""
    per_part = parted.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        _PART,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        F.sum("__n").over(Window.partitionBy()).alias("__total"),
    )


def dense_ids(df: DataFrame, alias: str) -> DataFrame:
    """1..n in the order in which Spark deals out the input: file order within one file, any order among several."""
    placed = materialise(df.withColumn(_PLACE, F.monotonically_increasing_id()))
    placed = placed.withColumn(_PART, F.shiftright(_PLACE, _SLOT_BITS).cast("int"))
    slot = F.col(_PLACE).bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    # one row per partition of ``placed``, so the broadcast is bounded by the cluster
    numbered = placed.join(F.broadcast(_starts(placed)), _PART).withColumn(alias, F.col("__start") + slot + F.lit(1))
    return numbered.drop(_PART, _PLACE, "__start", "__total")


def with_file_key(df: DataFrame) -> DataFrame:
    """A table straight from a file reader with each row's file, the start of its block and its place in the reading task."""
    return df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias(_PLACE),
    )


def with_file_lines(df: DataFrame, alias: str = "line", by_file: bool = True, rows_alias: str | None = None) -> DataFrame:
    """``df``, straight from a file reader, with ``__file`` and the 1-based number of each row in its file or in all files.

    A task reads a block from its start to its end, so a row's number is its place after the block's first row, plus the rows of
    all earlier blocks. One aggregate counts the blocks; no row is moved or sorted. ``rows_alias`` adds the rows of the file
    or of all files. Only filters and computed columns may lie between ``df`` and its reader.
    """
    keyed = with_file_key(df)
    block = {"__file": "__in", "__block": "__from", "__task": "__by"}
    task = F.shiftright(_PLACE, _SLOT_BITS).cast("int").alias("__task")
    counts = keyed.groupBy("__file", "__block", task).agg(F.count(F.lit(1)).alias("__n"), F.min(_PLACE).alias("__first"))
    span = Window.partitionBy(*["__file"] if by_file else [])  # one row per block of the reader
    before = span.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(name).alias(other) for name, other in block.items()], "__first",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(span).alias("__total"),
    )
    placed = keyed.withColumn("__task", task)
    same = (F.col("__file") == F.col("__in")) & (F.col("__block") == F.col("__from")) & (F.col("__task") == F.col("__by"))
    # a block that the count has not seen would be numbered wrongly: the reader dealt its blocks otherwise the second time
    moved = F.raise_error(F.lit("The files' blocks changed while their rows were being numbered.")).cast("long")
    added = {alias: F.coalesce("__start", moved) + F.col(_PLACE) - F.col("__first") + F.lit(1)}
    if rows_alias:
        added[rows_alias] = F.col("__total")
    return placed.join(F.broadcast(starts), same, "left").withColumns(added).drop(
        "__block", "__task", _PLACE, *block.values(), "__first", "__start", "__total"
    )


def in_file_order(df: DataFrame, alias: str = "row_number") -> DataFrame:
    """1..n by the paths of the files and the order of the rows in each, for a table straight from a file reader.

    Only filters and computed columns may lie in between. The keys follow from the files and the reader's blocks, so they
    are the same when a task is run again, and blocks of any size give the same numbers.
    """
    return with_file_lines(df, alias, by_file=False).drop("__file")


def prefix_sums(
    df: DataFrame,
    order_by: Sequence[str],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running totals (inclusive) of ``sums`` in global order, restarted per ``by`` group.

    ``by`` columns must lead ``order_by``, which must be unique per row. ``totals`` maps names of ``sums`` to columns that
    receive the group total. Sums of earlier parts are needed only for groups that lie in several parts; each part has at
    most two of these, which bounds the broadcast.
    """
    parted = with_range_part(df, order_by)
    group = Window.partitionBy(*by)
    earlier = group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    per_part = parted.groupBy(*by, _PART).agg(*[F.sum(v).alias(f"__t_{n}") for n, v in sums.items()])
    spread = per_part.select(
        *by,
        _PART,
        F.count(F.lit(1)).over(group).alias("__parts"),
        # nothing precedes the first part of a group: the empty sum is null
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(group).alias(f"__total_{n}") for n in sums],
    ).where("__parts > 1").drop("__parts")
    keys = {k: f"__by_{i}" for i, k in enumerate([*by, _PART])}
    spread = F.broadcast(spread.withColumnsRenamed(keys))
    same = [F.col(k).eqNullSafe(F.col(other)) for k, other in keys.items()]
    # a group lies inside its part as it does in the exchange: one exchange serves both windows
    gathered = parted.repartition(F.col(_PART))
    inside = Window.partitionBy(_PART, *by)
    local = inside.orderBy(*_sort(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    summed = gathered.withColumns({
        **{f"__l_{n}": F.sum(v).over(local) for n, v in sums.items()},
        **{f"__g_{n}": F.sum(sums[n]).over(inside) for n in (totals or {})},
    })
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    added = {n: F.coalesce(F.col(f"__before_{n}"), F.lit(0)) + F.col(f"__l_{n}") for n in sums}
    added |= {alias: F.coalesce(F.col(f"__total_{n}"), F.col(f"__g_{n}")) for n, alias in (totals or {}).items()}
    return summed.join(spread, condition, "left").withColumns(added).drop(
        _PART, *keys.values(), *[f"__{kind}_{n}" for n in sums for kind in ("l", "g", "before", "total")]
    )


def quantile_bucket(rank: Column, rows: Column, buckets: int) -> Column:
    """0-based equal-count bucket of a 1-based rank, edges at linear quantiles of the ranks."""
    count = F.least(F.lit(buckets), rows)
    edge = F.ceil(F.try_divide((rank - F.lit(1)) * count, (rows - F.lit(1)).cast("double")))
    return F.coalesce(F.greatest(edge, F.lit(1)) - F.lit(1), F.lit(0)).cast("int")


def with_quantile_bucket(
    df: DataFrame, order_by: Sequence[str], buckets: int = 10, alias: str = "bucket"
) -> DataFrame:
    """Exact equal-count buckets over the whole frame; ``order_by`` must be unique per row."""
    ranked = global_rank(df, order_by, "__rank", "__rows")
    return ranked.withColumn(alias, quantile_bucket(F.col("__rank"), F.col("__rows"), buckets)).drop(
        "__rank", "__rows"
    )


def with_approx_bucket(df: DataFrame, value: str, buckets: int = 10, alias: str = "bucket") -> DataFrame:
    """Cheap alternative: bucket edges from one sketch pass, ties stay together."""
    shares = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(value, F.array(*map(F.lit, shares)), 10_000).alias("__edges"))
    above = F.size(F.filter("__edges", lambda edge: edge < F.col(value)))
    return df.crossJoin(F.broadcast(edges)).withColumn(alias, above.cast("int")).drop("__edges")


def unpivot(df: DataFrame, columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form of ``columns`` (same type), nulls dropped."""
    return df.select(*columns).unpivot([], list(columns), name, value).where(F.col(value).isNotNull())


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], shares: Mapping[str, float], count: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles of several numeric columns: one row per column that has a value.

    A sketch of all columns gives a first interval around each wanted position. Each following pass counts all columns at
    once, an interval in bins and the rest in one bin each, and goes on with the bins that hold a wanted position, until
    they hold one value (nearly always the second or third pass). Values below an interval are counted anew in each pass,
    so a sketch that is off costs a pass, never the result. A pass returns at most ``BINS`` rows per interval.
    ``count`` names a column that says how many equal rows a row stands for; the first interval is then the whole range.
    """
    spark = df.sparkSession
    copies = F.col(count) if count else F.lit(1)
    doubles = df.select(copies.cast("long").alias("copies"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sizes, intervals = (_whole_ranges if count else _first_intervals)(doubles, len(columns), list(shares.values()))
    wanted = {
        i: sorted({spot for share in shares.values() for spot in (math.floor((n - 1) * share), math.ceil((n - 1) * share))})
        for i, n in enumerate(sizes) if n
    }
    found: dict[tuple[int, int], float] = {}
    while any(wanted.values()):
        bins: dict[int, list] = {}
        for row in _count_bins(doubles, {i: intervals[i] for i, spots in wanted.items() if spots}).collect():
            bins.setdefault(row.feature, []).append(row)
        for i, rows in bins.items():
            rows.sort(key=lambda r: r.bin)
            following, left = [], []
            for spot in wanted[i]:
                row = _bin_at(rows, spot)
                if row.low == row.high or row.low != row.low:
                    found[i, spot] = row.low
                else:
                    left.append(spot)
                    following.append((row.low, row.high))
            wanted[i], intervals[i] = left, sorted(set(following))
    schema = ", ".join(["feature string", "rows long", *[f"`{label}` double" for label in shares]])
    return spark.createDataFrame([
        (columns[i], n, *[_between(found, i, (n - 1) * share) for share in shares.values()]) for i, n in enumerate(sizes) if n
    ], schema)


def _between(found: Mapping[tuple[int, int], float], column: int, position: float) -> float:
    low, high = found[column, math.floor(position)], found[column, math.ceil(position)]
    return low + (high - low) * (position - math.floor(position))


def _first_intervals(doubles: DataFrame, columns: int, shares: Sequence[float]) -> tuple[list[int], dict[int, list[tuple]]]:
    """Values per column, and intervals that hold the wanted positions unless the sketch is off."""
    margin = 2.0 / SKETCH_ACCURACY
    edges = F.array(*[F.lit(min(1.0, max(0.0, s + d))) for s in shares for d in (-margin, margin)])
    names = [f"c{i}" for i in range(columns)]
    row = doubles.agg(
        *[F.count(c).alias(f"n_{c}") for c in names], *[F.percentile_approx(c, edges, SKETCH_ACCURACY).alias(f"q_{c}") for c in names]
    ).first()
    intervals = {i: _disjoint(zip(*[iter(row[f"q_{c}"] or [])] * 2)) for i, c in enumerate(names)}
    return [row[f"n_{c}"] for c in names], intervals


def _whole_ranges(doubles: DataFrame, columns: int, shares: Sequence[float]) -> tuple[list[int], dict[int, list[tuple]]]:
    """Copies of values per column, and one interval from the smallest to the largest value."""
    names = [f"c{i}" for i in range(columns)]
    row = doubles.agg(
        *[F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("copies"))), F.lit(0)).alias(f"n_{c}") for c in names],
        *[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)],
    ).first()
    ranges = {i: [] if row[f"min_{c}"] is None else _disjoint([(row[f"min_{c}"], row[f"max_{c}"])]) for i, c in enumerate(names)}
    return [row[f"n_{c}"] for c in names], ranges


def _disjoint(intervals: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sorted finite intervals, overlapping ones joined."""
    out: list[tuple[float, float]] = []
    finite = [tuple(max(-_LARGEST, min(_LARGEST, x if x == x else _LARGEST)) for x in pair) for pair in intervals]
    for low, high in sorted(finite):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _count_bins(doubles: DataFrame, intervals: Mapping[int, Sequence[tuple[float, float]]]) -> DataFrame:
    """(feature, bin, n, low, high): values per bin with their extremes; bins are numbered in the order of the values."""
    # A column's limits come from literal arrays: one short expression serves all columns, which the JVM still compiles.
    numbers = list(intervals)
    rows = doubles.select("copies", F.posexplode(F.array(*[F.col(f"c{i}") for i in numbers])).alias("at", "value")).where(F.col("value").isNotNull())
    feature = F.array(*map(F.lit, numbers))[F.col("at")]
    return rows.groupBy(feature.alias("feature"), _bin_of(F.col("value"), F.col("at"), list(intervals.values())).alias("bin")).agg(
        F.sum("copies").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def _bin_of(value: Column, at: Column, intervals: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Gaps between the intervals of column ``at`` are a bin each; infinities and NaN have bins of their own."""
    def limit(of) -> Column:
        return F.array(*[F.lit(of(spans)) for spans in intervals])[at]

    step = BINS + 2
    out = F.when(value == F.lit(float("-inf")), F.lit(-1))
    for k in range(max(map(len, intervals))):
        low, high, half, width = (
            limit(lambda spans, f=f: float(f(*spans[k])) if k < len(spans) else None).cast("double")
            # halves, for the full range of a double would overflow
            for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a / 2, lambda a, b: b / 2 - a / 2)
        )
        place = F.when(width > 0, F.floor((value / 2 - half) / width * F.lit(float(BINS))).cast("int"))
        # else one value, or neighbours whose halves agree
        place = place.otherwise(F.when(value > low, F.lit(1)).otherwise(F.lit(0)))
        out = out.when(value < low, F.lit(k * step)).when(value <= high, F.lit(k * step + 1) + place)
    last = limit(lambda spans: len(spans) * step)
    return out.when(value < F.lit(float("inf")), last).when(F.isnan(value), last + 2).otherwise(last + 1)


def _bin_at(rows: Sequence, spot: int):
    """The bin that holds the value at a 0-based position."""
    for row in rows:
        if spot < row.n:
            return row
        spot -= row.n
    raise RuntimeError("The input changed while its quantiles were being found.")


def approx_quantiles(df: DataFrame, columns: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Sketch-based counterpart of :func:`exact_quantiles`: one pass, no shuffle of rows."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    names = list(shares)
    wanted = F.array(*[F.lit(float(s)) for s in shares.values()])
    found = unpivot(doubles, columns).groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.percentile_approx("value", wanted, 10_000).alias("q")
    )
    return found.select("feature", "rows", *[F.col("q")[i].alias(label) for i, label in enumerate(names)])


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties: one row per column."""
    counts = unpivot(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    return counts.groupBy("feature").agg(best.alias("best")).select("feature", F.col("best.value").alias("value"))
