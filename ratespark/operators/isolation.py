"""Isolation forest: rows that random cuts set apart early are outliers, also where no single column stands out.

Every tree sees a hash sample of about ``SAMPLE`` rows, drawn in one pass; the samples meet in one small group per tree, where
the tree is grown. A tree comes back as nested conditions; rows go down the trees in numpy, a batch at a time. Rows
with a missing value take the lower side of a cut on it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RANDOM_SEED

TREES, SAMPLE = 100, 256


def expected_depth(rows: int) -> float:
    """Mean depth at which an unsuccessful search ends in a random binary tree of ``rows`` rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1) + 0.5772156649015329) - 2.0 * (rows - 1) / rows


def tree_samples(df: DataFrame, columns: Sequence[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = RANDOM_SEED) -> DataFrame:
    """(tree, key, columns...): about ``sample`` rows per tree, the same rows however the input is partitioned.

    A row's hash names its tree. Small inputs are dealt in several rounds, in each of which a row goes to one tree at most.
    """
    narrow = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in columns])
    share = min(1.0, sample / max(1, narrow.count()))
    per_round = max(1, min(trees, int(1 / share)))
    rounds = -(-trees // per_round)
    dealt = narrow.withColumn("__round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    draw = F.pmod(F.xxhash64("key", "__round", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    slot = F.floor(draw / F.lit(share)).cast("int")
    tree = F.col("__round") * F.lit(per_round) + slot
    return dealt.where(slot < per_round).select(tree.alias("tree"), "key", *columns).where(F.col("tree") < trees)


def grow_tree(values: np.ndarray, columns: Sequence[str], rng: np.random.Generator, depth: int = 0, limit: int | None = None) -> str:
    """One tree over sampled rows as an SQL expression of the path length."""
    limit = math.ceil(math.log2(max(2, len(values)))) if limit is None else limit
    finite = np.where(np.isnan(values), -np.inf, values)
    low, high = finite.min(axis=0), finite.max(axis=0)
    useful = np.flatnonzero(low < high)
    if depth >= limit or len(values) <= 1 or not len(useful):
        return f"{depth + expected_depth(len(values))!r}D"
    column = int(rng.choice(useful))
    start = low[column] if np.isfinite(low[column]) else np.min(values[:, column][np.isfinite(values[:, column])])
    cut = float(rng.uniform(start, high[column]))
    cut = cut if cut > start else float(high[column])
    left = finite[:, column] < cut
    below = grow_tree(values[left], columns, rng, depth + 1, limit)
    above = grow_tree(values[~left], columns, rng, depth + 1, limit)
    return f"CASE WHEN `{columns[column]}` >= {cut!r}D THEN {above} ELSE {below} END"


def fit_isolation_forest(
    df: DataFrame, columns: Sequence[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = RANDOM_SEED
) -> list[str]:
    """The trees as SQL expressions over ``columns`` (doubles); ``trees`` small groups, each grown in a task."""
    def grow(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["tree"].iloc[0])
        values = group.sort_values("key")[list(columns)].to_numpy(float)
        return pd.DataFrame({"tree": [number], "path": [grow_tree(values, columns, np.random.default_rng([seed, number]))]})

    samples = tree_samples(df, columns, key, trees, sample, seed)
    grown = samples.groupBy("tree").applyInPandas(grow, "tree int, path string").orderBy("tree").collect()  # one row per tree
    if not grown:
        raise ValueError("An isolation forest needs rows.")
    return [r.path for r in grown]


def _flat_tree(path: str, columns: list[str]) -> tuple[np.ndarray, ...]:
    """(column, cut, node above, node below, length) per node, and the depth, of one tree's expression; a leaf leads to itself."""
    tokens = iter(re.findall(r"CASE WHEN `(.+?)` >= ([^ ]+)D THEN|([-+.\de]+)D", path))
    nodes: list[list] = []

    def read() -> tuple[int, int]:
        name, cut, length = next(tokens)
        place = len(nodes)
        if length:
            nodes.append([0, np.inf, place, place, float(length)])
            return place, 0
        nodes.append([columns.index(name), float(cut), 0, 0, 0.0])
        (above, high), (below, low) = read(), read()
        nodes[place][2:4] = above, below
        return place, 1 + max(high, low)

    _, depth = read()
    column, cut, above, below, length = (np.array(part) for part in zip(*nodes))
    return column, cut, above, below, length, depth


def path_length(paths: Sequence[str]) -> Column:
    """Mean path length over the trees: a batch of rows goes down every tree level by level in numpy.

    The conditions themselves are too many to be compiled by the JVM, and it takes them one node at a time otherwise.
    """
    columns = sorted(set(re.findall(r"`(.+?)` >=", " ".join(paths))))
    trees = [_flat_tree(path, columns) for path in paths]
    if not columns:
        return F.lit(sum(tree[4][0] for tree in trees) / len(paths))

    def mean(*values: pd.Series) -> pd.Series:
        rows = np.column_stack([v.to_numpy(float) for v in values])
        each, total = np.arange(len(rows)), np.zeros(len(rows))
        for column, cut, above, below, length, depth in trees:
            node = np.zeros(len(rows), int)
            for _ in range(depth):
                node = np.where(rows[each, column[node]] >= cut[node], above[node], below[node])
            total += length[node]
        return pd.Series(total / len(trees))

    # a missing value is below every cut, NaN above, as in the conditions
    filled = [F.coalesce(F.when(F.isnan(c), F.lit(np.inf)).otherwise(F.col(c)), F.lit(-np.inf)) for c in (f"`{c}`" for c in columns)]
    return F.pandas_udf(mean, "double", F.PandasUDFType.SCALAR)(*filled)


def isolation_scores(df: DataFrame, columns: Sequence[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = RANDOM_SEED) -> DataFrame:
    """``df`` with ``isolation_score``: near 1 for rows set apart early, about 0.5 and below for ordinary ones."""
    paths = fit_isolation_forest(df, columns, key, trees, sample, seed)
    size = expected_depth(sample) or 1.0
    cast = df.withColumns({f"__raw_{c}": F.col(c) for c in columns}).withColumns({c: F.col(c).cast("double") for c in columns})
    scored = cast.withColumn("isolation_score", F.pow(F.lit(2.0), -path_length(paths) / F.lit(size)))
    return scored.withColumns({c: F.col(f"__raw_{c}") for c in columns}).drop(*[f"__raw_{c}" for c in columns])
