"""Boosted regression trees on Poisson and Gamma deviance with a log link.

Every tree is a second-order step. Numbers are cut into bins once, and rows that agree in all bins and categories are folded
into one cell: with a log link both deviances depend on a cell only through its summed weight and weighted target, so
nothing is lost. A level of a tree costs one aggregate, gradient and curvature per (node, feature, bin) with sums made
before the shuffle, and one row per node reaches the driver. Finished trees are column expressions; scores of the cells are
written out every few trees, so that plans stay short.

A split compares a number with a bin's edge or a category with one level (all others, unseen ones and nulls go right). Missing
numbers take the training median. Each tree may see a share of the rows, drawn by hash, and a share of the features.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from math import log

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RANDOM_SEED, BoostConfig
from ..runtime import materialise

MAX_BINS = 255
#: Largest step of a leaf before the learning rate: a larger one may overshoot the deviance's minimum.
MAX_STEP = 0.7
#: Rows of a cell are kept apart in so many slots when trees see a share of the rows.
SLOTS = 10
#: Trees after which the cells' scores are written out.
STORE_EVERY = 10
OBJECTIVES = ("poisson", "gamma")


@dataclass(frozen=True)
class Split:
    """Rows go left where the number is below ``threshold`` (its bin at most ``bin``) or the category is ``level``."""

    feature: str
    gain: float
    threshold: float | None = None
    bin: int | None = None
    level: str | None = None


@dataclass
class Tree:
    """Nodes are numbered from 1; the children of n are 2n and 2n + 1. A node without a split is a leaf."""

    splits: dict[int, Split] = field(default_factory=dict)
    steps: dict[int, float] = field(default_factory=dict)

    def column(self, goes_left, leaf, node: int = 1) -> Column:
        split = self.splits.get(node)
        if split is None:
            return leaf(node)
        return F.when(goes_left(split), self.column(goes_left, leaf, 2 * node)).otherwise(
            self.column(goes_left, leaf, 2 * node + 1)
        )


@dataclass
class BoostedTrees:
    """A fitted model: the logarithm of the mean is ``base`` plus one step per tree."""

    objective: str
    base: float
    medians: dict[str, float]
    trees: list[Tree]

    def mean(self) -> Column:
        """The predicted mean as an expression over the raw columns."""
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree.column(self._goes_left, lambda n, steps=tree.steps: F.lit(steps[n]))
        return F.exp(total)

    def _goes_left(self, split: Split) -> Column:
        if split.level is not None:
            return F.coalesce(F.col(split.feature) == F.lit(split.level), F.lit(False))
        return _filled(split.feature, self.medians) < F.lit(split.threshold)

    def importances(self) -> dict[str, float]:
        """Share of the total gain per number, and per category and level."""
        gains: dict[str, float] = {}
        for tree in self.trees:
            for split in tree.splits.values():
                name = split.feature if split.level is None else f"{split.feature}={split.level}"
                gains[name] = gains.get(name, 0.0) + split.gain
        total = sum(gains.values())
        return {name: gain / total for name, gain in gains.items()} if total else {}

    def to_dict(self) -> dict:
        trees = [
            {"splits": {str(n): asdict(s) for n, s in t.splits.items()}, "steps": {str(n): v for n, v in t.steps.items()}}
            for t in self.trees
        ]
        return {"objective": self.objective, "base": self.base, "medians": self.medians, "trees": trees}

    @classmethod
    def from_dict(cls, stored: dict) -> "BoostedTrees":
        trees = [
            Tree({int(n): Split(**s) for n, s in t["splits"].items()}, {int(n): v for n, v in t["steps"].items()})
            for t in stored["trees"]
        ]
        return cls(stored["objective"], stored["base"], stored["medians"], trees)


def _filled(name: str, medians: dict[str, float]) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)), F.lit(medians.get(name, 0.0)))


def fold_cells(
    training: DataFrame, target: str, weight: str, numeric: Sequence[str], categorical: Sequence[str],
    medians: dict[str, float], slots: int = 1, bins: int = MAX_BINS,
) -> tuple[DataFrame, dict[str, list[float]]]:
    """(cells, edges): rows with equal bins, categories and slot as one row with summed ``weight`` and ``weight * target``.

    Edges are approximate quantiles from one pass over all rows; a number with few values gets an edge at each of them.
    """
    shares = F.array(*[F.lit((i + 1) / (bins + 1)) for i in range(bins)])
    edges: dict[str, list[float]] = {}
    if numeric:
        row = training.agg(*[F.percentile_approx(_filled(c, medians), shares, 10_000).alias(c) for c in numeric]).first()
        edges = {c: [float("-inf"), *sorted(set(row[c] or [])), float("inf")] for c in numeric}
    slot = F.pmod(F.xxhash64(*numeric, *categorical, target, weight), F.lit(slots)).cast("int")
    rows = training.select(
        *[_filled(c, medians).alias(c) for c in numeric], *categorical, slot.alias("__slot"), F.col(target).alias("__y"),
        F.col(weight).alias("__w"),
    )
    if numeric:
        names = [f"__bin_{c}" for c in numeric]
        rows = Bucketizer(splitsArray=[edges[c] for c in numeric], inputCols=list(numeric), outputCols=names).transform(rows)
        rows = rows.withColumns({n: F.col(n).cast("int") for n in names})
    keys = [*[f"__bin_{c}" for c in numeric], *categorical, "__slot"]
    cells = rows.groupBy(*keys).agg(F.sum("__w").alias("__w"), F.sum(F.col("__w") * F.col("__y")).alias("__wy"))
    return cells, edges


def fit_boosted(
    training: DataFrame, objective: str, settings: BoostConfig, target: str, weight: str, numeric: Sequence[str],
    categorical: Sequence[str], medians: dict[str, float], seed: int = RANDOM_SEED,
) -> BoostedTrees:
    """Fit up to ``settings.trees`` trees; fewer where no further split gains anything."""
    if objective not in OBJECTIVES:
        raise ValueError(f"Unsupported objective '{objective}': choose one of {', '.join(OBJECTIVES)}.")
    slots = SLOTS if settings.subsample < 1 else 1
    cells, edges = fold_cells(training, target, weight, numeric, categorical, medians, slots)
    cells = materialise(cells.withColumn("__score", F.lit(0.0)))
    total = cells.agg(F.sum("__wy").alias("wy"), F.sum("__w").alias("w")).first()
    if not total.wy or not total.w:
        raise ValueError("Boosting needs a positive weight and a positive mean target.")
    model = BoostedTrees(objective, 0.0, medians, [])
    model.base = log(total.wy / total.w)
    draw = random.Random(seed)
    features = [*numeric, *categorical]
    score, pending = F.col("__score"), 0
    for number in range(settings.trees):
        seen = draw.sample(features, max(1, round(settings.colsample_bytree * len(features))))
        sampled = _sampled(cells, number, settings.subsample, seed, features, numeric)
        tree = _grow(sampled, objective, settings, model.base, score, [f for f in numeric if f in seen],
                     [f for f in categorical if f in seen], edges)
        if not tree.splits:
            if settings.subsample == 1 and settings.colsample_bytree == 1:
                break  # every later tree would find the same
            continue
        model.trees.append(tree)
        score, pending = score + tree.column(_cell_goes_left, lambda n, steps=tree.steps: F.lit(steps[n])), pending + 1
        if pending == STORE_EVERY:
            cells, score, pending = materialise(cells.withColumn("__score", score)), F.col("__score"), 0
    return model


def _cell_goes_left(split: Split) -> Column:
    if split.level is not None:
        return F.coalesce(F.col(split.feature) == F.lit(split.level), F.lit(False))
    return F.col(f"__bin_{split.feature}") <= F.lit(split.bin)


def _sampled(cells: DataFrame, number: int, share: float, seed: int, features: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    if share >= 1:
        return cells
    keys = [f"__bin_{f}" if f in numeric else f for f in features]
    draw = F.pmod(F.xxhash64(*keys, "__slot", F.lit(seed), F.lit(number)), F.lit(1_000_000))
    return cells.where(draw < F.lit(round(share * 1_000_000)))


def _grow(
    cells: DataFrame, objective: str, settings: BoostConfig, base: float, score: Column, numeric: Sequence[str],
    categorical: Sequence[str], edges: dict[str, list[float]],
) -> Tree:
    """One tree, level by level."""
    mean = F.exp(F.lit(base) + score)
    if objective == "poisson":
        slope, curve = mean * F.col("__w") - F.col("__wy"), mean * F.col("__w")
    else:
        slope, curve = F.col("__w") - F.col("__wy") / mean, F.col("__wy") / mean
    tree, open_nodes = Tree(), {1}
    while open_nodes and max(open_nodes) < 2 ** settings.max_depth:
        at = tree.column(_cell_goes_left, lambda n: F.lit(n))
        entries = [
            F.struct(F.lit(c).alias("feature"), F.col(f"__bin_{c}").alias("bin"), F.lit(None).cast("string").alias("level"))
            for c in numeric
        ] + [
            F.struct(F.lit(c).alias("feature"), F.lit(None).cast("int").alias("bin"), F.col(c).cast("string").alias("level"))
            for c in categorical
        ]
        rows = cells.select(at.alias("node"), slope.alias("g"), curve.alias("h"), F.explode(F.array(*entries)).alias("e"))
        sums = rows.where(F.col("node").isin(*open_nodes)).groupBy("node", "e.feature", "e.bin", "e.level").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")
        )
        found = _best_splits(sums, settings).collect()  # one row per node of the level
        open_nodes = set()
        for best in found:
            split = Split(
                best.feature, float(best.gain), edges[best.feature][best.bin + 1] if best.level is None else None, best.bin, best.level
            )
            tree.splits[best.node] = split
            for child, g, h in ((2 * best.node, best.gl, best.hl), (2 * best.node + 1, best.gr, best.hr)):
                tree.steps[child] = settings.learning_rate * _step(g, h, settings)
                open_nodes.add(child)
    return tree


def _step(slope: float, curve: float, settings: BoostConfig) -> float:
    return max(-MAX_STEP, min(MAX_STEP, -slope / (curve + settings.reg_lambda))) if curve + settings.reg_lambda > 0 else 0.0


def _best_splits(sums: DataFrame, settings: BoostConfig) -> DataFrame:
    """The best split of every node that has one: (node, feature, bin, level, gain, gl, hl, gr, hr)."""
    group = Window.partitionBy("node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    is_bin = F.col("bin").isNotNull()
    sides = sums.select(
        "node", "feature", "bin", "level",
        *[F.when(is_bin, F.sum(c).over(upto)).otherwise(F.col(c)).alias(f"{c}l") for c in ("g", "h")],
        *[F.sum(c).over(group).alias(c) for c in ("g", "h")],
    ).where(is_bin | F.col("level").isNotNull())

    def worth(g: Column, h: Column) -> Column:
        return F.coalesce(F.try_divide(g * g, h + F.lit(settings.reg_lambda)), F.lit(0.0))

    sides = sides.withColumns({"gr": F.col("g") - F.col("gl"), "hr": F.col("h") - F.col("hl")}).where(
        (F.col("hl") >= settings.min_child_weight) & (F.col("hr") >= settings.min_child_weight)
    )
    gain = worth(F.col("gl"), F.col("hl")) + worth(F.col("gr"), F.col("hr")) - worth(F.col("g"), F.col("h"))
    scored = sides.withColumn("gain", F.lit(0.5) * gain).where(F.col("gain") > settings.min_gain)
    # largest gain first, then the smaller feature, bin and level
    order = F.struct(-F.col("gain"), "feature", F.coalesce("bin", F.lit(-1)), F.coalesce("level", F.lit("")))
    best = F.min_by(F.struct("feature", "bin", "level", "gain", "gl", "hl", "gr", "hr"), order).alias("best")
    return scored.groupBy("node").agg(best).select("node", "best.*")
