"""Isolation forests against path lengths counted one row at a time."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratespark.operators import isolation


@pytest.fixture(scope="module")
def plane(spark):
    """Points on a line with noise; the last five are joint outliers: each coordinate is ordinary, the pair is not."""
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, 1500)
    rows = [(i, float(v), float(v + rng.normal(0, 0.05)), None if i % 100 == 7 else 1.0) for i, v in enumerate(x)]
    rows += [(5000 + k, 1.5 + k * 0.02, -1.5 - k * 0.02, 1.0) for k in range(5)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(6).cache()


def walk(path, row):
    """The value of one tree's expression, read token by token."""
    match = re.fullmatch(r"([\d.e+-]+)D", path)
    if match:
        return float(match[1])
    head = re.match(r"CASE WHEN `(\w+)` >= ([\d.e+-]+)D THEN ", path)
    depth, i = 0, head.end()
    while not (depth == 0 and path.startswith(" ELSE ", i)):
        depth += path.startswith("CASE", i) - (path.startswith(" END", i) and 1)
        i += 1
    above, below = path[head.end():i], path[i + 6:-4]
    value = row[head[1]]
    return walk(above if value is not None and value >= float(head[2]) else below, row)


def test_path_lengths_match_a_walk_through_the_trees(plane):
    paths = isolation.fit_isolation_forest(plane, ["x", "y", "z"], "id", trees=12, sample=64)
    rows = plane.withColumn("p", isolation.path_length(paths)).collect()
    for row in rows[::40]:
        assert row.p == pytest.approx(np.mean([walk(p, row) for p in paths]), rel=1e-12)


def test_joint_outliers_rank_first(plane):
    scored = isolation.isolation_scores(plane, ["x", "y"], "id", trees=60)
    assert scored.columns == [*plane.columns, "isolation_score"]
    ranks = [r.id for r in scored.orderBy(F.desc("isolation_score")).collect()]
    placed = [ranks.index(i) for i in range(5000, 5005)]
    single = plane.select("id", F.greatest(F.abs("x"), F.abs("y")).alias("v")).orderBy(F.desc("v"))
    alone = [r.id for r in single.collect()]
    assert sorted(placed) == [0, 1, 2, 3, 4]
    assert min(alone.index(i) for i in range(5000, 5005)) > 40  # no column by itself shows them


def test_samples_do_not_depend_on_partitions(plane):
    one, two = (isolation.tree_samples(df, ["x"], "id", trees=20, sample=128) for df in (plane, plane.repartition(3)))
    assert one.exceptAll(two).count() == 0 and one.count() == two.count()
    sizes = [r["count"] for r in one.groupBy("tree").count().collect()]
    assert len(sizes) == 20 and all(70 < n < 190 for n in sizes)
    assert one.dropDuplicates(["tree", "key"]).count() == one.count()


def test_expected_depth_and_constant_columns(spark):
    assert [isolation.expected_depth(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert isolation.expected_depth(256) == pytest.approx(10.244, abs=1e-3)
    flat = spark.createDataFrame([(i, 1.0, None) for i in range(30)], "id long, x double, y double")
    assert isolation.isolation_scores(flat, ["x", "y"], "id", trees=3).select("isolation_score").distinct().count() == 1
    with pytest.raises(ValueError):
        isolation.fit_isolation_forest(flat.where("id < 0"), ["x"], "id", trees=2)


def test_missing_and_nan_values_go_down_as_the_conditions_say(spark):
    path = "CASE WHEN `x` >= 0.5D THEN CASE WHEN `y` >= -1.5e-05D THEN 1.0D ELSE 2.5D END ELSE 3.0D END"
    rows = [(0.5, 0.0), (0.5, -1.0), (0.4, 9.0), (None, 1.0), (float("nan"), 1.0), (1.0, None), (float("inf"), float("-inf"))]
    df = spark.createDataFrame(rows, "x double, y double")
    flat = isolation.path_length([path, "2.0D"])
    assert "lambda" not in str(flat) and "mean(" in str(flat)  # not taken one condition at a time
    found = df.select(flat.alias("a"), ((F.expr(path) + 2.0) / 2.0).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found]
    assert df.select(isolation.path_length(["2.0D", "4.0D"]).alias("p")).distinct().collect()[0].p == 3.0
