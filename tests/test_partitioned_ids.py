"""The id query numbers rows over several partitions."""

from pathlib import Path

import pytest

from ratespark.operators import features
from ratespark.plans import catalogue

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="sample tables are absent")
def test_ids_are_dense_and_ordered_over_partitions(spark, monkeypatch):
    given, fill = [], features.fill_policy_ids
    monkeypatch.setattr(features, "fill_policy_ids", lambda df, *a: given.append(df) or fill(df, *a))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = catalogue.QUERIES["policy_dense_ids"](spark, str(FOLDER)).orderBy("order_key").collect()
        assert given[0].rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [r.IDpol for r in rows] == list(range(1, len(rows) + 1))
