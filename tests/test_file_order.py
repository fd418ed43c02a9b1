"""Ids in file order, digests of files, and fits on folded rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from book_helpers import make_policies
from ratespark.operators import features, models, ranking
from ratespark.sources import readers


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    files = {"a.txt": 3, "b.txt": 9_500, "c.txt": 1, "sub/d.txt": 4_097}
    (root / "sub").mkdir()
    for name, lines in files.items():
        (root / name).write_text("".join(f"{name} line {i}\n" for i in range(lines)))
    return root, files


def wanted(folder):
    root, files = folder
    return [f"{name} line {i}" for name in sorted(files, key=lambda n: str(root / n)) for i in range(files[name])]


@pytest.mark.parametrize("block", ["4096", "20000", "134217728"])
def test_numbers_follow_files_and_lines(spark, folder, block):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        lines = spark.read.option("recursiveFileLookup", True).text(str(folder[0]))
        rows = ranking.in_file_order(lines, "n").orderBy("n").collect()
        kept = ranking.in_file_order(lines.where(~F.col("value").endswith("7")), "n").orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in rows] == wanted(folder) and [r.n for r in rows] == list(range(1, len(rows) + 1))
    assert [r.value for r in kept] == [v for v in wanted(folder) if not v.endswith("7")]


def test_missing_policy_ids_take_the_file_order(spark, folder):
    lines = spark.read.option("recursiveFileLookup", True).text(str(folder[0]))
    rows = features.fill_policy_ids(lines, "file").orderBy("IDpol").collect()
    assert [r.value for r in rows] == wanted(folder)


def tree(lines):
    level = [hashlib.sha256(line.encode()).hexdigest() for line in lines]
    while len(level) > 1:
        runs = [level[i : i + readers.TREE_WIDTH] for i in range(0, len(level), readers.TREE_WIDTH)]
        level = [r[0] if len(r) == 1 else hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
    return level[0]


@pytest.mark.parametrize("width", [3, 4096])
def test_file_digests_are_trees_over_the_lines(spark, folder, monkeypatch, width):
    monkeypatch.setattr(readers, "TREE_WIDTH", width)
    root, files = folder
    found = {r.path.removeprefix(f"file://{root}/").removeprefix(f"file:{root}/"): (r.lines, r.digest) for r in readers.file_digests(spark, str(root)).collect()}
    assert found == {name: (n, tree([f"{name} line {i}" for i in range(n)])) for name, n in files.items()}


def test_swapped_lines_change_the_digest(spark, tmp_path):
    for name, lines in (("one", "a\nb\nc\n"), ("two", "b\na\nc\n"), ("three", "a\nb\nc\n")):
        (tmp_path / f"{name}.txt").write_text(lines)
    versions = {r.path.split("/")[-1]: r.fingerprint for r in readers.file_versions(spark, str(tmp_path)).collect()}
    assert versions["one.txt"] == versions["three.txt"] != versions["two.txt"]


@pytest.mark.parametrize("role", [models.FREQUENCY, models.SEVERITY])
def test_folding_leaves_coefficients_as_they_are(spark, monkeypatch, role):
    book = make_policies(spark, 900).withColumn("VehAge", F.when(F.col("IDpol") % 9 != 0, F.col("VehAge") % 3))
    book = book.withColumn("ClaimAmount", (F.lit(100.0) + F.pmod(F.xxhash64("IDpol"), F.lit(3000))))
    numeric, categorical = ["VehAge"], ["VehGas", "Area"]
    folded = models.train_model(book, role, numeric=numeric, categorical=categorical)
    cells = models.fold_equal_rows(models.frequency_training_frame(book), [*numeric, *categorical]).count()
    assert cells <= 24
    monkeypatch.setattr(models, "fold_equal_rows", lambda df, factors: df.select(*factors, "__target", "__weight", F.lit(1).alias("__rows")))
    plain = models.train_model(book, role, numeric=numeric, categorical=categorical)
    a, b = (m.pipeline.stages[-1] for m in (folded, plain))
    assert a.coefficients.toArray() == pytest.approx(b.coefficients.toArray(), abs=1e-8)
    assert a.intercept == pytest.approx(b.intercept, abs=1e-8)


def test_numbering_files_neither_samples_nor_moves_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(ranking, "range_bounds", lambda *a: pytest.fail("rows were sampled"))
    lines = spark.read.option("recursiveFileLookup", True).text(str(folder[0]))
    numbered = ranking.in_file_order(lines, "n").where("value <> ''")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "row_number" not in plan and "BroadcastHashJoin" in plan
    assert numbered.count() == sum(folder[1].values())
    readers.file_digests(spark, str(folder[0])).collect()
