import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from llm_helpers import prose
from ratespark.llm import sharding


def test_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 3), (3, 2), (3, 3)):
        side = 1 << bits
        df = spark.range(side**n)
        axes = [F.floor(F.col("id") / side**a) % side for a in range(n)]
        got = df.select(sharding.hilbert_index(axes, bits).alias("h"), *(a.alias(f"x{i}") for i, a in enumerate(axes))).orderBy("h").collect()
        assert [r.h for r in got] == list(range(side**n))
        for a, b in zip(got, got[1:]):
            assert sum(abs(a[i + 1] - b[i + 1]) for i in range(n)) == 1


def check(rows, got, shards=24):
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_shards_differ_by_one_row_and_slots_have_no_gap(spark, make_docs, odd_rows):
    rows = odd_rows + [(100 + i, " ".join(prose(i, i % 50)), "hot" if i % 3 else f"s{i % 10}") for i in range(500)]
    got = sharding.sharded(make_docs(rows)).collect()
    check(rows, got)
    texts = {i: (t or "").encode() for i, t, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id])


def test_one_cell_is_spread_over_folds_and_order_holds(spark, make_docs):
    rows = [(i, "same text") for i in range(3000)]
    got = sharding.sharded(make_docs(rows)).collect()
    check(rows, got)
    assert sharding.sharded(make_docs(rows)).select("doc_id", "shard", "slot").exceptAll(
        sharding.sharded(make_docs(rows[::-1])).select("doc_id", "shard", "slot")).count() == 0


def test_files_cover_few_values(spark, make_docs):
    rows = [(i, "a " * (1 << i % 10), f"src{i % 16:02d}") for i in range(4000)]
    docs = make_docs(rows)
    got = sharding.shard_documents(docs)
    assert set(got.columns) == set(docs.columns) | {"slot"}
    mean = got.groupBy("shard").agg(F.count_distinct("source").alias("n")).agg(F.avg("n")).first()[0]
    assert mean < 8  # of 16 in any random file


def test_few_rows_and_none(spark, make_docs):
    check([(1, "a"), (2, "b")], sharding.sharded(make_docs([(1, "a"), (2, "b")])).collect())
    assert sharding.sharded(make_docs([])).collect() == []
