from collections import Counter

import corpus_pipeline
from llm_helpers import prose, words
from ratespark.llm import entries
from test_decontamination import brute as contaminated
from test_mixing import taken
from test_near_duplicates import brute_classes
from test_quality import counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    item = " ".join(prose(9000, 12))
    rows = [(i, " ".join(prose(i + 1, 60 + i % 30)), f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1] + (" tail" if i % 2 else ""), "copy") for i in range(30)]
    rows += [(300 + i, " ".join(prose(400 + i, 55)) + " " + item, "leak") for i in range(5)]
    rows += [(400, "too short", "s1"), (401, None, "s1"), (402, " ".join(w + "##" for w in prose(1, 80)), None)]
    return rows, [(1, item)]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = documents()
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if counts(r[1])[0] >= 50 and 100 * counts(r[1])[4] <= 50 * counts(r[1])[0] and "##" not in (r[1] or "")]
    classes = brute_classes(kept)
    kept = [r for r in kept if classes[r[0]] == r[0]]
    clean = {i for i, *_, bad in contaminated(kept, items) if not bad}
    kept = [r for r in kept if r[0] in clean]
    want = Counter({i: t // n for i, n, _, _, t in taken(kept) if t})
    assert Counter(r.doc_id for r in got) == want
    assert all(words(r.text) == words(dict((i, t) for i, t, _ in rows)[r.doc_id]) for r in got)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got[0]) == 7


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in entries.QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
    assert set(entries.SQL) < set(entries.QUERIES)
