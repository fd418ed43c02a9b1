import math
from collections import Counter

import numpy as np

from llm_helpers import prose, words
from ratespark.llm import lm_scoring as lm

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, good, listed):
    numbers = {w: i + 1 for i, w in enumerate(sorted(listed))}
    size = len(listed) + lm.UNSEEN

    def table(texts):
        counts = Counter()
        for t in texts:
            n = [0] + [numbers[w] for w in words(t)]
            counts.update(zip(n, n[1:]))
        return counts

    def loss(counts, a, b):
        single = [0.5 + sum(n for (_, y), n in counts.items() if y == x) for x in range(size)]
        context = sum(n for (x, _), n in counts.items() if x == a)
        return -math.log((counts[a, b] + 50.0 * single[b] / sum(single)) / (context + 50.0))

    background, target = table(t for _, t, *_ in rows), table(t for i, t, *_ in rows if i in good)
    out = {}
    for i, t, *_ in rows:
        n = [0] + [numbers[w] for w in words(t)]
        pairs = list(zip(n, n[1:]))
        out[i] = (np.mean([loss(target, *p) for p in pairs]), np.mean([loss(background, *p) for p in pairs])) if pairs else (None, None)
    return out


def rows():
    good = [(i, " ".join(["the", "cat", "sat", "on", "mats"][(i + k) % 5] for k in range(20))) for i in range(12)]
    bad = [(100 + i, " ".join(["buy", "the", "pills", "now", "été"][(i * k) % 5] for k in range(20))) for i in range(12)]
    return good + bad + [(200, None), (201, ""), (202, "Unknown wordsAplenty x")]


def test_matches_brute_force(spark, make_docs):
    labels = [(i, 1, 0) for i in range(6)] + [(100, 0, 0), (3, 0, 0), (4, 1, 1), (None, 1, 0), (777, 1, 0)]
    got = {r.doc_id: r for r in lm.cross_entropy_difference(make_docs(rows()), spark.createDataFrame(labels, LABELS)).collect()}
    counts = Counter(w for _, t, *_ in rows() for w in words(t))
    listed = [w for w, n in counts.items() if n >= lm.SHARE * sum(counts.values())]
    assert sorted(lm.common_words(make_docs(rows()))) == sorted(w.encode() for w in listed)
    for i, (target, background) in brute(rows(), {0, 1, 2, 5}, listed).items():
        if target is None:
            assert got[i].score is None and got[i].n_words == 0
        else:
            assert abs(got[i].target_loss - target) < 1e-4 and abs(got[i].background_loss - background) < 1e-4
            assert abs(got[i].score - (target - background)) < 1e-4


def test_unseen_good_documents_score_lower(spark, make_docs):
    labels = [(i, 1, 0) for i in range(6)] + [(100 + i, 0, 0) for i in range(6)]
    got = {r.doc_id: r.score for r in lm.cross_entropy_difference(make_docs(rows()), spark.createDataFrame(labels, LABELS)).collect()}
    assert max(got[i] for i in range(6, 12)) < min(got[100 + i] for i in range(6, 12))


def test_vocabulary_is_bounded_by_its_share(spark, make_docs):
    docs = make_docs([(i, " ".join(prose(i, 50))) for i in range(30)])
    assert len(lm.common_words(docs, 1 / 10)) <= 10
    assert sum(r.n for r in lm.word_counts(docs).collect() if r.word) == 1500


def test_counts_do_not_depend_on_flushes(spark, make_docs, monkeypatch):
    docs = make_docs([(i, " ".join(prose(i % 4, 50))) for i in range(30)])
    before = Counter({bytes(r.word): r.n for r in lm.word_counts(docs).collect()})
    monkeypatch.setattr(lm, "COUNTED_WORDS", 7)
    assert Counter({bytes(r.word): r.n for r in lm.word_counts(docs).collect()}) == before


def test_odd_rows_and_empty_tables(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], LABELS)
    assert lm.cross_entropy_difference(make_docs(odd_rows), none).count() == len(odd_rows)
    assert lm.cross_entropy_difference(make_docs([]), none).collect() == []


def test_rare_words_are_told_apart(spark, make_docs, monkeypatch):
    # Two rare words of the same length and alphabet, each in one document of its own.
    docs = [(i, " ".join(["the", "of"][(i + k) % 2] for k in range(40)) + (" remedy" if i < 5 else " poison") + (f" once{i:02}" if i % 2 else "")) for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], LABELS)
    expected = brute(docs, {0, 1, 2}, sorted({w for _, t in docs for w in words(t)}))
    # Listed, known and rare words in turn, with packs and parts large and small.
    for shares in ((1 / 10, 1 / 20), (1 / 10, 1 / 200), (1 / 3, 1 / 2000), (2, 2)):
        monkeypatch.setattr(lm, "SHARE", shares[0])
        monkeypatch.setattr(lm, "KNOWN_SHARE", shares[1])
        monkeypatch.setattr(lm, "HELD_ROWS", 2 if shares[0] == 2 else 1_000_000)
        monkeypatch.setattr(lm, "PART_ROWS", 2_000_000 if shares[1] == 1 / 20 else 50)
        monkeypatch.setattr(lm, "SLICE_BYTES", 300 if shares[1] == 1 / 200 else 1)
        monkeypatch.setattr(lm, "SUMMED_DOCUMENTS", 20_000 if shares[1] == 1 / 20 else 3)
        got = {r.doc_id: r for r in lm.cross_entropy_difference(make_docs(docs), labels).collect()}
        for i, (target, background) in expected.items():
            assert abs(got[i].target_loss - target) < 1e-4 and abs(got[i].background_loss - background) < 1e-4
    assert got[4].score < got[8].score


def test_words_below_the_share_keep_their_own_counts(spark, make_docs):
    docs = [(i, " ".join(["the"] * 3000) + (" remedy" if i < 2 else " poison")) for i in range(4)]
    got = {r.doc_id: r.score for r in lm.cross_entropy_difference(make_docs(docs), spark.createDataFrame([(0, 1, 0)], LABELS)).collect()}
    assert got[1] < got[3]


def test_packs_round_trip():
    for values in ([], [0], [-(1 << 63), (1 << 63) - 1, 5, -1], list(range(1000))):
        assert lm.unpacked(lm.packed(np.array(values, np.int64))).tolist() == values
