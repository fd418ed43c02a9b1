import random
from collections import Counter, defaultdict

import numpy as np

from llm_helpers import prose, words
from ratespark.llm import near_duplicates as nd
from ratespark.llm.text import WordHashes, words_of


def runs(text):
    return nd.labelled_runs(words_of(text), WordHashes())


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def edited(rng, w, share):
    return " ".join(f"n{rng.random()}" if rng.random() < share else x for x in w)


def brute_classes(rows):
    """Components of all pairs whose longest common subsequence of labelled runs reaches the threshold."""
    texts = {i: t for i, t, *_ in rows if i is not None and t is not None}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    cut = {i: runs(texts[i]).tolist() for i in ids}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = cut[i], cut[j]
            same = words(texts[i]) == words(texts[j]) and (words(texts[i]) or texts[i] == texts[j])
            if not same and a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                m = subsequence(a, b)
                same = m / (len(a) + len(b) - m) >= 0.8
            if same:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_alignment_is_the_exact_subsequence_inside_the_band():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        assert nd.aligned(a, b, 60) == subsequence(a, b)
        need = 0.8 * (len(a) + len(b)) / 1.8
        assert nd.alike(np.array(a), np.array(b)) == (subsequence(a, b) >= need - 1e-9)


def test_sketch_depends_on_order_and_occurrence():
    w = prose(1, 60)
    moved = " ".join(w[30:] + w[:30])
    agree = np.sum(nd.order_min_hash(runs(" ".join(w))) == nd.order_min_hash(runs(moved)))
    assert agree < nd.SKETCHES / 2  # nearly the same set of runs, another order
    assert len(set(runs("a b c d e " * 5).tolist())) == 21
    assert len(nd.order_min_hash(runs("a b c"))) == 0


def test_classes_match_brute_force(spark, make_docs):
    rng = random.Random(9)
    rows = []
    for g in range(8):
        base = prose(g + 1, 60 + 30 * g)
        rows += [(100 * g + k, edited(rng, base, share)) for k, share in enumerate([0, 0, 0.005, 0.01, 0.01, 0.02, 0.03, 0.2])]
    shared = " ".join(prose(77, 55))
    rows += [(2000 + i, " ".join(prose(200 + i, 70)) + " " + shared + " " + " ".join(prose(300 + i, 60))) for i in range(12)]
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(make_docs(rows)).collect()}
    assert got == brute_classes(rows)


def test_chain_of_edits_is_one_class(spark, make_docs):
    w, rows = prose(5, 100), []
    for i in range(25):
        w[(i * 11) % 100] = f"changed{i}"
        rows.append((i + 1, " ".join(w)))
    assert {r.class_id for r in nd.near_duplicate_classes(make_docs(rows)).collect()} == {1}


def test_hot_copies_and_odd_rows(spark, make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows] + [(100 + i, " ".join(prose(50, 40))) for i in range(300)] + [(90, " ".join(prose(50, 40)).upper() + "!")]
    got = nd.near_duplicate_classes(make_docs(rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.class_id)
    assert by[None] == {None} and by[1] == {1} and by[2] == {2} and by[3] == {3} and by[5] == by[6] == {5} and by[7] == by[8] == {7}
    assert {by[i].copy().pop() for i in range(100, 400)} == {90}
    kept = nd.drop_near_duplicates(make_docs(rows)).collect()
    assert Counter(r.doc_id for r in kept) == Counter([None, None, 1, 2, 3, 4, 5, 7, 9, 10, 90])


def test_large_bucket_of_copies_of_copies(spark, make_docs):
    """More texts than a bucket lists pairs for, most of them too far from the common origin."""
    rng = random.Random(2)
    base = prose(8, 90)
    rows = [(1, " ".join(base))]
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(90), rng.randrange(1, 9)):
            w[k] = f"z{i}n{k}"
        rows.append((2 + 2 * i, " ".join(w)))
        if i % 4 == 0:
            w[rng.randrange(90)] = f"again{i}"
            rows.append((3 + 2 * i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(make_docs(rows)).collect()}
    want = brute_classes(rows)
    assert 5 < len(set(want.values())) < len(rows) and got == want


def test_short_texts_are_found_without_a_miss(spark, make_docs):
    """Pairs at the threshold, by length: in many of them no sketch agrees."""
    rows, pairs = [], []
    for n in (4, 8, 12, 16, 20):
        for k in range(120):
            w, i = prose(1000 * n + k, n + 5), 1000 * n + 2 * k
            rows += [(i, " ".join(w)), (i + 1, " ".join(w[: n + 5 - (n + 1) // 5]))]
            pairs.append((i, i + 1))
    cut = {i: runs(t) for i, t in rows}
    missed = [p for p in pairs if not np.any(nd.order_min_hash(cut[p[0]]) == nd.order_min_hash(cut[p[1]]))]
    want = {p for p in pairs if nd.alike(cut[p[0]], cut[p[1]])}
    got = {r.doc_id: r.class_id for r in nd.near_duplicate_classes(make_docs(rows)).collect()}
    assert {p for p in pairs if got[p[0]] == got[p[1]]} == want and len(want) > 400 and len(missed) < 50


def test_unlike_texts_that_share_an_id(spark, make_docs):
    a, b, c = (" ".join(prose(i, 50)) for i in (1, 2, 3))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, b + " more"), (7, c), (8, c), (9, None), (9, c)]
    kept = Counter((r.doc_id, r.text) for r in nd.drop_near_duplicates(make_docs(rows)).collect())
    assert kept == Counter([(3, a), (5, b), (7, c), (9, None)])
    twice = [(5, " ".join(prose(i, 50))) for i in range(40)] * 2
    assert Counter(r.text for r in nd.drop_near_duplicates(make_docs(twice)).collect()) == Counter({t for _, t in twice})
    assert len({r.class_id for r in nd.near_duplicate_classes(make_docs(twice)).collect()}) == 40


def test_empty_table(spark, make_docs):
    assert nd.near_duplicate_classes(make_docs([])).collect() == []
    assert nd.drop_near_duplicates(make_docs([])).collect() == []
