import hashlib
import math
from collections import Counter, defaultdict

from llm_helpers import plain, prose
from ratespark.llm import mixing


def water_filled(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def taken(rows, seed=17):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(plain(text))
    targets, out = water_filled(dict(sizes)), []
    for source in sizes:
        own = []
        for doc_id, text, s in rows:
            if s == source:
                n = len(plain(text))
                u = (int(hashlib.md5(f"{seed}:{-1 if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                weight = max(0.1, 1 - sum(text.count(c) for c in "#*$%&|<>") / max(n, 1)) if text else 1.0
                own.append((-math.log(u) / weight, doc_id is None, doc_id, n))
        epochs = math.floor(targets[source] / sizes[source]) if sizes[source] else 0
        rest, before = targets[source] - epochs * sizes[source], 0
        for _, _, doc_id, n in sorted(own, key=lambda x: (x[0], x[1], x[2] or 0)):
            more = rest > 1e-6 and before + n / 2 <= rest
            out.append((doc_id, n, sizes[source], round(targets[source], 6), n * (epochs + more)))
            before += n
    return out


def rows(n=400):
    made = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"src{i % 7}" if i % 11 else None
        made.append((i, " ".join(prose(i, 1 + i * i % 97)) + " ##" * (i % 5), source))
    return made


def test_matches_brute_force(spark, make_docs):
    got = [tuple(r) for r in mixing.mixture(make_docs(rows())).collect()]
    assert Counter(got) == Counter(taken(rows()))


def test_targets_come_near_and_stay_below_two_epochs(spark, make_docs):
    sources = {i: s for i, _, s in rows(1000)}
    got = mixing.mixture(make_docs(rows(1000))).collect()
    by = defaultdict(list)
    for r in got:
        by[sources[r.doc_id], r.target].append(r)
        assert r.taken <= 2 * r.size
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) / 2 + 1e-6
    assert abs(sum(t for _, t in by) - 1.5 * sum(r.size for r in got)) < 1e-3


def test_few_buckets_change_nothing(spark, make_docs, monkeypatch):
    before = Counter(map(tuple, mixing.mixture(make_docs(rows())).collect()))
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    assert Counter(map(tuple, mixing.mixture(make_docs(rows())).collect())) == before


def test_better_documents_come_first_more_often(spark, make_docs):
    docs = [(i, " ".join(prose(i, 20)) + (" # # # # # # # # # #" if i % 2 else ""), s) for i in range(1200) for s in ["a" if i < 1000 else "b"]]
    got = {r.doc_id: r.taken > r.size for r in mixing.mixture(make_docs(docs)).collect() if r.doc_id >= 1000}
    assert sum(v for k, v in got.items() if k % 2 == 0) >= sum(v for k, v in got.items() if k % 2)


def test_odd_rows_and_documents_taken(spark, make_docs, odd_rows):
    got = mixing.mixture(make_docs(odd_rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in odd_rows)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mixture(make_docs([])).collect() == []
    docs = make_docs(rows())
    out = mixing.take_mixture(docs)
    want = Counter({(i): t // n for i, n, _, _, t in taken(rows()) if t})
    assert Counter(r.doc_id for r in out.collect()) == want and out.columns == docs.columns
