"""Filter interactions against plain counting, merges against sets."""

from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from llm_helpers import plain, prose
from ratespark.llm.filter_audit import FILTERS, gallop, interactions, intersection, union_size

PLACES = st.lists(st.lists(st.integers(0, 60), unique=True).map(sorted), max_size=6)
LABELS = "doc_id long, quality int, toxic int, part string"


@settings(max_examples=300, deadline=None)
@given(PLACES)
def test_union_sizes(lists):
    assert union_size(lists) == len(set().union(*lists))


@settings(max_examples=200, deadline=None)
@given(PLACES.filter(lambda x: len(x) >= 2), st.integers(-1, 62))
def test_gallop_and_intersection(lists, value):
    left, right = lists[:2]
    assert intersection(left, right) == sorted(set(left) & set(right))
    assert gallop(left, value, 0) == sum(x < value for x in left)


def brute(docs, labels):
    good = {d for d, q, t in labels if d is not None and q == 1}
    toxic = {d for d, q, t in labels if d is not None and t == 1}
    rows = []
    for r in docs:
        doc_id, text, source = r[0], r[1] or "", (r[2] if len(r) > 2 else "s") or ""
        words = plain(text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs):
            fails |= {"E"}
        rows.append((source, fails, doc_id in good, doc_id in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley, lines = dict.fromkeys(FILTERS, 0), []
        for order in permutations(FILTERS):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                lines.append((f, part, "".join(order), step, len(left), len(gone), failing - len(gone),
                              sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*line[1:], shapley[line[0]]) for line in lines]
    return sorted(out)


def found(docs, labels):
    return sorted(
        (r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
        for r in interactions(docs, labels).collect()
    )


def test_odd_rows(spark, make_docs, odd_rows):
    labels = [(1, 1, 0), (7, 0, 1), (7, 1, None), (8, None, None), (None, 1, 1), (6, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*r, "p") for r in labels], LABELS)
    assert found(make_docs(odd_rows), frame) == brute(odd_rows, labels)


def test_mixed_rows(spark, make_docs):
    rows, labels = [], []
    for i in range(300):
        words = prose(i % 40, 150 + i % 7 * 40)
        if i % 5 == 0:
            words = words[:30] * 12
        if i % 6 == 0:
            words[3] = "A|B"
        if i % 4 == 0:
            words = [w.upper() if j % 9 == 0 else w for j, w in enumerate(words)]
        rows.append((i // 2 if i % 11 == 0 else i, " ".join(words), [None, "", "src", "other"][i % 4] if i % 3 else "src"))
        if i % 2:
            labels.append((i, i % 4 // 2, i % 3 // 2))
    frame = spark.createDataFrame([(*r, "p") for r in labels], LABELS)
    assert found(make_docs(rows), frame) == brute(rows, labels)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], LABELS)
    assert found(make_docs([]), none) == []
    assert found(make_docs([(1, "a")]), none) == brute([(1, "a")], [])
