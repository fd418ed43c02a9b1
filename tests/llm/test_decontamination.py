import hashlib
from collections import Counter

from llm_helpers import prose, words
from ratespark.llm import decontamination as dc


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, items):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return Counter(out)


ITEMS = [(i, " ".join(prose(i, 14))) for i in range(30)] + [
    (40, "short One"), (41, None), (42, ""), (43, "!!"), (7, " ".join(prose(7, 14))), (50, "É 中 mixed words of ten and more, some more words")]


def documents(odd_rows):
    rows = list(odd_rows)
    for i in range(40):
        w = prose(900 + i, 40)
        if i % 3 == 0:
            w[10:10] = prose(i % 30, 14)[i % 5 :]
        if i % 7 == 0:
            w += ["short", "ONE"] * 3
        if i % 10 == 0:
            w += prose(3, 14) + prose(3, 14)[4:] + "É 中 MIXED words of ten and more; some more words".split()
        rows.append((100 + i, ", ".join(w).title() if i % 2 else " ".join(w)))
    return rows


def test_matches_brute_force(spark, make_docs, odd_rows):
    rows = documents(odd_rows)
    got = dc.judged(make_docs(rows), bench(spark, ITEMS)).collect()
    assert Counter(map(tuple, got)) == brute(rows, ITEMS)


def test_blocks_give_the_same(spark, make_docs, odd_rows):
    rows = documents(odd_rows)
    found = dc.contamination(make_docs(rows), bench(spark, ITEMS), block_bytes=400)
    whole = dc.contamination(make_docs(rows), bench(spark, ITEMS))
    assert dc.item_blocks(bench(spark, ITEMS), 400)[0] > 5
    assert Counter(map(str, found.collect())) == Counter(map(str, whole.collect()))
    clean = {i for i, *_, bad in brute(rows, ITEMS) if not bad}
    for block_bytes in (400, 1 << 20):
        kept = dc.drop_contaminated(make_docs(rows), bench(spark, ITEMS), block_bytes=block_bytes)
        assert {r.doc_id for r in kept.collect()} == clean and kept.columns == make_docs([]).columns


def test_spans_are_cut_out(spark, make_docs):
    item, w = prose(1, 14), prose(500, 20)
    rows = [(1, " ".join(w[:9]) + ", " + " ".join(item) + "! " + " ".join(w[9:])), (2, " ".join(w)), (3, None)]
    out = {r.doc_id: r.text for r in dc.without_spans(make_docs(rows), bench(spark, [(1, " ".join(item))])).collect()}
    assert words(out[1]) == w and out[2] == " ".join(w) and out[3] is None


def test_a_shared_hash_is_not_a_hit(monkeypatch):
    windows = dc.WindowSet([("1", " ".join(prose(1, 10)))])
    shuffled = prose(1, 10)[::-1]
    monkeypatch.setattr(dc.WindowSet, "hashed", staticmethod(lambda numbers, length=None: windows.hashes[10].repeat(max(0, len(numbers) - (length or len(numbers)) + 1))))
    assert windows.scan([w.encode() for w in shuffled]) == ([], set())


def test_empty_tables(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    assert [r.contaminated for r in dc.judged(docs, bench(spark, [])).collect()] == [False, False]
    assert dc.judged(make_docs([]), bench(spark, ITEMS)).collect() == []
    assert dc.drop_contaminated(docs, bench(spark, [])).count() == 2


def test_spans_of_all_blocks_are_cut_from_the_whole_text(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(20))
    items = [(1, " ".join(f"w{i}" for i in range(10))), (2, " ".join(f"w{i}" for i in range(5, 15)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(1, text), (1, text), (2, "clean words only"), (None, text), (3, None)])
    one, many = (
        sorted((r.doc_id or -1, r.text or "") for r in dc.without_spans(docs, benchmark, block_bytes=size).collect()) for size in (1 << 20, 1)
    )
    assert one == many
    for doc_id, left in one:
        assert doc_id in (2, 3) or words(left)[-5:] == [f"w{i}" for i in range(15, 20)] and not {f"w{i}" for i in range(15)} & set(words(left))
