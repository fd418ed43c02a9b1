import re
from collections import Counter

from pyspark.sql import functions as F

from llm_helpers import plain, prose
from ratespark.llm import quality
from ratespark.llm.text import plain_words


def counts(text):
    w = plain(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if plain(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside),
    )


def test_counts_match_brute_force(spark, make_docs, odd_rows):
    rows = odd_rows + [(20 + i, " ".join(prose(i, 30)[: i + 3] * (1 + i % 4)) + "\nsame\nsame \nsame") for i in range(20)]
    got = quality.judge_quality(make_docs(rows)).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == Counter((i, *counts(t)) for i, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_equal_hashes_do_not_count_as_equal_words(spark, monkeypatch):
    texts = [" ".join(prose(5, 200)), " ".join(prose(6, 40) * 3), "a b c d e f g a b c"]
    monkeypatch.setattr(quality, "POSITION_BITS", 62)  # two bits of hash: every text has clashes
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(quality.repeated_words(plain_words(F.col("t")))).collect()]
    assert got == [counts(t)[4] for t in texts]


def test_clean_prose_stays_and_junk_goes(spark, make_docs):
    clean = [(i, ". ".join(" ".join(prose(i, 80)[k : k + 9]).capitalize() for k in range(0, 80, 9))) for i in range(5)]
    foreign = [(10, " ".join("документ%d" % i for i in range(60))), (11, " ".join("日本語%d" % i for i in range(60)))]
    junk = [
        (20, " ".join(w + "###" for w in prose(1, 90))), (21, " ".join(w.upper() for w in prose(2, 90))),
        (22, " ".join(str(i * 37) for i in range(90))), (23, "\n".join(["one two"] * 2 + [" ".join(prose(4, 60)) + str(i) for i in range(1)] + ["end of it"] * 9)),
        (24, " ".join(["w" * 30] + ["x" * 40 + str(i) for i in range(80)])), (25, " ".join(prose(9, 60)) + " " + "q" * 1500),
    ]
    kept = {r.doc_id for r in quality.judge_quality(make_docs(clean + foreign + junk)).where("kept").collect()}
    assert kept == {i for i, _ in clean + foreign}
    assert {r.doc_id for r in quality.filter_by_quality(make_docs(clean + foreign + junk)).collect()} == kept


def test_order_follows_rejections_per_second(spark, monkeypatch):
    rules = [quality.Rule(n, lambda d: F.lit(False)) for n in ("slow", "sharp", "idle")]
    answers = iter([(0.0, 0), (2.0, 100), (0.5, 90), (0.1, 0)])
    monkeypatch.setattr(quality, "_seconds", lambda sample, condition: next(answers))
    df = spark.createDataFrame([("a",)], "t string")
    assert [r.name for r in quality.ordered_rules(df, rules)] == ["sharp", "slow", "idle"]


def test_later_rules_are_not_evaluated(spark):
    boom = quality.Rule("boom", lambda d: F.raise_error(F.lit("evaluated")).cast("boolean"))
    first = quality.Rule("first", lambda d: d.n_words > 0)
    df = spark.createDataFrame([("a b",)], "t string")
    assert df.select(quality.first_rejection([first, boom], quality.Document.of(F.col("t"), plain_words(F.col("t"))))).first()[0] == "first"


def test_empty_table_and_columns(spark, make_docs):
    assert quality.judge_quality(make_docs([])).collect() == []
    kept = quality.filter_by_quality(make_docs([(1, " ".join(prose(1, 60)))]))
    assert kept.columns == make_docs([]).columns and kept.count() == 1
