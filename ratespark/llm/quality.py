"""Quality rules as a short-circuit cascade.

A rule is a named condition under which a document is rejected. Rules form a CASE expression, so a document that one rule
rejects is not shown to the next. A sample gives each rule's rejection share and its cost in seconds; rules run in order
of rejections per second. The order changes only the time and the reported first reason, never which documents stay.

Defined cases: a null text counts as empty (no words, hence rejected as too short); an empty table gives an empty result;
repeated rows are judged one by one; other columns of the input are left alone, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratespark.llm.text import let, plain_words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Bits that hold a word's position beside the hash of the window that starts there.
POSITION_BITS = 24


@dataclass(frozen=True)
class Document:
    """What rules look at: the text, its words and its counts, each an expression or an already computed value."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @classmethod
    def of(cls, text: Column, words: Column) -> Document:
        return cls(
            text, words, F.size(words).cast("long"), word_chars(words), symbol_count(text), duplicate_lines(text),
            repeated_words(words),
        )

    def counts(self) -> Column:
        return F.struct(*(getattr(self, name).alias(name) for name in COUNTS))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a document to drop; null counts as false."""

    name: str
    rejects: Callable[[Document], Column]


def symbol_count(text: Column) -> Column:
    bare = F.coalesce(text, F.lit(""))
    for mark in SYMBOLS:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return (F.length(F.coalesce(text, F.lit(""))) - F.length(bare)).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.trim(line, F.lit(SPACES)) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words inside windows of ``n`` words that occur twice or more in the same text.

    A text whose window hashes all differ has none. Else each window becomes one long, the upper bits of its hash above
    its start; sorted, equal windows are neighbours. Should windows of different words share these bits, that text is
    sorted by its words instead, so the count is exact. No row leaves its place; the usual work is hashing and sorting.
    """
    low = (1 << POSITION_BITS) - 1
    starts = F.sequence(F.lit(0), F.size(words) - n)

    def start(code: Column) -> Column:
        return code.bitwiseAND(F.lit(low)).cast("int")

    def same_hash(a: Column, b: Column) -> Column:
        return F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)

    def same_words(a: Column, b: Column) -> Column:
        return _all([F.get(words, start(a) + k) == F.get(words, start(b) + k) for k in range(n)])

    def repeats(entries: Column, equal) -> Column:
        """The entries that equal a neighbour."""
        pairs = F.filter(F.sequence(F.lit(0), F.size(entries) - 2), lambda i: equal(F.get(entries, i), F.get(entries, i + 1)))
        return let(pairs, lambda p: F.transform(F.array_union(p, F.transform(p, lambda i: i + 1)), lambda i: F.get(entries, i)))

    def total(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, i: F.least(F.coalesce(F.get(starts, i + 1) - s, F.lit(n)), F.lit(n)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def by_words() -> Column:
        entries = F.sort_array(F.transform(
            starts, lambda i: F.struct(*(F.get(words, i + k).alias(f"w{k}") for k in range(n)), i.alias("start"))
        ))
        found = let(entries, lambda e: repeats(e, lambda a, b: _all([a[f"w{k}"] == b[f"w{k}"] for k in range(n)])))
        return let(F.sort_array(F.transform(found, lambda e: e["start"])), total)

    def by_hash(hashes: Column) -> Column:
        codes = F.transform(hashes, lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long")))
        found = F.sort_array(let(F.sort_array(codes), lambda c: repeats(c, same_hash)))

        def checked(found: Column) -> Column:
            clash = F.exists(
                F.sequence(F.lit(0), F.size(found) - 2),
                lambda i: same_hash(F.get(found, i), F.get(found, i + 1)) & ~same_words(F.get(found, i), F.get(found, i + 1)),
            )
            return F.when(F.size(found) == 0, F.lit(0)).when(clash, by_words()).otherwise(
                let(F.sort_array(F.transform(found, start)), total)
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(found, checked))

    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
    return F.when(F.size(words) <= n, F.lit(0)).otherwise(let(hashes, by_hash)).cast("long")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def base_rules() -> list[Rule]:
    return [
        Rule("too_short", lambda d: d.n_words < 50),
        Rule("repetitive", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    ]


def default_rules() -> list[Rule]:
    """Lenient limits: prose in any language stays; symbol soup, shouting, tables of numbers and copied lines go."""

    def most(d: Document, condition: Callable[[Column], Column]) -> Column:
        return 2 * F.size(F.filter(d.words, condition)) > d.n_words

    return [
        Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
        Rule("word_length", lambda d: let(d.word_chars, lambda n: (n < 2 * d.n_words) | (n > 15 * d.n_words))),
        Rule("capitals", lambda d: most(d, lambda w: (w < "[") & (w >= "A") & (w == F.upper(w)))),
        Rule("numbers", lambda d: most(d, lambda w: (w < ":") & (w >= "0"))),
        Rule("duplicate_lines", lambda d: 2 * d.n_dup_lines > F.size(lines_of(d.text))),
        Rule("endless_word", lambda d: F.exists(d.words, lambda w: F.length(w) > 1000)),
    ]


def ordered_rules(texts: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 7) -> list[Rule]:
    """``rules`` by rejections per second of evaluation, both from about ``sample_rows`` random rows of one text column.

    Ties, rules that reject nothing and an empty table keep the given order.
    """
    total = texts.count()
    sample = texts.sample(min(1.0, sample_rows / total), seed) if total > sample_rows else texts
    text = F.col(texts.columns[0])
    sample = sample.select(text.alias("text"), plain_words(text).alias("words")).persist()
    document = Document.of(F.col("text"), F.col("words"))
    try:
        sample.count()
        idle = _seconds(sample, F.lit(False))[0]
        worth = {}
        for rule in rules if total else []:
            seconds, rejected = _seconds(sample, rule.rejects(document))
            worth[rule.name] = rejected / max(seconds - idle, 1e-3)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda rule: -worth.get(rule.name, 0.0))


def _seconds(sample: DataFrame, condition: Column) -> tuple[float, int]:
    """Seconds of the quicker of two runs, and the rows that meet the condition."""
    counted = sample.agg(F.count_if(F.coalesce(condition, F.lit(False))))
    runs = []
    for _ in range(2):
        began = time.perf_counter()
        met = counted.first()[0]
        runs.append(time.perf_counter() - began)
    return min(runs), met


def first_rejection(rules: list[Rule], document: Document) -> Column:
    """Name of the first rule that rejects the row; later rules are not evaluated. Null: the row stays."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0].rejects(document), F.lit(rules[0].name))
    for rule in rules[1:]:
        out = out.when(rule.rejects(document), F.lit(rule.name))
    return out


def filter_by_quality(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The documents that no base rule and no default rule rejects, with their columns as they came."""
    rules = ordered_rules(docs.select(text), base_rules() + default_rules(), sample_rows)
    column = F.col(text)
    return docs.where(let(plain_words(column), lambda words: first_rejection(rules, Document.of(column, words))).isNull())


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """doc_id, the base counts, ``base_failed`` and ``kept`` for every row."""
    rules = ordered_rules(docs.select(text), default_rules(), sample_rows)
    column = F.col(text)

    def judged(words: Column, counts: Column) -> Column:
        known = Document(column, words, *(counts[name] for name in COUNTS))
        failed = base_rules()[0].rejects(known) | base_rules()[1].rejects(known)
        kept = F.when(failed, False).otherwise(first_rejection(rules, known).isNull())
        return F.struct(*(counts[name].alias(name) for name in COUNTS), failed.alias("base_failed"), kept.alias("kept"))

    result = let(plain_words(column), lambda words: let(Document.of(column, words).counts(), lambda counts: judged(words, counts)))
    return docs.select(F.col(doc_id).alias("doc_id"), result.alias("__judged")).select("doc_id", "__judged.*")
