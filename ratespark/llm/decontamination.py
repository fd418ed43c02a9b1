"""Benchmark decontamination with a broadcast set of n-grams.

Items are cut into windows of ``WINDOW`` consecutive normalised words (an item of fewer words is one window). Windows go
to the tasks as a hash set, in blocks of a bounded size: a larger benchmark means more passes over the documents, not a
larger broadcast. A task turns each text into the block's word numbers, finds windows by rolling hash, and verifies every
hit word by word. Documents or the hit spans can then be removed.

Defined cases: null and wordless documents are clean; null and wordless items have no windows; a null item id is left
out; items that repeat an id count once; repeated documents are judged one by one; an empty benchmark leaves all clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratespark.llm.text import WORD_BYTES, mixed, ngrams, words_of

WINDOW = 10
#: Bytes of item text that one broadcast holds; the set made of it takes some ten times as much in a task.
BLOCK_BYTES = 8 << 20
SCAN_SCHEMA = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"
REMOVED = " "


class WindowSet:
    """The windows of some items: word numbers, hashes by window length, and the items of every window."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            words = words_of(text)
            length = min(window, len(words))
            for i in range(len(words) - length + 1 if length else 0):
                self.items[tuple(words[i : i + length])].add(item_id)
            for word in words:
                self.numbers.setdefault(word, len(self.numbers) + 1)
        by_length = defaultdict(list)
        for words in self.items:
            by_length[len(words)].append(self.hashed([self.numbers[w] for w in words])[0])
        self.hashes = {n: np.unique(np.array(found, np.uint64)) for n, found in by_length.items()}

    @staticmethod
    def hashed(numbers: list[int] | np.ndarray, length: int | None = None) -> np.ndarray:
        return ngrams(mixed(np.asarray(numbers, np.uint64)), length or len(numbers))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (first word, last word) of verified windows, and the items they come from."""
        numbers = np.fromiter((self.numbers.get(w, 0) for w in words), np.uint64, len(words))
        known = numbers > 0
        hits, items = [], set()
        for length, wanted in self.hashes.items():
            if len(words) < length:
                continue
            run = np.cumsum(np.concatenate([[0], known]))
            starts = np.flatnonzero(run[length:] - run[:-length] == length)
            if not len(starts):
                continue
            hashes = self.hashed(numbers, length)[starts]
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            for start in starts[wanted[at] == hashes].tolist():
                if found := self.items.get(tuple(words[start : start + length])):
                    hits.append((start, start + length - 1))
                    items |= found
        return merged(hits), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """The number of blocks, and the blocks as lists of (id, text); only one is on the driver at a time.

    An item goes to a block by the hash of its id and text, the number of blocks follows from the bytes of all texts.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    return count, ([(row.id, row.text) for row in items.where(place == block).collect()] for block in range(count))


def scanned(docs: DataFrame, items: list[tuple[str, str]], window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` with n_words, the hit spans (in words) and the items, for one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    others = [c for c in docs.columns if c != text]
    schema = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(shared.value, window)
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            counts, spans, items = [], [], []
            for value in batch[text]:
                words = words_of(value.as_py())
                hits, found = windows.scan(words)
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in hits])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in others), pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))],
                names=[*others, "n_words", "spans", "items"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != text]
    return docs.mapInArrow(scan, ", ".join([*fields, SCAN_SCHEMA]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans and items of every row of ``docs`` (``doc_id``, ``text``)."""
    count, blocks = item_blocks(benchmark, block_bytes)
    rows = docs.select("doc_id", "text")
    if count == 1:
        return scanned(rows, next(blocks), window)
    rows = rows.withColumn("print", F.md5(F.col("text").cast("binary")))
    hits = reduce(DataFrame.union, (scanned(rows, block, window).where(F.size("spans") > 0) for block in blocks))
    # Rows alike in id and text have the same hits, so one set of them stands for all.
    folded = hits.groupBy("doc_id", "print").agg(F.flatten(F.collect_set("spans")), F.flatten(F.collect_set("items")))
    folded = folded.toDF("other_id", "other_print", "all_spans", "all_items")
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("print") == F.col("other_print"))
    return scanned(rows, [], window).join(folded, same, "left").select(
        "doc_id", "n_words",
        F.when(F.col("all_spans").isNull(), F.col("spans")).otherwise(_merged(F.col("all_spans"))).alias("spans"),
        F.when(F.col("all_items").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct("all_items"))).alias("items"),
    )


def _merged(spans: Column) -> Column:
    """Overlapping and touching spans joined."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def add(out: Column, span: Column) -> Column:
        top = F.get(out, F.size(out) - 1)
        wider = F.struct(top["first"].alias("first"), F.greatest(top["last"], span["last"]).alias("last"))
        joins = (F.size(out) > 0) & (span["first"] <= top["last"] + 1)
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(wider))).otherwise(F.array_append(out, span))

    return F.aggregate(F.array_sort(spans), none, add)


def words_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"] + 1))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``."""
    found = contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", words_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit, columns as they came. Blocks follow each other as filters."""
    clean = docs
    for block in item_blocks(benchmark, block_bytes)[1]:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = WindowSet(shared.value, window)
            for batch in batches:
                yield batch.filter(pa.array([not windows.scan(words_of(t.as_py()))[0] for t in batch["text"]], pa.bool_()))

        clean = clean.mapInArrow(keep, docs.schema)
    return clean


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the hit words and all between them cut out of ``text``; other columns as they came.

    Spans of all blocks are found in the whole text and joined before anything is cut, so the result does not depend on how
    the benchmark is divided, and a cut cannot make or hide a hit.
    """
    marked = docs.withColumn("__print", F.md5(F.col("text").cast("binary")))
    rows = marked.select("doc_id", "text", "__print")
    hits = [scanned(rows, block, window).where(F.size("spans") > 0) for block in item_blocks(benchmark, block_bytes)[1]]
    if not hits:
        return docs
    # rows alike in id and text have the same spans
    folded = reduce(DataFrame.union, hits).groupBy("doc_id", "__print").agg(_merged(F.flatten(F.collect_set("spans"))).alias("__spans"))
    folded = folded.select(F.col("doc_id").alias("__other_id"), F.col("__print").alias("__other_print"), "__spans")
    same = F.col("doc_id").eqNullSafe(F.col("__other_id")) & (F.col("__print") == F.col("__other_print"))
    joined = marked.join(folded, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__spans")
    at = docs.columns.index("text")

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = [cut(t.as_py(), [(s["first"], s["last"]) for s in found or []]) for t, found in zip(batch["text"], spans)]
            columns = [*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(trim, docs.schema)


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without its words from ``first`` to ``last`` of each span, and what lies between them."""
    if not spans:
        return text
    raw, places, at = text.encode(), [], 0
    for word in words_of(text):
        at = _skip(raw, at)
        places.append((at, at + len(word)))
        at += len(word)
    parts, start = [], 0
    for first, last in spans:
        parts.append(raw[start : places[first][0]])
        start = places[last][1]
    return REMOVED.join(part.decode() for part in [*parts, raw[start:]])


def _skip(raw: bytes, at: int) -> int:
    """Where the next word begins."""
    while WORD_BYTES[raw[at]] == 32:
        at += 1
    return at
