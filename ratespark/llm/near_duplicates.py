"""Near duplicates by Order MinHash.

A text's words (lower-cased, punctuation dropped) give its runs of five words, labelled by occurrence so that a repeated
run counts as often as it stands there. Each of ``SKETCHES`` hash functions picks the ``RUNS`` runs with the smallest
hashes and keeps them in text order; the ordered picks are one bucket key. Texts that agree on a key are candidates.
A candidate pair is linked if an alignment of the two sequences of runs, restricted to the band that the threshold
allows, matches m of them with m / (n1 + n2 - m) >= 0.8. Classes are the connected components of the links.

Pairs are compared without listing a bucket's pairs: texts equal in their words are folded first; every text of a bucket
is then compared with the bucket's most connected text. Texts of one bucket that are still in different classes are the
rest. In a bucket of few texts these are compared with each other. In larger buckets an exact filter comes first: two
texts that reach the threshold must share a run among the rarest of each, so many as their lengths allow to differ; a
text changed in too many places has only runs of its own there and meets nobody. Nothing is capped. Texts of few runs, whose
sketches miss more, all go through that filter, whatever their buckets.

Defined cases: a null text and a null id are in no class but their own, rows with a null id get a null class; texts
without words are alike if they are equal; texts of fewer than five words are alike if their words are equal; repeated
rows get the same class; very long texts are sketched and aligned whole, in the memory of one pair; columns beside id and text
are never read, whatever their names; an empty table gives an empty result. The class id is the smallest doc_id in the class.
Ids are whole numbers. Where unlike texts share their smallest id, one of them goes by the id and each other by a number from
``UNNAMED`` on, made of its fingerprint: they are told apart by 62 bits, and such a number is the class id if no id is in the class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratespark.llm.text import WordHashes, looked_up, mixed, ngrams, release, stored, words_of

RUN_WORDS = 5
THRESHOLD = 0.8
#: With 4 picks in 24 sketches a long pair at the threshold shares no key once in 300,000, a pair of 18 runs once in 80,000.
SKETCHES = 24
RUNS = 4
#: Buckets of up to so many texts list the pairs of their rest; larger ones filter by rare runs first.
FEW = 8
#: Pairs of which one text has up to so many runs are found by rare runs alone, which is exact.
SHORT = 20
#: Numbers of texts whose smallest id another text goes by; ids lie below.
UNNAMED = 1 << 62
#: Hashes held at once for one text, whatever its length.
HASHED_AT_ONCE = 1 << 20
SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

SKETCH_SCHEMA = "doc_id long, content binary, print binary, runs long, keys array<long>"


def labelled_runs(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Hashes of the runs of five words in text order, each with its occurrence number mixed in."""
    runs = ngrams(hashes(words), RUN_WORDS)
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return runs
    starts = np.flatnonzero(new)
    occurrence = np.empty(len(runs), np.uint64)
    occurrence[order] = np.arange(len(runs)) - np.repeat(starts, np.diff(np.append(starts, len(runs))))
    return np.where(occurrence > 0, mixed(runs + occurrence * np.uint64(0xD6E8FEB86659FD93)), runs)


def order_min_hash(runs: np.ndarray) -> np.ndarray:
    """One key per hash function: the runs with the smallest hashes, in text order."""
    picks = min(RUNS, len(runs))
    if not picks:
        return np.empty(0, np.uint64)
    keys = []
    at_once = max(1, HASHED_AT_ONCE // len(runs))
    for i in range(0, SKETCHES, at_once):
        seeds = SEEDS[i : i + at_once, None]
        scrambled = (runs ^ seeds) * np.uint64(0x9FB21C651E98DF25)
        scrambled ^= scrambled >> np.uint64(32)
        chosen = np.sort(np.argpartition(scrambled, picks - 1, axis=1)[:, :picks], axis=1)
        picked = runs[chosen] + seeds
        key = np.zeros(len(seeds), np.uint64)
        for k in range(picks):
            key = mixed(key + picked[:, k] * np.uint64(2 * k + 3))
        keys.append(key)
    return np.concatenate(keys)


def fingerprint(words: list[bytes], text: bytes) -> bytes:
    return hashlib.md5(b" ".join(words) if words else b"\0" + text).digest()


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: MD5 of the text, fingerprint, number of runs and keys. Null text: neither digest."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("print", pa.binary()), ("runs", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            contents, prints, counts, keys = [], [], [], []
            for value in batch["text"]:
                content = value.as_py()
                words = words_of(content)
                runs = labelled_runs(words, hashes)
                contents.append(None if content is None else hashlib.md5(content).digest())
                prints.append(None if content is None else fingerprint(words, content))
                counts.append(len(runs))
                keys.append(order_min_hash(runs).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(contents, pa.binary()), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                schema=schema,
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("text"))
    return rows.mapInArrow(sketch, SKETCH_SCHEMA)


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose matches lie at most ``band`` places off the diagonal.

    Common ends are set aside. The rest is done a row of the table at a time, a bit per column: a bit that goes out
    marks a column where the count steps up.
    """
    start, end = 0, 0
    shorter = min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return start + end
    places: dict[int, int] = {}
    for i, run in enumerate(a):
        places[run] = places.get(run, 0) | 1 << i
    everything = (1 << len(a)) - 1
    flat = everything
    window = (1 << 2 * band + 1) - 1
    for j, run in enumerate(b):
        if (match := places.get(run)) is not None:
            near = window << j - band if j > band else window >> band - j
            common = flat & match & near
            flat = (flat + common | flat - common) & everything
    return start + end + len(a) - flat.bit_count()


def alike(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether the aligned runs make up the threshold's share of all runs."""
    total = len(a) + len(b)
    need = threshold * total / (1 + threshold)
    if min(len(a), len(b)) < need - 1e-9 or not total:
        return False
    band = int(total - 2 * need + 1e-9)
    return aligned(a.tolist(), b.tolist(), band) >= need - 1e-9


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of ids whose ``texts`` (``doc_id``, ``text``) pass the alignment."""
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: dict[str, tuple] = {"text_a": (None, None), "text_b": (None, None)}

        def runs_of(side: str, value) -> np.ndarray:
            content = value.as_py()
            if last[side][0] != content:
                last[side] = (content, labelled_runs(words_of(content), hashes))
            return last[side][1]

        for batch in batches:
            keep = [
                alike(runs_of("text_a", x), runs_of("text_b", y)) for x, y in zip(batch["text_a"], batch["text_b"])
            ]
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep, pa.bool_())), batch["b"].filter(pa.array(keep, pa.bool_()))], schema=schema)

    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node it is connected to, ``root``, for every node that has an edge.

    Stars alternate: each node hands its larger neighbours to its smallest one, then its smaller neighbours likewise.
    Every round is stored, so a lost executor costs one round. Rounds grow with the logarithm of the longest path.
    """
    pairs = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(small.union(lower.select("u", F.col("m").alias("v"))).distinct())
        del both, least, large, lower, small
        release(edges.sparkSession)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v"), F.col("v")).distinct()
    )


def pairs_by_rare_runs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) of ``nodes`` (node, runs, root) with different roots that may reach the threshold.

    Runs are ordered from rare to frequent, the same way in every text. Texts of n1 and n2 runs that share
    need = 4/9 (n1 + n2) of them share one of the first n1 - need + 1 of the one and n2 - need + 1 of the other; so only
    these are joined. Runs that occur once are counted but never sent on.
    """
    schema = pa.schema([("node", pa.int64()), ("run", pa.int64())])

    def list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"]):
                runs = labelled_runs(words_of(text.as_py()), hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), node.as_py())), pa.array(runs)], schema=schema)

    owners = texts.select(F.col("doc_id").alias("node"), "text").join(nodes.select("node"), "node", "left_semi")
    runs = stored(owners.mapInArrow(list_runs, "node long, run long").distinct())
    common = runs.groupBy("run").agg(F.count("*").alias("frequency")).where("frequency > 1")
    own = Window.partitionBy("node")
    placed = runs.join(common, "run").select(
        "node", "run", F.row_number().over(own.orderBy("frequency", "run")).alias("at"), F.count("*").over(own).alias("shared")
    )
    placed = placed.join(nodes, "node").withColumn("at", F.col("runs") - F.col("shared") + F.col("at") - 1)
    first = placed.where(f"at <= runs - {THRESHOLD} * runs + 1e-9").select("run", "node", "runs", "root", "at")
    # A run that only texts of one component list joins nobody: large groups of copies go here.
    apart = first.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    first = first.join(apart.select("run"), "run", "left_semi")
    other = first.select("run", *(F.col(c).alias(f"{c}_b") for c in ("node", "runs", "root", "at")))
    need = f"({THRESHOLD / (1 + THRESHOLD)} * (runs + runs_b) - 1e-9)"
    joined = first.join(other, "run").where("node < node_b AND root != root_b").where(_comparable("runs", "runs_b"))
    return joined.where(f"at <= runs - {need} AND at_b <= runs_b - {need}").select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def named_prints(rows: DataFrame) -> DataFrame:
    """``print``, its smallest id ``low`` and its ``node``: that id, or a number of its own if another text goes by the id."""
    prints = stored(rows.where("doc_id IS NOT NULL AND print IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("low")))
    shared = stored(prints.groupBy("low").agg(F.min("print").alias("first"), F.count("*").alias("n")).where("n > 1"))
    own = F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64("print"), 2)
    return looked_up(prints, shared, ["low"], "n").select(
        "print", "low", F.when(F.col("print") != F.col("first"), own).otherwise(F.col("low")).alias("node")
    )


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id for every row of ``docs``."""
    return classed(docs, doc_id, text).select("doc_id", "class_id")


def classed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``content`` (the text's MD5) and class_id for every row of ``docs``."""
    rows = stored(sketches(docs, doc_id, text))
    prints = stored(named_prints(rows))
    nodes = rows.join(prints, "print").where("doc_id = low").select("node", "doc_id", "content", "runs", "keys")
    buckets = nodes.select("node", "runs", F.explode(F.array_distinct("keys")).alias("key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = stored(buckets.join(crowded, "key").select("key", "n", "node", "runs"))

    degrees = live.groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = live.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", -F.col("node"), "runs")).alias("l"))
    leaders = leaders.select("key", (-F.col("l.col2")).alias("leader"), F.col("l.runs").alias("leader_runs"))
    stars = stored(
        live.join(leaders, "key").where("node != leader").where(_comparable("runs", "leader_runs"))
        .groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    )
    few_runs = f"runs > 0 AND runs <= {SHORT / THRESHOLD}"
    met = degrees.select("node", F.lit(True).alias("met"))
    wanted = nodes.join(met, "node", "left").where(f"met OR {few_runs}").select("node", "doc_id", "content").distinct()
    texts = stored(
        docs.select(
            F.col(doc_id).cast("long").alias("__id"), F.unhex(F.md5(F.col(text))).alias("content"), F.encode(F.col(text), "UTF-8").alias("text")
        ).join(wanted.withColumnRenamed("doc_id", "__id"), ["__id", "content"]).select(F.col("node").alias("doc_id"), "text")
    )
    # In waves: a text first meets only the leader it shares most buckets with, so its text moves once. Most texts are then
    # linked, and of the other pairs only those between different components are left to try.
    best = stars.groupBy("b").agg(F.max(F.struct("shared", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    wave = stored(linked(best, texts))
    found = components(wave)
    others = stars.select("a", "b").join(best, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        named = found.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        others = others.join(named, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    links = stored(wave.union(linked(others.where("root_a != root_b").select("a", "b"), texts)))
    del wave, found, others, named
    release(docs.sparkSession)
    roots = components(links)

    placed = live.join(roots, "node", "left").select("key", "n", "node", "runs", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    rest = stored(placed.join(split.select("key"), "key", "left_semi"))
    few = rest.where(f"n <= {FEW}").select("key", "node", "runs", "root")
    other = few.select("key", *(F.col(c).alias(f"{c}_b") for c in ("node", "runs", "root")))
    listed = few.join(other, "key").where("node < node_b AND root != root_b").where(_comparable("runs", "runs_b"))
    many = rest.where(f"n > {FEW}").select("node", "runs", "root").distinct()
    short = nodes.where(few_runs).join(roots, "node", "left").select("node", "runs", F.coalesce("root", "node").alias("root"))
    filtered = pairs_by_rare_runs(many.union(short).distinct(), texts)
    apart = listed.select(F.col("node").alias("a"), F.col("node_b").alias("b")).union(filtered).distinct()

    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = linked(apart.join(tried, ["a", "b"], "left_anti"), texts)
    final = components(links.union(more))

    classes = prints.join(final, "node", "left").select("print", F.coalesce("root", "node").alias("__class"))
    return rows.select("doc_id", "content", "print").join(classes, "print", "left").select(
        "doc_id", "content", F.when(F.col("doc_id").isNotNull(), F.coalesce("__class", "doc_id")).alias("class_id")
    )


def _comparable(runs: str, other: str) -> str:
    """Only texts whose numbers of runs are this close can reach the threshold."""
    return f"least({runs}, {other}) >= {THRESHOLD} * greatest({runs}, {other}) - 1e-9"


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the smallest id (then MD5 of the text), with its columns as they came.

    Rows with a null id or a null text stay. Rows are told apart by id and text, so unlike texts that share an id each stay.
    """
    alone = "doc_id IS NULL OR text IS NULL"
    kept = classed(docs).where("doc_id IS NOT NULL AND content IS NOT NULL").groupBy("class_id")
    kept = kept.agg(F.min(F.struct("doc_id", "content")).alias("__k")).select(F.col("__k.doc_id").alias("__id"), F.col("__k.content").alias("__of"))
    texts = docs.where(f"NOT ({alone})").withColumns({"__id": F.col("doc_id").cast("long"), "__of": F.unhex(F.md5("text"))})
    one = texts.join(kept, ["__id", "__of"], "left_semi").dropDuplicates(["__id", "__of"]).drop("__id", "__of")
    return one.unionByName(docs.where(alone))
