"""Cross-entropy difference: documents scored by two matched bigram models.

A target model (documents labelled good) and a background model (all documents) have the same order, smoothing and
vocabulary: every word of the documents. Both are counted over all documents; a pair that a model lacks falls back on its
word frequencies. A document's score is the mean over its words of the loss under the target less the loss under the
background: the lower, the more target-like.

Two lists of words only steer the plan. Pairs of two words with a share of at least ``SHARE`` of all words each are the ones
that many documents share: their counts are added up in tables of at most (1 / SHARE + 1)^2 cells, whatever the corpus, and
go to the tasks. Words with at least ``KNOWN_SHARE`` (at most 1 / KNOWN_SHARE of them) have their own counts sent to the tasks, so
that other pairs of two such words can be dealt by pair. Every pair with a rarer word is dealt by that word (the second if both
are rarer): the part that holds it has all its pairs, counts the word and the pairs and works out their losses. So no
word with more than ``KNOWN_SHARE`` of all words is dealt to one place. Pairs travel in packs, one per task buffer and part, with
their columns' bytes transposed and compressed; the number of parts grows with the corpus, so that a part stays near ``PART_ROWS``
pairs. Nothing of this reaches the driver. Rarer words are told apart by 63 bits of their hash.

Defined cases: null and wordless texts have no losses and a null score; repeated documents and labels: each document row
counts, labels are folded by id first (good only if no label says otherwise); without a target both models rest on the
smoothing alone, which makes all scores depend on the background only; an empty table gives an empty result. Very long texts
are scored whole, in the memory of one text. Columns beside doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratespark.llm.text import REMEMBERED_WORDS, WORD_BYTES, mixed, stored, stored_alone

SHARE = 1 / 2000
KNOWN_SHARE = 1 / 100_000
#: Added to the number of distinct words: the start of a text and eight words never seen.
UNSEEN = 9
#: Pseudo-counts that the word frequencies add to each context.
SMOOTHING = 50.0
COUNTED_WORDS = 300_000
#: Added to a known word that stands second, so that it is no word before the key.
AFTER = 1 << 40
#: Pairs that a task holds before it packs them.
HELD_ROWS = 1_000_000
#: Bytes of text whose words are in memory at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20
#: Pairs that a part is meant to hold.
PART_ROWS = 2_000_000
#: Documents whose losses are meant to be summed in one place.
SUMMED_DOCUMENTS = 20_000


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (bytes) and ``n`` over all of ``docs``; tasks add up their own words before anything moves.

    The empty word, which no text has, stands for all words, so that totals take no second pass.
    """
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def rows(counts: Counter) -> pa.RecordBatch:
        counts[b""] = counts.total()
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch["text"]:
                counts.update((value.as_py() or b"").translate(WORD_BYTES).split())
                if len(counts) > COUNTED_WORDS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    texts = docs.select(F.encode(F.col(text), "UTF-8").alias("text"))
    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WordKeys:
    """Numbers from 1 of known words, and hashes below zero of all others."""

    def __init__(self, words: list[bytes]) -> None:
        self.numbers = {word: i + 1 for i, word in enumerate(words)}
        self.remembered: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        remembered = self.remembered
        if len(remembered) > REMEMBERED_WORDS:
            remembered.clear()
        for word in set(words).difference(remembered):
            remembered[word] = self.numbers.get(word) or -1 - (xxhash.xxh3_64_intdigest(word) >> 1)
        return np.fromiter(map(remembered.__getitem__, words), np.int64, len(words))

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Of all texts: their numbers of words, each word's text, the word, and the word before it (0: none)."""
        tokens = [(value.as_py() or b"").translate(WORD_BYTES).split() for value in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        word = np.concatenate([*map(self, tokens), np.empty(0, np.int64)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        first = np.ones(len(word), bool)
        first[1:] = doc[1:] != doc[:-1]
        return sizes, doc, word, np.where(first, 0, np.roll(word, 1))


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``size`` bytes of text, or of one text."""
    for batch in batches:
        ends = np.cumsum([len(value.as_buffer()) if value.is_valid else 0 for value in batch["text"]])
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end


def all_words(counts: DataFrame) -> int:
    """The number of all words, from ``word_counts``."""
    row = counts.where("length(word) = 0").agg(F.sum("n")).first()
    return row[0] or 0


def frequent_words(counts: DataFrame, share: float) -> list[tuple[bytes, int]]:
    """The words with at least ``share`` of all words, at most 1 / share of them, the most frequent first, with their counts."""
    rows = counts.where(F.length("word") > 0).where(F.col("n") >= share * all_words(counts)).collect()
    return sorted(((bytes(row.word), row.n) for row in rows), key=lambda item: (-item[1], item[0]))


def common_words(docs: DataFrame, share: float = SHARE, text: str = "text") -> list[bytes]:
    return [word for word, _ in frequent_words(stored(word_counts(docs, text)), share)]


class Model:
    """The part of a model that the tasks get: known words' frequencies and contexts, and the losses of listed pairs."""

    def __init__(self, counts: np.ndarray, listed: int, known: int, size: int, smoothing: float = SMOOTHING) -> None:
        pairs, firsts, seconds, total = np.split(counts, np.cumsum([(listed + 1) ** 2, known + 1, known + 1]))
        self.smoothing, self.total, self.size = smoothing, total[0], size
        self.priors = smoothing * (seconds + 0.5) / (self.total + 0.5 * size)
        self.contexts = np.log(firsts + smoothing)
        #: Minus log of p(word | word before).
        self.losses = (self.contexts[: listed + 1, None] - np.log(pairs.reshape(listed + 1, -1) + self.priors[: listed + 1])).astype(np.float32)


def model_counts(marked: DataFrame, words: list[bytes], listed: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows of ``marked`` (``text``, ``target``) and over those of the target, in one array each: pairs of the first
    ``listed`` words, known words as first and as second of a pair, and the total."""
    shared = marked.sparkSession.sparkContext.broadcast(words)
    cells, known = (listed + 1) ** 2, len(words) + 1
    length = cells + 2 * known + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = WordKeys(shared.value)
        sums = np.zeros((2, length), np.int64)
        for batch in slices(batches, 4 * SLICE_BYTES):
            _, doc, word, before = keys.pairs(batch["text"])
            good = batch["target"].to_numpy()[doc] == 1
            both = (word > 0) & (word <= listed) & (before >= 0) & (before <= listed)
            for side, chosen in ((0, ~good), (1, good)):
                at = chosen & both
                sums[side, :cells] += np.bincount(before[at] * (listed + 1) + word[at], minlength=cells)
                sums[side, cells : cells + known] += np.bincount(before[chosen & (before >= 0)], minlength=known)
                sums[side, cells + known : -1] += np.bincount(word[chosen & (word > 0)], minlength=known)
                sums[side, -1] += chosen.sum()
        at = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.sum(axis=0)[at]), pa.array(sums[1][at])], names=["cell", "n", "target"])

    summed = marked.mapInArrow(count, "cell long, n long, target long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("target").alias("target"))
    table = stored_alone(summed).toArrow()  # the shuffled texts go at once
    everything, target = np.zeros(length), np.zeros(length)
    at = table["cell"].to_numpy()
    everything[at], target[at] = table["n"].to_numpy(), table["target"].to_numpy()
    return everything, target


def packed(values: np.ndarray) -> bytes:
    """Whole numbers with their bytes transposed, so that the high ones compress away."""
    raw = np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(pack: bytes) -> np.ndarray:
    n = int.from_bytes(pack[:8], "little")
    raw = pa.Codec("zstd").decompress(pack[8:], 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.int64)[:, 0]


def pair_packs(marked: DataFrame, words: list[bytes], listed: int, models: tuple[Model, Model], parts: int) -> DataFrame:
    """Per document a row with ``own`` (its id, words, and what known counts add to its losses); and packs of all other pairs by ``part``.

    ``key`` is the rarer word, or a number of the pair if both words are known; ``beside`` the word before it, or the known word
    after it plus ``AFTER``. ``tag`` is the document's row times 4, plus 2 in the target, plus 1 if the word has a next one.
    """
    shared = marked.sparkSession.sparkContext.broadcast((words, [(m.losses, m.contexts) for m in models]))
    number = dict(marked.dtypes)["doc_id"]
    names = ["part", "row", "own", "tag", "key", "beside"]

    def packs(held: list[list[np.ndarray]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        tag, key, beside = map(np.concatenate, held)
        part = (mixed(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((key, part))
        found, starts = np.unique(part[order], return_index=True)
        for p, at in zip(found, np.split(order, starts[1:])):
            columns = [pa.array([packed(column[at])], pa.binary()) for column in (tag, key, beside)]
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.nulls(1, pa.int64()), pa.nulls(1, kind), *columns], names=names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables = shared.value
        keys = WordKeys(words)
        held: list[list[np.ndarray]] = [[], [], []]
        kind = None
        for batch in slices(batches, SLICE_BYTES):
            sizes, doc, word, before = keys.pairs(batch["text"])
            both = (word > 0) & (word <= listed) & (before >= 0) & (before <= listed)
            opens = (before >= 0) & ~both
            own = [
                np.bincount(doc[both], losses[before[both], word[both]], len(sizes)) + np.bincount(doc[opens], contexts[before[opens]], len(sizes))
                for losses, contexts in tables
            ]
            rows = batch["row"].to_numpy()
            struct = pa.StructArray.from_arrays(
                [batch["doc_id"], pa.array(sizes), pa.array(own[0], pa.float64()), pa.array(own[1], pa.float64())], ["doc_id", "n", "background", "target"]
            )
            kind, empty = struct.type, pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows % parts), pa.array(rows), struct, empty, empty, empty], names=names)
            follows = np.zeros(len(word), bool)
            follows[:-1] = doc[1:] == doc[:-1]
            at = np.flatnonzero(~both)
            rare, known = word[at] < 0, (word[at] > 0) & (before[at] >= 0)
            held[0].append((rows * 4 + 2 * batch["target"].to_numpy())[doc[at]] + (rare & follows[at]))
            held[1].append(np.where(rare, word[at], np.where(known, (before[at] << 20) + word[at], before[at])))
            held[2].append(np.where(rare, before[at], word[at] + AFTER))
            if sum(map(len, held[0])) > HELD_ROWS:
                yield from packs(held, kind)
                held = [[], [], []]
        if sum(map(len, held[0])):
            yield from packs(held, kind)

    return marked.mapInArrow(find, f"part long, row long, {own_type(number)}, tag binary, key binary, beside binary")


def pair_losses(packs: DataFrame, models: tuple[Model, Model], number: str, places: int) -> DataFrame:
    """The documents' losses in packs by ``place``, besides the rows with ``own``, which go on."""
    shared = packs.sparkSession.sparkContext.broadcast([(m.smoothing, m.priors, m.total, m.size) for m in models])
    names = ["place", "row", "own", "rows", "background", "target"]

    def losses(tag: np.ndarray, beside: np.ndarray, word: np.ndarray, pair: np.ndarray, model: tuple, weights: np.ndarray) -> np.ndarray:
        """Of the pairs of whole words, ``word`` and ``pair`` numbering both."""
        smoothing, priors, total, size = model
        second = beside < AFTER
        count = np.bincount(word, weights * second)[word]
        context = np.log(np.bincount(word, weights * (tag & 1)) + smoothing)[word]
        prior = np.where(second, smoothing * (count + 0.5) / (total + 0.5 * size), priors[np.where(second, 0, beside - AFTER)])
        # The word's own context belongs to the pair after it.
        return (tag & 1) * context - np.log(np.bincount(pair, weights)[pair] + prior)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value

        def sums(held: list[tuple]) -> tuple[np.ndarray, ...]:
            tag, key, beside = (np.concatenate([unpacked(pack[i]) for pack in held]) for i in range(3))
            order = np.lexsort((beside, key))
            tag, key, beside = tag[order], key[order], beside[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            word = np.cumsum(new) - 1
            new[1:] |= beside[1:] != beside[:-1]
            pair = np.cumsum(new) - 1
            weights = (np.ones(len(tag)), (tag >> 1 & 1).astype(float))
            both = [losses(tag, beside, word, pair, m, w) for m, w in zip(models, weights)]
            return added(tag >> 2, *both)

        def packs(found: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            row, *both = added(*map(np.concatenate, zip(*found)))
            place = (mixed(row.view(np.uint64)) % np.uint64(places)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            goals, starts = np.unique(place[order], return_index=True)
            for goal, at in zip(goals, np.split(order, starts[1:])):
                columns = [packed(row[at]), *(values[at].astype(np.float32).tobytes() for values in both)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([goal]), pa.nulls(1, pa.int64()), pa.nulls(1, kind), *(pa.array([c], pa.binary()) for c in columns)], names=names
                )

        held: list[tuple] = []
        found: list[tuple] = []
        part, kind = None, None
        for batch in batches:
            kind = batch.schema.field("own").type
            own = batch.filter(batch["own"].is_valid())
            if len(own):
                yield pa.RecordBatch.from_arrays([own["row"], own["row"], own["own"], *[pa.nulls(len(own), pa.binary())] * 3], names=names)
            others = batch.filter(batch["own"].is_null())
            for p, *columns in zip(others["part"].to_pylist(), *(others[name] for name in ("tag", "key", "beside"))):
                if p != part and held:
                    found.append(sums(held))
                    held = []
                    if sum(len(f[0]) for f in found) > HELD_ROWS:
                        yield from packs(found, kind)
                        found = []
                part = p
                held.append(tuple(column.as_py() for column in columns))
        if held:
            found.append(sums(held))
        if found:
            yield from packs(found, kind)

    dealt = packs.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(work, f"place long, row long, {own_type(number)}, rows binary, background binary, target binary")


def added(row: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows, and their sums."""
    found, at = np.unique(row, return_inverse=True)
    return found, *(np.bincount(at, v, len(found)) for v in values)


def own_type(number: str) -> str:
    return f"own struct<doc_id: {number}, n: long, background: double, target: double>"


def document_sums(packs: DataFrame, number: str) -> DataFrame:
    """Two rows per document at most: ``row``, ``doc_id`` and ``n`` (in one of them), ``background`` and ``target``."""
    names = ["row", "doc_id", "n", "background", "target"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def whole(held: list[tuple]) -> pa.RecordBatch:
            row, *both = added(*map(np.concatenate, zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(row), pa.nulls(len(row), kind), pa.nulls(len(row), pa.int64()), *map(pa.array, both)], names=names)

        held: list[tuple] = []
        place, size = None, 0
        for batch in batches:
            kind = batch.schema.field("own").type[0].type
            own = batch.filter(batch["own"].is_valid())
            if len(own):
                yield pa.RecordBatch.from_arrays([own["row"], *own["own"].flatten()], names=names)
            others = batch.filter(batch["own"].is_null())
            for p, rows, *both in zip(others["place"].to_pylist(), others["rows"], others["background"], others["target"]):
                if p != place and held:
                    yield whole(held)
                    held, size = [], 0
                place = p
                held.append((unpacked(rows.as_py()), *(np.frombuffer(b.as_py(), np.float32).astype(float) for b in both)))
                size += len(held[-1][0])
                if size > HELD_ROWS:  # the sums so far take their place
                    held = [added(*map(np.concatenate, zip(*held)))]
                    size = 0
        if held:
            yield whole(held)

    dealt = packs.repartition("place").sortWithinPartitions("place")
    return dealt.mapInArrow(work, f"row long, doc_id {number}, n long, background double, target double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of ``docs``, the target being the documents that ``labels`` call good (quality 1, toxic 0)."""
    counts = stored_alone(word_counts(docs))
    total = all_words(counts)
    known = frequent_words(counts, KNOWN_SHARE)
    words, listed = [word for word, _ in known], sum(n >= SHARE * total for _, n in known)
    size = counts.where(F.length("word") > 0).count() + UNSEEN
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(
        F.min(F.when((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.encode("text", "UTF-8").alias("text"))
    joined = rows.join(good.hint("merge"), F.col("doc_id") == F.col("__id"), "left")  # labels grow with the documents: never broadcast
    marked = joined.select("row", "doc_id", "text", F.coalesce("good", F.lit(0)).alias("target"))
    models = tuple(Model(table, listed, len(words), size) for table in model_counts(marked.select("text", "target"), words, listed))
    packs = pair_packs(marked, words, listed, models, max(1, -(-total // PART_ROWS)))
    number = dict(docs.dtypes)["doc_id"]
    parts = document_sums(pair_losses(packs, models, number, max(1, -(-docs.count() // SUMMED_DOCUMENTS))), number)
    summed = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_words"), F.sum("target").alias("target"), F.sum("background").alias("background")
    )
    # A wordless text has no losses.
    scores = summed.select("doc_id", "n_words", *((F.col(side) / F.when(F.col("n_words") > 0, F.col("n_words"))).alias(f"{side}_loss") for side in ("target", "background")))
    return scores.withColumn("score", F.col("target_loss") - F.col("background_loss"))
