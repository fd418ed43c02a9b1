"""Word rules shared by the operators, once as column expressions and once for Python tasks."""

from __future__ import annotations

import gc

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratespark.runtime import shared_dir

WHITE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lower-cases A-Z and turns every byte outside [0-9a-z] and below 0x80 into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MASK = (1 << 64) - 1
#: Words whose hashes a task remembers before it starts afresh.
REMEMBERED_WORDS = 400_000


def spaced(text: Column) -> Column:
    """``text`` with every white space character as a blank; null becomes empty.

    Plain replacements and a split at one character cost a fraction of the same by regular expression.
    """
    out = F.coalesce(text, F.lit(""))
    for mark in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return out


def plain_words(text: Column) -> Column:
    """The runs of anything but white space, as an array; null text has none."""
    return F.array_remove(F.split(spaced(text), " "), "")


def count_words(text: Column) -> Column:
    """Number of runs of anything but white space; 0 for null."""
    return F.size(plain_words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: bytes | str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(WORD_BYTES).split()


class WordHashes:
    """64-bit hashes of words, remembered within a task."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mixed(out + hashes[i : i + count] * np.uint64((2 * i + 3) * 0x9E3779B97F4A7C15 & MASK | 1))
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, without its lineage."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def stored_alone(df: DataFrame) -> DataFrame:
    """``stored``, for frames whose shuffles serve nothing else: Spark deletes these as soon as the rows are written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df.select("*"))
    finally:
        conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Lets Spark delete what finished steps wrote: it drops shuffles and checkpoints of frames that nothing refers to.

    The driver's collector finds those only when it runs, which a job of many small rounds may not make it do for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, share: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row per key), whose ``weight`` says at most how many rows have the key.

    Keys with more than 1/``share`` of the weight, fewer than ``share`` of them whatever the data, are broadcast; all
    others are joined by a shuffle in which no key is large. Both inputs are read twice. ``weight`` is dropped.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * F.lit(share) > F.lit(total)
    heavy, light = F.broadcast(facts.where(hot).drop(weight)), facts.where(~hot).drop(weight)
    few = rows.join(heavy, keys)
    many = rows.join(F.broadcast(facts.where(hot).select(*keys)), keys, "left_anti").join(light, keys, "left")
    return few.unionByName(many)
