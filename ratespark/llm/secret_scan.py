"""Secret scan: patterns propose candidates, a random forest removes the false ones.

Tasks find candidates in whole texts (known key formats, long unbroken strings with a digit, values assigned to a name)
with the text around them. Features are the candidate's length and character classes, how usual its character
transitions are among the corpus's common words, how much of it such words cover, hints in the path, and the words beside
it. Common words are counted over all documents. The forest (Spark ML) is fitted on labelled findings; without any at
hand, ``labelled_findings`` derives them from a bounded number of documents: generated keys in the ways keys are written
down, and checksums, ids, placeholders, numbers and compound words in the ways those are.

Defined cases: null and empty texts have no candidates; a null path gives no hints; repeated rows give repeated findings;
an empty table gives an empty result; very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratespark.llm.lm_scoring import word_counts
from ratespark.llm.text import stored

#: Known formats (fixed values).
FORMATS = (
    ("aws_key", rb"AKIA[0-9A-Z]{16}"),
    ("github_token", rb"gh[pousr]_[0-9A-Za-z]{36}"),
    ("slack_token", rb"xox[abprs]-[0-9A-Za-z-]{10,}"),
    ("google_key", rb"AIza[0-9A-Za-z_-]{35}"),
    ("json_web_token", rb"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    ("stripe_key", rb"[rs]k_live_[0-9A-Za-z]{20,}"),
    ("hex", rb"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})"),
    ("uuid", rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    ("number", rb"[0-9.-]+"),
)
KINDS = re.compile(b"|".join(b"(?P<%s>%s)" % (name.encode(), pattern) for name, pattern in FORMATS))
PRIVATE_KEY = re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
#: Ends at an assignment sign; signs that fill up a code at its end belong to it.
UNBROKEN = re.compile(rb"[0-9A-Za-z+/_.~-]{16,}(?:={1,2}(?![0-9A-Za-z+/_.=~-]))?")
ASSIGNED = re.compile(rb"[0-9A-Za-z_\]-][\"']?[ \t]*[:=]+[ \t]*[\"']?([^\s\"',;]{6,})")
SECRET_WORDS = frozenset(
    "token secret password passwd pwd passphrase apikey api key auth bearer credential credentials private access".split()
)
HARMLESS_WORDS = frozenset(
    "commit sha sha1 sha256 md5 checksum digest hash etag revision uuid id version build order invoice card phone isbn "
    "example sample dummy placeholder test file image page".split()
)
HARMLESS_PATHS = ("test", "example", "sample", "doc", "mock", "fixture")
AROUND = 48
#: Least share of all words that makes a word common; at most 1 / share words reach the driver and the tasks.
DICTIONARY_SHARE = 1 / 100_000
#: Documents from which labelled findings are derived.
LABELLED_DOCUMENTS = 2000
FEATURES = [
    "length", "entropy", "digits", "capitals", "marks", "class_changes", "transitions", "dictionary", "longest_word",
    "known_format", "is_hex", "is_number", "is_uuid", "assigned", "quoted", "secret_word", "harmless_word", "harmless_path",
    "secret_name", "harmless_name",
]
CANDIDATE_SCHEMA = "start long, length long, kind string, value_sha256 string, " + ", ".join(f"f_{f} double" for f in FEATURES)


class Dictionary:
    """The common words: their character transitions, and how much of a string they cover."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        self.words = {w for w, _ in words}
        self.longest = max(map(len, self.words), default=0)
        pairs: Counter = Counter()
        singles: Counter = Counter()
        for word, n in words:
            pairs.update({p: n for p in zip(word, word[1:])})
            singles.update({c: n for c in word[:-1]})
        self.loss = {p: -math.log((n + 1) / (singles[p[0]] + 40)) for p, n in pairs.items()}
        self.unknown = math.log(40)

    def transitions(self, text: str) -> float:
        pairs = list(zip(text, text[1:]))
        return sum(self.loss.get(p, self.unknown) for p in pairs) / len(pairs) if pairs else self.unknown

    def covered(self, text: str) -> tuple[float, int]:
        """Share of the characters inside words, taken greedily from the left, and the longest such word."""
        at = inside = longest = 0
        while at < len(text):
            for size in range(min(self.longest, len(text) - at), 3, -1):
                if text[at : at + size] in self.words:
                    inside += size
                    longest = max(longest, size)
                    at += size
                    break
            else:
                at += 1
        return inside / max(1, len(text)), longest


def candidates(raw: bytes) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, assigned) of the candidates in a text; overlapping ones are joined, up to the longest end."""
    found = [(m.start(), m.end(), "private_key", False) for m in PRIVATE_KEY.finditer(raw)]
    for m in ASSIGNED.finditer(raw):
        if any(c in b"0123456789" for c in m[1]) or any(w in SECRET_WORDS for w in _words(raw[max(0, m.start() - AROUND) : m.start(1)])) or _kind(m[1]):
            found.append((m.start(1), m.end(1), _kind(m[1]) or "assigned", True))
    for m in UNBROKEN.finditer(raw):
        if (kind := _kind(m[0])) or any(c in b"0123456789" for c in m[0]):
            found.append((m.start(), m.end(), kind or "unbroken", False))
    out: list[tuple[int, int, str, bool]] = []
    for start, end, kind, assigned in sorted(found, key=lambda f: (f[0], not f[3], f[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end, kind, assigned))
        elif end > out[-1][1]:
            out[-1] = (out[-1][0], end, _kind(raw[out[-1][0] : end]) or kind, assigned or out[-1][3])
    return out


def _kind(value: bytes) -> str | None:
    m = KINDS.fullmatch(value)
    return m.lastgroup if m else None


def _words(raw: bytes) -> list[str]:
    return re.findall("[a-z]+[0-9]*", raw.decode("utf-8", "replace").lower())


def features(value: bytes, before: bytes, after: bytes, path: str | None, kind: str, assigned: bool, words: Dictionary) -> list[float]:
    text = value.decode("utf-8", "replace")
    counts = Counter(text)
    size = len(text)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "m" for c in text]
    covered, longest = words.covered(text.lower())
    names = _words(before)
    beside = names[-4:] + _words(after)[:2]
    return [
        size, -sum(n / size * math.log2(n / size) for n in counts.values()), classes.count("d") / size, classes.count("u") / size,
        classes.count("m") / size, sum(a != b for a, b in zip(classes, classes[1:])) / size, words.transitions(text.lower()), covered, longest,
        float(kind in ("aws_key", "github_token", "slack_token", "google_key", "json_web_token", "stripe_key", "private_key")),
        float(kind == "hex"), float(kind == "number"), float(kind == "uuid"), float(assigned), float(before[-1:] in (b'"', b"'")),
        float(any(w in SECRET_WORDS for w in beside)), float(any(w in HARMLESS_WORDS for w in beside)),
        float(any(h in (path or "").lower() for h in HARMLESS_PATHS)),
        float(names[-1:] != [] and names[-1] in SECRET_WORDS), float(names[-1:] != [] and names[-1] in HARMLESS_WORDS),
    ]


def common_dictionary(docs: DataFrame, share: float = DICTIONARY_SHARE, text: str = "text") -> list[tuple[str, int]]:
    """The words of four letters and more with at least ``share`` of all words of ``docs``, with their counts."""
    counts = stored(word_counts(docs, text).select(F.decode("word", "UTF-8").alias("word"), "n"))
    total = sum(row.n for row in counts.where("word = ''").collect())
    rows = counts.where("word RLIKE '^[a-z]{4,}$' AND length(word) <= 20").where(F.col("n") >= share * total)
    return [(row.word, row.n) for row in rows.orderBy(F.desc("n"), "word").collect()]


def found_candidates(docs: DataFrame, words: list[tuple[str, int]], keep: list[str]) -> DataFrame:
    """A row per candidate in ``docs`` (``text``, ``path`` and the columns ``keep``) with its features."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    own = [(n, kinds[k]) for n, k in (field.split() for field in CANDIDATE_SCHEMA.split(", "))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary(shared.value)
        for batch in batches:
            rows, at = [], []
            for i, (value, path) in enumerate(zip(batch["text"], batch["path"])):
                raw = value.as_py() or b""
                for start, end, kind, assigned in candidates(raw):
                    found = raw[start:end]
                    before, after = raw[max(0, start - AROUND) : start], raw[end : end + AROUND]
                    place = len(raw[:start].decode("utf-8", "replace"))
                    row = [place, len(found.decode("utf-8", "replace")), kind, hashlib.sha256(found).hexdigest()]
                    rows.append(row + [float(f) for f in features(found, before, after, path.as_py(), kind, assigned, dictionary)])
                    at.append(i)
            index = pa.array(at, pa.int64())
            columns = list(zip(*rows)) if rows else [[] for _ in own]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(index) for c in keep), *(pa.array(c, kind) for c, (_, kind) in zip(columns, own))],
                names=[*keep, *(name for name, _ in own)],
            )

    kept = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in keep)
    return docs.select(*keep, F.encode("text", "UTF-8").alias("text"), "path").mapInArrow(find, f"{kept}, {CANDIDATE_SCHEMA}")


def labelled_findings(docs: DataFrame, documents: int = LABELLED_DOCUMENTS) -> DataFrame:
    """Texts with one finding each (``text``, ``path``, ``label`` 1.0 for a secret), from about ``documents`` documents.

    Every chosen document gives one finding of each way below, made from hashes of its id, between words of its own.
    """
    total = docs.count()
    chosen = docs.where("text IS NOT NULL").sample(min(1.0, documents / max(total, 1)), 11) if total > documents else docs.where("text IS NOT NULL")
    words = F.slice(F.filter(F.split(F.substring("text", 1, 400), "[^A-Za-z]+"), lambda w: F.length(w) > 1), 1, 8)
    digest = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("/secret")).cast("binary"), 512)
    coded = F.translate(F.base64(F.unhex(digest)), "+/=\r\n", "xyz")
    base = chosen.select(
        F.coalesce("doc_id", F.lit(-1)).alias("id"), words.alias("w"), F.coalesce(digest, F.sha2(F.lit("-1").cast("binary"), 512)).alias("h"),
        F.coalesce(coded, F.lit("x")).alias("c"),
    )
    h, c, w = F.col("h"), F.col("c"), F.col("w")

    def hexed(at: int, size: int):
        return F.substring(h, at, size)

    def code(at: int, size: int):
        return F.substring(c, at, size)

    compound = F.array_join(F.slice(w, 1, 4), "-")
    yes = [
        F.concat(F.lit('token = "'), hexed(1, 40), F.lit('"')),
        F.concat(F.lit("api_key: "), code(1, 32)),
        F.concat(F.lit("secret="), hexed(7, 32)),
        F.concat(F.lit("password: "), code(9, 14)),
        F.concat(F.lit("Authorization: Bearer "), code(3, 44)),
        F.concat(F.lit("key AKIA"), F.upper(hexed(5, 16))),
        F.concat(F.lit("use ghp_"), code(11, 36)),
        F.concat(F.lit('"client_secret": "'), code(21, 40), F.lit('"')),
    ]
    no = [
        F.concat(F.lit("commit "), hexed(3, 40)),
        F.concat(F.lit("sha256: "), hexed(1, 64)),
        F.concat(F.lit("md5 = "), hexed(2, 32)),
        F.concat(F.lit("id: "), hexed(1, 8), F.lit("-"), hexed(9, 4), F.lit("-"), hexed(13, 4), F.lit("-"), hexed(17, 4), F.lit("-"), hexed(21, 12)),
        F.concat(F.lit("card "), F.translate(hexed(1, 16), "abcdef", "012345")),
        F.concat(F.lit("see /"), compound, F.lit("/2024/"), F.array_join(F.slice(w, 3, 3), "_"), F.lit(".html")),
        F.concat(F.lit('password = "changeme-example'), F.substring(hexed(1, 1), 1, 1), F.lit('"')),
        F.concat(F.lit("token: XXXXXXXXXXXXXXXXXXXX1")),
        F.concat(F.lit("version: 1."), F.translate(hexed(1, 3), "abcdef", "012345"), F.lit(".0-"), F.get(w, F.lit(0))),
    ]
    made = F.array(*(F.struct(v.alias("v"), F.lit(1.0).alias("label")) for v in yes), *(F.struct(v.alias("v"), F.lit(0.0).alias("label")) for v in no))
    rows = base.select("id", "w", F.posexplode(made).alias("way", "made"))
    return rows.select(
        "id", "way",
        F.concat_ws(" ", F.slice("w", 1, 4), F.col("made.v"), F.slice("w", 5, 4)).alias("text"),
        F.when(F.pmod(F.xxhash64("id", "way"), F.lit(8)) == 0, "src/test/example").otherwise("src/main").alias("path"),
        F.col("made.label").alias("label"),
    ).where("text IS NOT NULL")


def fit_forest(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 5) -> PipelineModel:
    """Assembler and forest fitted on ``findings`` (the feature columns and ``label``)."""
    assembler = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="__features")
    forest = RandomForestClassifier(
        featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, predictionCol="__prediction",
        probabilityCol="__probability", rawPredictionCol="__raw",
    )
    model: RandomForestClassificationModel = forest.fit(assembler.transform(findings))
    return PipelineModel([assembler, model])


def secrets(docs: DataFrame, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """A row per candidate of ``docs``: where it is, what kind, its digest, the forest's score and verdict."""
    words = common_dictionary(docs)
    labelled = labelled_findings(docs)
    training = stored(found_candidates(labelled, words, ["label"]))
    rows = docs.select("doc_id", "text", F.col(path).alias("path"))
    found = found_candidates(rows, words, ["doc_id"])
    both = training.agg(F.count_distinct("label")).first()[0] == 2
    scored = fit_forest(training).transform(found).withColumn("score", vector_to_array("__probability")[1]) if both else found.withColumn("score", F.lit(1.0))
    return scored.select("doc_id", "start", "length", "kind", "value_sha256", "score", (F.col("score") >= threshold).alias("is_secret"))
