"""License scan by ordered signature rules.

Every rule is a regular expression over the normalised words of a text (lower-cased, joined by single blanks) with a
label, a priority and the keywords that must occur before it is tried. Matches are intervals of words. Where intervals
overlap, a match that lies inside one of equal or higher priority is suppressed, then the better of what still overlaps
stays: higher priority, then longer, then earlier, then the rule's place in the order. Base phrases are reported besides
and never suppressed.

Defined cases: null and wordless texts have no matches and score 0; repeated rows are judged one by one; very long texts
are scanned whole, in time that grows with their words and matches; columns beside doc_id and text are never read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratespark.llm.text import WORD_BYTES

#: Phrases of the base and their labels (fixed values).
BASE_PHRASES = {
    b"under the mit license": "mit",
    b"apache license version 2": "apache-2",
    b"cc by nc": "cc-by-nc",
}

#: Label, name as a pattern over words, and words of which one must occur (fixed values).
NAMES = (
    ("mit", "(?:the )?mit", "mit"),
    ("mit-0", "mit (?:no attribution|0)", "mit"),
    ("x11", "(?:the )?x11", "x11"),
    ("apache-1", "(?:the )?apache(?: software)?(?: license)?(?: version)? (?:v )?1 [01]", "apache"),
    ("apache-2", "(?:the )?apache(?: software)?(?: license)?(?: version)? (?:v )?2(?: 0)?", "apache"),
    ("bsd-2-clause", "(?:the )?(?:simplified |freebsd )?bsd 2 clause|(?:the )?(?:simplified|freebsd) bsd", "bsd"),
    ("bsd-3-clause", "(?:the )?(?:new |modified |revised )?bsd 3 clause|(?:the )?(?:new|modified|revised) bsd", "bsd"),
    ("bsd-4-clause", "(?:the )?(?:original )?bsd 4 clause|(?:the )?original bsd", "bsd"),
    ("bsd-0-clause", "(?:zero clause bsd|0bsd|bsd zero clause)", "clause|0bsd"),
    ("isc", "(?:the )?isc", "isc"),
    ("zlib", "(?:the )?zlib(?: libpng)?", "zlib"),
    ("gpl-1", "(?:the )?(?:gnu )?(?:general public license|gpl)(?: version)? ?v? ?1(?: 0)?", "general public license|gpl"),
    ("gpl-2", "(?:the )?(?:gnu )?(?:general public license|gpl)(?: version)? ?v? ?2(?: 0)?", "general public license|gpl"),
    ("gpl-3", "(?:the )?(?:gnu )?(?:general public license|gpl)(?: version)? ?v? ?3(?: 0)?", "general public license|gpl"),
    ("lgpl-2.1", "(?:the )?(?:gnu )?(?:lesser general public license|lgpl)(?: version)? ?v? ?2 1", "lesser general|lgpl"),
    ("lgpl-3", "(?:the )?(?:gnu )?(?:lesser general public license|lgpl)(?: version)? ?v? ?3(?: 0)?", "lesser general|lgpl"),
    ("agpl-3", "(?:the )?(?:gnu )?(?:affero general public license|agpl)(?: version)? ?v? ?3(?: 0)?", "affero|agpl"),
    ("gfdl-1.3", "(?:the )?(?:gnu )?(?:free documentation license|gfdl|fdl)(?: version)? 1 3", "free documentation|fdl"),
    ("mpl-1.1", "(?:the )?(?:mozilla public license|mpl)(?: version)? ?v? ?1 1", "mozilla|mpl"),
    ("mpl-2.0", "(?:the )?(?:mozilla public license|mpl)(?: version)? ?v? ?2(?: 0)?", "mozilla|mpl"),
    ("epl-1.0", "(?:the )?(?:eclipse public license|epl)(?: version)? ?v? ?1 0", "eclipse|epl"),
    ("epl-2.0", "(?:the )?(?:eclipse public license|epl)(?: version)? ?v? ?2 0", "eclipse|epl"),
    ("cddl-1.0", "(?:the )?(?:common development and distribution license|cddl)(?: version)? 1 0", "common development|cddl"),
    ("cddl-1.1", "(?:the )?(?:common development and distribution license|cddl)(?: version)? 1 1", "common development|cddl"),
    ("eupl-1.2", "(?:the )?(?:european union public licence|eupl)(?: version)? ?v? ?1 2", "european union|eupl"),
    ("artistic-1.0", "(?:the )?artistic(?: license)? 1 0", "artistic"),
    ("artistic-2.0", "(?:the )?artistic(?: license)? 2 0", "artistic"),
    ("bsl-1.0", "(?:the )?boost software(?: license)?(?: version)? 1 0", "boost"),
    ("python-2.0", "(?:the )?(?:python software foundation|psf)(?: license)?(?: version)? 2", "python software|psf"),
    ("postgresql", "(?:the )?postgresql", "postgresql"),
    ("openssl", "(?:the )?openssl", "openssl"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "(?:the )?(?:do what the fuck you want to public|wtfpl)", "what the fuck|wtfpl"),
    ("cc0-1.0", "(?:the )?(?:creative commons zero|cc0|cc zero)(?: v? ?1 0)?", "creative commons|cc0|cc zero"),
    ("cc-by", "(?:the )?(?:creative commons attribution|cc by)", "creative commons|cc by"),
    ("cc-by-sa", "(?:the )?(?:creative commons attribution share ?alike|cc by sa)", "creative commons|cc by"),
    ("cc-by-nd", "(?:the )?(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)", "creative commons|cc by"),
    ("cc-by-nc", "(?:the )?(?:creative commons attribution non ?commercial|cc by nc)", "creative commons|cc by"),
    ("cc-by-nc-sa", "(?:the )?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)", "creative commons|cc by"),
    ("cc-by-nc-nd", "(?:the )?(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)", "creative commons|cc by"),
    ("odbl-1.0", "(?:the )?(?:open data commons open database|odbl|odc odbl)(?: v? ?1 0)?", "open data|odbl"),
    ("odc-by-1.0", "(?:the )?(?:open data commons attribution|odc by)(?: v? ?1 0)?", "open data|odc by"),
    ("pddl-1.0", "(?:the )?(?:public domain dedication and license|pddl)(?: v? ?1 0)?", "public domain dedication|pddl"),
    ("ofl-1.1", "(?:the )?(?:sil )?open font(?: license)?(?: version)?(?: 1 1)?", "font"),
    ("lppl-1.3", "(?:the )?(?:latex project public license|lppl)(?: version)? 1 3c?", "latex|lppl"),
    ("ms-pl", "(?:the )?(?:microsoft public|ms pl)", "microsoft|ms pl"),
    ("ms-rl", "(?:the )?(?:microsoft reciprocal|ms rl)", "microsoft|ms rl"),
    ("openrail", "(?:the )?(?:bigscience |creativeml )?open ?rail(?: m)?", "rail"),
    ("llama", "(?:the )?llama [0-9](?: [0-9])? community", "llama"),
    ("proprietary", "(?:a |the )?(?:proprietary|commercial)", "proprietary|commercial"),
    # Families, where no version is given; a versioned name is longer and wins.
    ("gpl", "(?:the )?(?:gnu )?(?:general public license|gpl)", "general public license|gpl"),
    ("lgpl", "(?:the )?(?:gnu )?(?:lesser general public license|lgpl)", "lesser general|lgpl"),
    ("agpl", "(?:the )?(?:gnu )?(?:affero general public license|agpl)", "affero|agpl"),
    ("mpl", "(?:the )?(?:mozilla public license|mpl)", "mozilla|mpl"),
    ("epl", "(?:the )?(?:eclipse public license|epl)", "eclipse|epl"),
    ("bsd", "(?:the |a )?bsd", "bsd"),
    ("apache", "(?:the )?apache(?: software)?", "apache"),
)
#: Ways to state a license: pattern around the name, priority, keyword, confidence (fixed values).
STATEMENTS = (
    ("spdx license identifier {}", 5, "spdx", 1.0),
    ("licensed under (?:the terms of )?{}(?: licen[cs]e)?(?: version)?", 4, "licensed", 0.95),
    ("(?:released|distributed|published|available|provided) under (?:the terms of )?{}(?: licen[cs]e)?", 4, "under", 0.95),
    ("(?:is|are) (?:subject to|governed by|covered by) (?:the terms of )?{}(?: licen[cs]e)?", 4, "by|subject", 0.9),
    ("under (?:the terms of )?{} licen[cs]e", 3, "under", 0.85),
    ("licen[cs]e (?:is )?{}", 2, "licen", 0.7),
    ("{} (?:international )?(?:public )?licen[cs]e", 2, "licen", 0.6),
)
#: Signatures of license texts and general notices: label, pattern, priority, keyword, confidence (fixed values).
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5, "hereby", 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 5, "permission", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification", 5, "redistribution", 0.9),
    ("gpl-3", "gnu general public license version 3", 4, "gnu", 0.95),
    ("gpl-2", "gnu general public license version 2", 4, "gnu", 0.95),
    ("gpl-or-later", "either version [0-9](?: [0-9])? of the license or at your option any later version", 4, "later", 0.9),
    ("gpl", "this (?:program|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license", 4, "gnu", 0.95),
    ("lgpl", "this (?:library|program|software) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 4, "lesser", 0.95),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", 4, "affero", 0.95),
    ("apache-2", "you may not use this file except in compliance with the license", 4, "compliance", 0.9),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license", 4, "applicable", 0.9),
    ("apache-2", "apache (?:version )?v?2(?: 0)?", 1, "apache", 0.6),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", 5, "mozilla", 1.0),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products", 5, "endorse", 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", 5, "advertising", 1.0),
    ("zlib", "the origin of this software must not be misrepresented", 5, "misrepresented", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5, "unencumbered", 1.0),
    ("bsl-1.0", "to any person or organization obtaining a copy of the software and accompanying documentation", 5, "organization", 1.0),
    ("wtfpl", "you just do what the fuck you want to", 5, "what the fuck", 1.0),
    ("public-domain", "(?:dedicated to|released into|placed in|in) the public domain", 3, "domain", 0.8),
    ("all-rights-reserved", "all rights reserved", 1, "reserved", 0.5),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 1, "copyright", 0.3),
)


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: re.Pattern
    priority: int
    keywords: tuple[tuple[bytes, ...], ...]
    confidence: float
    order: int


def signatures() -> list[Signature]:
    """All rules in order: each way to state a license with each name, then the signatures of texts."""
    rows = [
        (label, statement.format(f"(?:{name})"), priority, (keyword, own), confidence)
        for statement, priority, keyword, confidence in STATEMENTS for label, name, own in NAMES
    ] + [(label, pattern, priority, (keyword,), confidence) for label, pattern, priority, keyword, confidence in TEXTS]
    return [
        Signature(label, re.compile(f" (?:{pattern})(?= )".encode()), priority,
                  tuple(tuple(k.encode() for k in keyword.split("|")) for keyword in keywords), confidence, order)
        for order, (label, pattern, priority, keywords, confidence) in enumerate(rows)
    ]


def base_places(line: bytes) -> list[tuple[int, str]]:
    """Start (in words) and label of every occurrence of a base phrase in `` word word ... ``."""
    found = []
    for phrase, label in BASE_PHRASES.items():
        word, counted = 0, 0
        at = line.find(b" " + phrase + b" ")
        while at >= 0:
            word, counted = word + line.count(b" ", counted, at), at
            found.append((word, label))
            at = line.find(b" " + phrase + b" ", at + 1)
    return sorted(found)


@dataclass(frozen=True)
class Match:
    first: int
    last: int
    rule: Signature

    def rank(self) -> tuple:
        return (-self.rule.priority, self.first - self.last, self.first, self.rule.order)


class Scanner:
    """The rules by the keywords of what they name, so that a text without these words costs a few searches."""

    def __init__(self) -> None:
        self.groups: dict[tuple[bytes, ...], list[Signature]] = {}
        for rule in signatures():
            self.groups.setdefault(rule.keywords[-1], []).append(rule)

    def matches(self, line: bytes) -> list[Match]:
        found = []
        for keywords, rules in self.groups.items():
            if any(k in line for k in keywords):
                for rule in rules:
                    if any(k in line for k in rule.keywords[0]):
                        first, counted = 0, 0
                        for m in rule.pattern.finditer(line):
                            first, counted = first + line.count(b" ", counted, m.start()), m.start()
                            found.append(Match(first, first + m[0].count(b" ") - 1, rule))
        return suppressed(found)


def suppressed(matches: list[Match]) -> list[Match]:
    """The matches that stay, none overlapping another: the best first, each unless a kept one overlaps it."""
    best = sorted(matches, key=Match.rank)
    starts = sorted({m.first for m in best})
    # For each start, in a tree of maxima, how far the better matches from there or before reach.
    reach = [-1] * (len(starts) + 1)
    kept: list[tuple[int, int, Match]] = []
    for m in best:
        at = place = bisect_left(starts, m.first) + 1
        inside = False
        while at:
            inside = inside or reach[at] >= m.last
            at &= at - 1
        while place < len(reach):
            reach[place] = max(reach[place], m.last)
            place += place & -place
        if not inside:
            after = bisect_left(kept, m.first, key=lambda k: k[0])
            if (after == 0 or kept[after - 1][1] < m.first) and (after == len(kept) or m.last < kept[after][0]):
                kept.insert(after, (m.first, m.last, m))
    return [m for *_, m in kept]


FINDINGS_SCHEMA = (
    "n_words long, base array<struct<word:int,label:string>>, "
    "found array<struct<first:int,last:int,label:string,priority:int,confidence:double>>"
)


def license_findings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base phrases and the matches that stay, for every row of ``docs``."""
    base_type = pa.list_(pa.struct([("word", pa.int32()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([
        ("first", pa.int32()), ("last", pa.int32()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())
    ]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            counts, base, found = [], [], []
            for value in batch["text"]:
                words = (value.as_py() or b"").translate(WORD_BYTES).split()
                line = b" " + b" ".join(words) + b" "
                counts.append(len(words))
                base.append([{"word": at, "label": label} for at, label in base_places(line)])
                found.append([
                    {"first": m.first, "last": m.last, "label": m.rule.label, "priority": m.rule.priority, "confidence": m.rule.confidence}
                    for m in scanner.matches(line)
                ])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(base, base_type), pa.array(found, found_type)],
                names=["doc_id", "n_words", "base", "found"],
            )

    rows = docs.select("doc_id", F.encode("text", "UTF-8").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, {FINDINGS_SCHEMA}")


def summarised(findings: DataFrame) -> DataFrame:
    """The digest of ``license_findings``, a row each."""
    starts = F.transform("base", lambda b: b["word"])
    base = F.transform("base", lambda b: b["label"])
    labels = F.concat(base, F.transform("found", lambda f: f["label"]))
    # A base phrase is a sure finding; other matches count with their rule's confidence.
    score = F.greatest(
        F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda f: f["confidence"])), F.lit(0.0))
    )
    return findings.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"), score.alias("score"),
    )
