import random
import re

from llm_helpers import prose, words
from ratespark.llm import license_scan as ls

SAMPLES = [
    (1, "Released under the MIT License.", "mit"), (2, "Licensed under the Apache License, Version 2.0.", "apache-2"),
    (3, "Licensed under CC BY-NC 4.0.", "cc-by-nc"), (4, "This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    (5, "SPDX-License-Identifier: MPL-2.0", "mpl-2.0"), (6, "Licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
    (7, "available under the terms of the GNU Lesser General Public License v2.1", "lgpl-2.1"),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), (9, "All rights reserved.", "all-rights-reserved"),
    (10, "a plain text about permission and the public", ""), (11, "under the MIT License under the MIT license", "mit"),
    (12, "Licensed under GPLv3", "gpl-3"), (13, "LGPLv2.1 license", "lgpl-2.1"), (14, "Licensed under the GPL", "gpl"), (15, "AGPLv3 license", "agpl-3"),
    (16, "BSD license", "bsd"), (17, "Apache 2.0", "apache-2"), (18, "MPLv2 license", "mpl-2.0"), (19, "licensed under LGPLv3", "lgpl-3"),
    (20, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
]


def test_hundreds_of_rules_and_known_statements(spark, make_docs):
    assert 300 < len(ls.signatures()) < 500
    got = {r.doc_id: r for r in ls.summarised(ls.license_findings(make_docs([s[:2] for s in SAMPLES]))).collect()}
    assert {i: got[i].labels for i, *_ in SAMPLES} == {i: labels for i, _, labels in SAMPLES}
    assert got[10].score == 0.0 and got[1].score == 1.0 and 0 < got[9].score < 1
    assert (got[11].n_base, got[11].first_word, got[11].last_word) == (2, 0, 4)


def test_base_matches_brute_force(spark, make_docs, odd_rows):
    rng, rows = random.Random(3), list(odd_rows)
    parts = ["under the MIT License", "apache license, version 2", "CC BY-NC", "cc by", "under the", "license", "é", "mit", "Version 2"]
    for i in range(200):
        rows.append((1000 + i, rng.choice([" ", "\n", "-"]).join(rng.choice(parts + prose(i, 3)) for _ in range(rng.randrange(30)))))
    got = {r.doc_id: r for r in ls.summarised(ls.license_findings(make_docs(rows))).collect()}
    phrases = {k.decode(): v for k, v in ls.BASE_PHRASES.items()}
    for i, text, *_ in rows:
        if i is None:
            continue
        w = words(text)
        places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_overlaps_are_resolved_by_priority_containment_and_length():
    def match(first, last, priority, order=0):
        return ls.Match(first, last, ls.Signature(f"l{order}", re.compile(b""), priority, (), 1.0, order))

    outer, inner, better, apart = match(0, 9, 2), match(3, 5, 2, 1), match(8, 10, 4, 2), match(20, 22, 1, 3)
    assert ls.suppressed([inner, outer]) == [outer]
    assert ls.suppressed([outer, inner, better, apart]) == [better, apart]
    assert ls.suppressed([inner, better, apart]) == [inner, better, apart]


def test_the_prefilter_loses_nothing():
    scanner = ls.Scanner()
    for _, text, _ in SAMPLES:
        line = b" " + b" ".join(w.encode() for w in words(text)) + b" "
        every = [ls.Match(line.count(b" ", 0, m.start()), line.count(b" ", 0, m.start()) + m[0].count(b" ") - 1, rule)
                 for rule in ls.signatures() for m in rule.pattern.finditer(line)]
        key = lambda ms: [(m.first, m.last, m.rule.label) for m in ms]
        assert key(scanner.matches(line)) == key(ls.suppressed(every))


def test_suppression_matches_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        rules = [ls.Signature(f"l{k}", re.compile(b""), rng.randrange(4), (), 1.0, k) for k in range(5)]
        every = [ls.Match(f := rng.randrange(40), f + rng.randrange(9), rng.choice(rules)) for _ in range(rng.randrange(40))]
        best, kept = sorted(every, key=ls.Match.rank), []
        for i, m in enumerate(best):
            if not any(o.first <= m.first and m.last <= o.last for o in best[:i]) and all(m.last < o.first or o.last < m.first for o in kept):
                kept.append(m)
        assert ls.suppressed(every) == sorted(kept, key=lambda m: m.first)


def test_a_very_long_text_of_matches():
    line = b" licensed under the mit license under the mit license" * 30_000 + b" "
    assert len(ls.Scanner().matches(line)) == 60_000 and ls.base_places(line)[-1] == (9 * 30_000 - 4, "mit")


def test_empty_table(spark, make_docs):
    assert ls.summarised(ls.license_findings(make_docs([]))).collect() == []
