"""The trie against one built from plain lists."""

import hashlib
import zlib

import pytest

from llm_helpers import plain
from ratespark.llm import conversation_trie
from ratespark.llm.conversation_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, f1 int, base string"


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def below(key):
        todo, out = [key], []
        while todo:
            top = todo.pop()
            out.append(top)
            todo += children.get(top, [])
        return out

    out = []
    for key, members in nodes.items():
        sub = below(key)
        ends = sorted(c for c in members if len(rebuilt[c]) == len(key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else -1, len(members), len(children.get(key, [])),
            sum(1 for k in sub if k not in children), sum((len(nodes[k]) - 1) * len(plain(k[-1][1])) for k in sub if k),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
         r.saved_tokens, r.ends_sha256) for r in prefix_trie(frame).collect()
    )


def made(convs, turns, texts, seed):
    return [
        (c, t, "user" if t % 2 == 0 else "assistant", f"text {(c * seed + t * t) % texts} and more" if t else "hello there")
        for c in convs for t in range((c * 7 + seed) % turns)
    ]


@pytest.mark.parametrize("rows", [
    made(range(0, 130), 8, 3, 1),
    made(range(-45, 45), 5, 2, 3),
    made([3, 5, 7, 23, 41], 12, 50, 5),
    [(0, t, "user", "same") for t in range(60)] + [(1, t, "user", "same") for t in range(40)],
])
def test_nodes_match_plain_lists(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long_text = "very " * 20_000
    rows = [
        (20, None, None, None), (20, 0, "user", ""), (20, 0, "user", ""), (20, 0, "assistant", "b"), (20, 1, "user", long_text),
        (21, 5, "user", "one"), (22, 0, "user", "one"), (22, 0, "user", "one"), (None, 0, "user", "lost"), (None, 1, None, None),
        (33, 0, "x", "no base"), (34, 0, "x", "no base"), (35, 0, "x", "no base"), (36, 0, "x", "no base"), (37, 0, "", None),
    ]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_a_conversation_over_many_partitions(spark):
    rows = [(40, t, "user", f"t{t % 5}") for t in range(260)] + [(41, t, "user", f"t{t % 5}") for t in range(30)]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    turns = conversation_trie.stored_turns(conversation_trie.hashed_turns(frame, 0)).orderBy("conv_id", "pos").collect()
    assert [(r.conv_id, r.pos) for r in turns] == [(40, t) for t in range(260)] + [(41, t) for t in range(30)]
    by_place = {(r.conv_id, r.pos): (r.h1, r.h2) for r in turns}
    assert all(by_place[40, t] == by_place[41, t] for t in range(30))
    assert found(spark, rows) == brute(rows)


def test_equal_hashes_of_unlike_turns_are_noticed(spark, monkeypatch):
    rows = made(range(0, 60), 6, 3, 1)
    plain_hashes, seeds = conversation_trie.hashed_turns, []

    def weak(frame, seed):
        seeds.append(seed)
        hashed = plain_hashes(frame, seed)
        return hashed if seed else hashed.withColumns({"t1": hashed.t1 * 0, "t2": hashed.t2 * 0})

    monkeypatch.setattr(conversation_trie, "hashed_turns", weak)
    assert found(spark, rows) == brute(rows) and seeds == [0, 1]


def test_many_ids_that_end_together(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_BYTES", 40)
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(4)]
    assert found(spark, rows) == brute(rows)
