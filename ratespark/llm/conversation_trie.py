"""A trie of rebuilt conversations by composable fingerprints.

A run of turns has a fingerprint in a monoid: the pair (B^n, H) over the integers modulo 2^61 - 1, where appending runs
multiplies and adds ((a, x) followed by (b, y) is (ab, xb + y)); two bases and two turn hashes make a key of 122 bits.
Three things follow. Turns are numbered and fingerprinted where a range shuffle left them, and the part of a conversation
that lies in earlier partitions is put in front afterwards, one element per partition. A rebuilt conversation (the first
turns of another one, then its own later turns) gets the fingerprints of all its prefixes from products of both sides'
elements: H = H_own(j) + (H_base(m) - H_own(h)) B^(j-h); its text is never built. And a prefix's parent is found by taking
the last turn off: (H - t) / B.

Equality is verified, not assumed: every turn keeps a reference to where it is stored (conversation, position); texts with
equal turn hashes are compared, and all members of a prefix group must name equal last turns and one parent group, so by
induction their sequences are equal. If a check fails, everything is repeated with other hashes.

Sums over subtrees need no walk by levels. Along its path a conversation owns (is the smallest member of) all nodes from some
depth on, so each node counts once with its owner: a sum over a subtree is a sum over the members of its top node.

Hot groups: a conversation with any share of all turns is spread by the range shuffle; groups of prefixes are added up
before they are shuffled; a parent with very many children is looked up by broadcast (at most a thousand such parents); the
ids that end at one node are joined to strings of 64 kB before they go, in order, through one digest.

Defined cases: turns are ordered by turn (null first), then role, then the MD5 of the text; repeated rows are turns of their
own. A null role or text is empty. Rows without a conversation id belong to no conversation and are left out. Empty texts are
turns without words; very long texts are hashed and counted where they are read. A conversation rebuilt without turns ends at
the root. An empty table has no root. Ids are integers. Only the four columns are read, so other names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratespark.llm.text import count_words, looked_up, stored

PRIME = (1 << 61) - 1
BASES = (1_190_494_759_201_347_543, 2_083_611_846_112_902_377)
_INVERSE = tuple(pow(b, -1, PRIME) for b in BASES)
#: Most turns that a rebuilt conversation takes from another one.
MOST_HEAD = 3
PIECE_BYTES = 65_536
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = ["depth", "f1", "f2"]


def base_of(conv_id: Column) -> Column:
    """The conversation whose first turns open ``conv_id``."""
    return conv_id - conv_id % F.lit(20)


def head_of(conv_id: Column) -> Column:
    """How many turns of it are taken."""
    return F.crc32(conv_id.cast("string").cast("binary")) % F.lit(4)


def hashed_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, turn, role, text, t1, t2): rows of a conversation with two hashes of their role and text."""
    filled = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    hashes = {f"t{k}": F.pmod(F.xxhash64(F.lit(2 * seed + k), "role", "text"), F.lit(PRIME)) for k in (1, 2)}
    return filled.withColumns(hashes)


def stored_turns(hashed: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, words, h1, h2, upto): numbered turns with the fingerprint and words of the prefix they end."""
    narrow = hashed.select("conv_id", "turn", "role", F.md5("text").alias("tie"), "t1", "t2", count_words(F.col("text")).alias("words"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "words")
    runs = stored(
        placed.mapInArrow(_fingerprint_runs, "conv_id long, pos long, t1 long, t2 long, words long, h1 long, h2 long, upto long")
        .withColumn("part", F.spark_partition_id())
    )
    tail = F.max(F.struct("conv_id", "pos", "h1", "h2", "upto")).alias("tail")
    ends = runs.groupBy("part").agg(F.min("conv_id").alias("first"), tail).orderBy("part").collect()  # one row per partition
    before = _earlier_parts(ends)

    def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            for i, (part, conv) in enumerate(zip(rows["part"], rows["conv_id"])):
                if part in before and before[part][0] == conv:
                    _, turns, h1, h2, words = before[part]
                    steps = rows["pos"][i] + 1
                    rows["h1"][i] = (h1 * pow(BASES[0], steps, PRIME) + rows["h1"][i]) % PRIME
                    rows["h2"][i] = (h2 * pow(BASES[1], steps, PRIME) + rows["h2"][i]) % PRIME
                    rows["pos"][i] += turns
                    rows["upto"][i] += words
            del rows["part"]
            yield pa.record_batch(rows, schema=pa.schema([f for f in batch.schema if f.name != "part"]))

    return runs.mapInArrow(continued, runs.drop("part").schema) if before else runs.drop("part")


def _fingerprint_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position, fingerprint and words of the prefix within this partition's run of each conversation."""
    conv, pos, h1, h2, upto = None, 0, 0, 0, 0
    for batch in batches:
        rows = batch.to_pydict()
        out = {name: [] for name in ("pos", "h1", "h2", "upto")}
        for c, t1, t2, words in zip(rows["conv_id"], rows["t1"], rows["t2"], rows["words"]):
            if c != conv:
                conv, pos, h1, h2, upto = c, 0, 0, 0, 0
            h1, h2, upto = (h1 * BASES[0] + t1) % PRIME, (h2 * BASES[1] + t2) % PRIME, upto + words
            for name, value in zip(out, (pos, h1, h2, upto)):
                out[name].append(value)
            pos += 1
        columns = {**rows, **out}
        yield pa.record_batch({n: pa.array(columns[n], pa.int64()) for n in ("conv_id", "pos", "t1", "t2", "words", "h1", "h2", "upto")})


def _earlier_parts(ends: list) -> dict[int, tuple[int, int, int, int, int]]:
    """What precedes a partition's first conversation in earlier partitions: (conv_id, turns, h1, h2, words)."""
    before, carried = {}, None
    for row in ends:
        conv, last, h1, h2, words = row.tail
        run = (conv, last + 1, h1, h2, words)
        if carried is not None and carried[0] == row.first:
            before[row.part] = carried
            if conv == row.first:  # the whole partition continues it
                powers = [pow(b, run[1], PRIME) for b in BASES]
                run = (conv, carried[1] + run[1], (carried[2] * powers[0] + h1) % PRIME,
                       (carried[3] * powers[1] + h2) % PRIME, carried[4] + words)
        carried = run
    return before


def conversation_heads(turns: DataFrame, base=base_of, head=head_of) -> DataFrame:
    """One row per conversation: its base's first turns, how many of its own it drops, size and words once rebuilt."""
    turn = F.struct("t1", "t2", "words", "h1", "h2", "upto")
    firsts = [F.max(F.when(F.col("pos") == k, turn)).alias(f"p{k}") for k in range(MOST_HEAD)]
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("last"), F.max("upto").alias("own_words"), *firsts)
    own = own.withColumn("turns", F.col("last") + F.lit(1)).drop("last")
    wanted = own.withColumns({"base": base(F.col("conv_id")), "head": head(F.col("conv_id"))})
    heads = own.select(
        F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"), F.array(*[f"p{k}" for k in range(MOST_HEAD)]).alias("firsts")
    )
    joined = wanted.join(heads, "base", "left")
    taken = F.least("head", F.coalesce("base_turns", F.lit(0)))
    dropped = F.least("head", "turns")
    mine = F.array(*[f"p{k}" for k in range(MOST_HEAD)])

    def prefix(points: Column, size: Column, name: str) -> Column:
        return F.coalesce(F.try_element_at(points, F.nullif(size, F.lit(0)).cast("int"))[name], F.lit(0).cast("long"))

    return joined.select(
        "conv_id", "base", "firsts", taken.alias("taken"), dropped.alias("dropped"),
        *[prefix(F.col("firsts"), taken, n).alias(f"base_{n}") for n in ("h1", "h2", "upto")],
        *[prefix(mine, dropped, n).alias(f"own_{n}") for n in ("h1", "h2", "upto")],
        (taken + F.col("turns") - dropped).alias("length"),
        (prefix(F.col("firsts"), taken, "upto") + F.col("own_words") - prefix(mine, dropped, "upto")).alias("total_words"),
    )


def rebuilt_prefixes(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per conversation and non-empty prefix of its rebuilt turns.

    (conv_id, depth, f1, f2, u1, u2, t1, t2, words, upto, length, total_words, ref_conv, ref_pos): fingerprint, the parent's
    fingerprint, the last turn's hashes, words and place, words of the prefix and of the whole.
    """
    opening = heads.select(
        "conv_id", "base", "length", "total_words", F.posexplode(F.slice("firsts", F.lit(1), F.col("taken").cast("int"))).alias("pos", "turn")
    ).select(
        "conv_id", (F.col("pos") + F.lit(1)).cast("long").alias("depth"), F.col("turn.h1").alias("f1"), F.col("turn.h2").alias("f2"),
        "turn.t1", "turn.t2", "turn.words", "turn.upto", "length", "total_words", F.col("base").alias("ref_conv"),
        F.col("pos").cast("long").alias("ref_pos"),
    )
    rest = turns.join(heads.drop("base", "firsts"), "conv_id").where(F.col("pos") >= F.col("dropped")).select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("dropped") + F.lit(1)).alias("depth"),
        *[F.col(c) for c in ("h1", "h2", "base_h1", "base_h2", "own_h1", "own_h2")],
        (F.col("pos") - F.col("dropped") + F.lit(1)).alias("steps"), "t1", "t2", "words",
        (F.col("base_upto") + F.col("upto") - F.col("own_upto")).alias("upto"), "length", "total_words",
        F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"),
    )
    composed = rest.mapInArrow(_composed, opening.schema)
    return opening.unionByName(composed).mapInArrow(_with_parents, _PREFIX)


_PREFIX = ", ".join(f"{c} long" for c in (
    "conv_id", "depth", "f1", "f2", "u1", "u2", "t1", "t2", "words", "upto", "length", "total_words", "ref_conv", "ref_pos"
))


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """H_own(j) + (H_base(m) - H_own(h)) B^(j-h), for both bases."""
    for batch in batches:
        rows = batch.to_pydict()
        for k, base in enumerate(BASES, 1):
            rows[f"f{k}"] = [
                (own + (front - cut) * pow(base, steps, PRIME)) % PRIME
                for own, front, cut, steps in zip(rows[f"h{k}"], rows[f"base_h{k}"], rows[f"own_h{k}"], rows["steps"])
            ]
        names = ("conv_id", "depth", "f1", "f2", "t1", "t2", "words", "upto", "length", "total_words", "ref_conv", "ref_pos")
        yield pa.record_batch({n: pa.array(rows[n], pa.int64()) for n in names})


def _with_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(H - t) / B, for both bases."""
    names = [part.split()[0] for part in _PREFIX.split(", ")]
    for batch in batches:
        rows = batch.to_pydict()
        for k, back in enumerate(_INVERSE, 1):
            rows[f"u{k}"] = [(f - t) * back % PRIME for f, t in zip(rows[f"f{k}"], rows[f"t{k}"])]
        yield pa.record_batch({n: pa.array(rows[n], pa.int64()) for n in names})


def prefix_groups(prefixes: DataFrame) -> DataFrame:
    """One row per prefix: members, smallest member, last turn, parent's fingerprint, and whether all members agree on these."""
    named = F.struct("u1", "u2", "t1", "t2")
    return prefixes.groupBy(*_NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("upto").alias("upto"),
        (F.max("length") == F.col("depth")).alias("leaf"), F.max(named).alias("named"), (F.min(named) == F.max(named)).alias("agree"),
        F.min(F.struct("ref_conv", "ref_pos")).alias("ref"),
    )


def hashes_collide(hashed: DataFrame) -> bool:
    """Whether two different turns share both hashes; texts are compared as they are."""
    turn = F.struct("role", "text")
    return not hashed.groupBy("t1", "t2").agg((F.min(turn) == F.max(turn)).alias("same")).where(~F.col("same")).isEmpty()


def prefix_trie(conversations: DataFrame, base=base_of, head=head_of) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, ref_conv, ref_pos).

    ``base`` and ``head`` say, as expressions of the id, whose first turns open a conversation and how many (at most 3);
    the reference names the stored turn that a node ends with.
    """
    for seed in count():
        hashed = hashed_turns(conversations, seed)
        if hashes_collide(hashed):
            continue
        turns = stored_turns(hashed)
        heads = stored(conversation_heads(turns, base, head))
        prefixes = stored(rebuilt_prefixes(turns, heads))
        groups = stored(prefix_groups(prefixes))
        if groups.where(~F.col("agree")).isEmpty():
            break
    nodes = _with_parent_ids(_with_subtrees(prefixes, groups), _root(heads, groups))
    return nodes.join(_ends(prefixes, heads), _NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "ref.ref_conv", "ref.ref_pos",
    )


def _with_subtrees(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with children, leaves and saved words below them, and the depth from which the owner owns its path."""
    owners = groups.groupBy("conv_id").agg(
        F.min("depth").alias("own"), F.min(F.struct("depth", (F.col("upto") - F.col("words")).alias("before"))).alias("at"),
        F.max("leaf").cast("long").alias("owns_leaf"),
    ).select("conv_id", "own", "at.before", "owns_leaf")
    depth, own = F.col("depth"), F.col("own")
    from_here = F.col("total_words") - F.col("upto") + F.col("words")
    owned = F.when(own <= depth, from_here).when(own > depth, F.col("total_words") - F.col("before")).otherwise(F.lit(0))
    child = (own <= depth + F.lit(1)) & (F.col("length") > depth)
    sums = prefixes.join(owners, "conv_id", "left").groupBy(*_NODE).agg(
        F.count_if(F.coalesce(child, F.lit(False))).alias("n_children"),
        F.sum(F.coalesce("owns_leaf", F.lit(0))).alias("n_leaves"), F.sum(from_here - owned).alias("saved_tokens"),
        F.min(F.struct("conv_id", "own")).alias("owner"),
    )
    return stored(groups.drop("agree").join(sums, _NODE).withColumn("starts", F.col("owner.own") == F.col("depth")).drop("owner"))


def _root(heads: DataFrame, groups: DataFrame) -> DataFrame:
    """The textless node above all others, if there is any conversation."""
    members = heads.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    below = groups.agg(
        F.count_if(F.col("depth") == 1).alias("n_children"),
        F.greatest(F.count_if("leaf"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum((F.col("n_convs") - F.lit(1)) * F.col("words")), F.lit(0)).alias("saved_tokens"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    return members.crossJoin(below).select(  # one row each
        *[zero.alias(c) for c in _NODE], "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.struct(none.alias("ref_conv"), none.alias("ref_pos")).alias("ref"), none.alias("parent_conv_id"),
    )


def _with_parent_ids(nodes: DataFrame, root: DataFrame) -> DataFrame:
    """All nodes with the smallest member of their parent, which is their own where that owns the parent too."""
    kept = [*_NODE, "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ref"]
    inherited = nodes.where(~F.col("starts")).select(*kept, F.col("conv_id").alias("parent_conv_id"))
    first = nodes.where(F.col("starts")).select(
        *kept, (F.col("depth") - F.lit(1)).alias("d"), F.col("named.u1").alias("g1"), F.col("named.u2").alias("g2")
    )
    parents = nodes.select(*kept).unionByName(root.select(*kept)).select(
        F.col("depth").alias("d"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    ).withColumnRenamed("n_children", "weight")
    found = looked_up(first, parents, ["d", "g1", "g2"], "weight").drop("d", "g1", "g2")
    return inherited.unionByName(found).unionByName(root)


def _ends(prefixes: DataFrame, heads: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of nodes at which conversations end."""
    zero = F.lit(0).cast("long")
    last = prefixes.where(F.col("depth") == F.col("length")).select(*_NODE, "conv_id")
    order = [*_NODE, "conv_id"]
    ended = last.unionByName(heads.where("length = 0").select(*[zero.alias(c) for c in _NODE], "conv_id"))
    pieces = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _id_strings, "depth long, f1 long, f2 long, first long, ids string"
    )
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(
        _digests, "depth long, f1 long, f2 long, ends_sha256 string"
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
    """((depth, f1, f2), (fourth column, last column)) of every row."""
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        yield from zip(zip(*columns[:3]), zip(columns[3], columns[-1]))


def _id_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of each node in pieces; rows arrive sorted by node and id."""
    node, first, ids, size = None, None, [], 0
    for key, (conv, _) in _runs(batches):
        if ids and (key != node or size > PIECE_BYTES):
            yield _row(node, first=first, ids=",".join(ids))
            ids, size = [], 0
        if not ids:
            node, first = key, conv
        ids.append(str(conv))
        size += len(ids[-1]) + 1
    if ids:
        yield _row(node, first=first, ids=",".join(ids))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest over the pieces of each node, which arrive in order."""
    node, digest = None, None
    for key, (_, ids) in _runs(batches):
        if key != node:
            if digest is not None:
                yield _row(node, ends_sha256=digest.hexdigest())
            node, digest = key, hashlib.sha256(ids.encode())
        else:
            digest.update(b"," + ids.encode())
    if digest is not None:
        yield _row(node, ends_sha256=digest.hexdigest())


def _row(node: tuple, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{**dict(zip(_NODE, node)), **values}])
