"""The prefix trie of conversations: every distinct beginning, who shares it, what it would save.

Conversations are strings of turn hashes.  Equal ones are counted first, so that a conversation with any
number of copies is one row; the rest are sorted over all partitions.  Neighbours in that order share
their longest common prefixes (LCP), which are the trie's branching places: edges between neighbours are
taken in descending LCP, union-find joins what they connect, and each join of components is a branching
node, whose components are its children.

A partition knows only a part of the order.  All that its rows share with rows elsewhere are prefixes of
its first or its last row, so those stay open: everything below them is folded into sums that hang at
them, and the partition is contracted to these two rows.  Contracted rows are sorted as well and fold
again, 64 partitions at a time, until one forest is left.  Tasks fold a slice of rows at a time in the
same way, so they hold a slice and two rows at most.
"""

from __future__ import annotations

from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import written
from minuteworks.llm.tokens import slices_of

WIDTH = 16  # bytes of a turn's hash
FOLDED = 64  # contracted parts that are merged by one task at a time
NO_ENDS = sha256(b"").hexdigest()

HUNG = "array<struct<depth:int,n:bigint,conv:bigint,leaves:bigint,children:bigint,saved:bigint,ends:string>>"
NODE = "conv_id long, depth long, parent_conv_id long, parent_digest binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, digest binary"
FOLD = f"part long, side int, {NODE}, key binary, sizes array<int>, hung {HUNG}, digests array<binary>"
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "parent_digest", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest"]


def turn_sequences(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_id, turns``: the turns of each conversation as an ordered array of ``turn, hash, size``.

    Null roles and texts are empty; a null turn comes first; equal turns are ordered by what they say.  Rows
    without a conversation id belong to none and are left out.  A conversation has to fit a row, as 16 bytes
    of hash and a few numbers a turn; its texts stay on the map side.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    said = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), said.alias("hash"), F.char_length(text).alias("size")).alias("t")
    )
    base = F.col("conv_id") - F.col("conv_id") % 100
    # a hundred conversations at most share a base, and what joins on it is in place
    return rows.withColumn("base", base).repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, key, sizes``: each conversation c begins with the first h turns of c - c % 100 (all of them
    if there are fewer, none if it does not exist) and goes on with its own turns after its first h, where
    h = crc32(c) % 6.  The key is the hashes of its turns, the sizes are their code points."""
    own = turn_sequences(conversations)
    heads = own.where("conv_id = base").select(F.col("base").alias("b"), F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    both = own.join(heads, F.col("base") == F.col("b"), "left").select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))
    return both.select("conv_id", F.unhex(F.array_join(F.col("turns.hash"), "")).alias("key"), F.col("turns.size").alias("sizes"))


class Row:
    """A sequence with what hangs at its prefixes: depth -> [conversations, the smallest, leaves, children,
    saved, who ends there].  ``old`` rows were open before."""

    __slots__ = ("key", "sizes", "hung", "old")

    def __init__(self, key, sizes, hung, old):
        self.key, self.sizes, self.hung, self.old = key, sizes, hung, old


class Component:
    """Neighbouring rows that share ``depth`` turns: the sums below the node at that depth."""

    __slots__ = ("depth", "n", "conv", "leaves", "children", "saved", "hung", "waiting", "old", "spine", "row")

    def __init__(self, row: Row, spine: Row | None):
        self.depth, self.n, self.conv, self.leaves, self.children, self.saved = len(row.key) // WIDTH, 0, None, 0, 0, 0
        self.hung, self.waiting, self.old, self.spine, self.row = row.hung, [], row.old, spine, row


def lower(a, b):
    return b if a is None else a if b is None else min(a, b)


def add_hung(to: dict, depth: int, entry: list) -> None:
    have = to.get(depth)
    if have is None:
        to[depth] = entry
    else:
        n, conv, leaves, children, saved, ends = entry
        to[depth] = [have[0] + n, lower(have[1], conv), have[2] + leaves, have[3] + children, have[4] + saved, have[5] or ends]


def common_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


def close(c: Component, to: int, nodes: list) -> None:
    """Makes the nodes of a component from its depth up to, not including, depth ``to``."""
    sizes = c.row.sizes
    while c.depth > to:
        ends = None
        entry = c.hung.pop(c.depth, None)
        if entry:
            c.n += entry[0]
            c.conv = lower(c.conv, entry[1])
            c.leaves += entry[2]
            c.children += entry[3]
            c.saved += entry[4]
            ends = entry[5]
        if not c.children:
            c.leaves += 1
        if c.depth:
            c.saved += (c.n - 1) * sizes[c.depth - 1]
        for child in c.waiting:
            child[2] = c.conv
        node = [c.conv, c.depth, None, None, c.n, c.children, c.leaves, c.saved, ends, md5(c.row.key[: WIDTH * c.depth]).digest() if c.old else None]
        nodes.append(node)
        c.waiting, c.children = [node], 1
        c.depth -= 1


def fold(rows: list[Row], nodes: list, final: bool = False) -> list[Row]:
    """Adds the closed nodes of sorted, distinct ``rows`` to ``nodes`` and returns the one or two rows that
    the rest is contracted to; with ``final`` there is no rest."""
    last = len(rows) - 1
    above = list(range(len(rows)))
    parts = [Component(r, r if not final and k in (0, last) else None) for k, r in enumerate(rows)]

    def find(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    edges = np.array([common_turns(a.key, b.key) for a, b in zip(rows, rows[1:])], np.int64)
    for k in np.argsort(-edges, kind="stable").tolist():
        d = int(edges[k])
        left, right = find(k), find(k + 1)
        a, b = parts[left], parts[right]
        for c in (a, b):
            if c.spine is None:
                close(c, d, nodes)
        if a.spine is None and b.spine is None:
            a.n += b.n
            a.conv = lower(a.conv, b.conv)
            a.leaves += b.leaves
            a.children += b.children
            a.saved += b.saved
            a.waiting += b.waiting
            a.old = a.old or b.old
            if len(a.hung) < len(b.hung):
                a.hung, b.hung = b.hung, a.hung
            for depth, entry in b.hung.items():
                add_hung(a.hung, depth, entry)
        elif a.spine is not None and b.spine is not None:  # the first and the last row
            for depth in [x for x in b.spine.hung if x <= d]:
                add_hung(a.spine.hung, depth, b.spine.hung.pop(depth))
        else:
            spine, c = (a.spine, b) if a.spine is not None else (b.spine, a)
            for depth, entry in c.hung.items():
                add_hung(spine.hung, depth, entry)
            add_hung(spine.hung, d, [c.n, c.conv, c.leaves, c.children, c.saved, None])
            if c.waiting:
                digest = md5(spine.key[: WIDTH * d]).digest()
                for child in c.waiting:
                    child[3] = digest
            a.spine = spine
        above[right] = left
        parts[right] = None
    if final:
        close(parts[0], -1, nodes)
        return []
    return [Row(r.key, r.sizes, r.hung, True) for r in (rows[:1] if last == 0 else [rows[0], rows[last]])]


def folded_batch(part: int, nodes: list, rows: list[Row]) -> pa.RecordBatch:
    """Nodes and contracted rows as one batch of ``FOLD``; ``side`` is null for nodes."""
    n, m = len(nodes), len(rows)
    hung = pa.list_(pa.struct([("depth", pa.int32()), *((x, pa.int64()) for x in ("n", "conv", "leaves", "children", "saved")), ("ends", pa.string())]))
    columns = [pa.array([part] * (n + m), pa.int64()), pa.array([None] * n + list(range(m)), pa.int32())]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4 + [pa.string(), pa.binary()]
    columns += [pa.array([x[k] for x in nodes] + [None] * m, kind) for k, kind in enumerate(kinds)]
    digests = []
    for r in rows:
        state = md5()
        found = [state.digest()]
        for at in range(0, len(r.key), WIDTH):
            state.update(r.key[at : at + WIDTH])
            found.append(state.digest())
        digests.append(found)
    columns += [
        pa.array([None] * n + [r.key for r in rows], pa.binary()),
        pa.array([None] * n + [r.sizes for r in rows], pa.list_(pa.int32())),
        pa.array([None] * n + [[dict(zip(("depth", "n", "conv", "leaves", "children", "saved", "ends"), (d, *e))) for d, e in sorted(r.hung.items())] for r in rows], hung),
        pa.array([None] * n + digests, pa.list_(pa.binary())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "side", *NODE_COLUMNS, "key", "sizes", "hung", "digests"])


def fold_partition(batches):
    """A sorted partition of ``key, sizes, conv_id, n, ends``, slice by slice; what a slice is contracted to
    goes before the next slice."""
    part, kept = TaskContext.get().partitionId(), []
    for batch in batches:
        for a, z in slices_of(batch.column(0)):
            piece = batch.slice(a, z - a).to_pydict()
            rows = [Row(k, s, {len(k) // WIDTH: [n, c, 0, 0, 0, e]}, False) for k, s, c, n, e in zip(*piece.values())]
            nodes: list = []
            kept = fold(kept + rows, nodes)
            if nodes:
                yield folded_batch(part, nodes, [])
    if kept:
        yield folded_batch(part, [], kept)


def fold_parts(final: bool):
    def run(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: (r["part"], r["side"]))
        rows = [Row(r["key"], r["sizes"], {e["depth"]: [e["n"], e["conv"], e["leaves"], e["children"], e["saved"], e["ends"]] for e in r["hung"]}, True) for r in found]
        nodes: list = []
        kept = fold(rows, nodes, final)
        return pa.Table.from_batches([folded_batch(found[0]["part"] // FOLDED, nodes, kept)])

    return run


def joined_ids(batches):
    """Sorted ``digest, conv_id`` rows: the ids of each stretch with one digest, as decimals with commas."""
    for batch in batches:
        digest, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cuts = [k for k in range(len(ids)) if k == 0 or digest[k] != digest[k - 1]]
        spans = [*zip(cuts, [*cuts[1:], len(ids)])]
        columns = [[digest[a] for a, _ in spans], [ids[a] for a, _ in spans], [z - a for a, z in spans], [",".join(map(str, ids[a:z])) for a, z in spans]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["digest", "first", "n", "ids"])


def hashed_ids(batches):
    """Sorted stretches of ids: for each digest the smallest id, how many there are, and the SHA-256 of all."""
    now, state = None, None
    for batch in batches:
        done = []
        for digest, first, n, ids in zip(*batch.to_pydict().values()):
            if digest == now:
                state[1] += n
                state[2].update(b",")
            else:
                if state:
                    done.append(state)
                now, state = digest, [first, n, sha256()]
            state[2].update(ids.encode())
        yield ends_batch(done)
    if state:
        yield ends_batch([state])


def ends_batch(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s[0] for s in done], pa.int64()), pa.array([s[1] for s in done], pa.int64()), pa.array([s[2].hexdigest() for s in done], pa.string())], names=["first", "n", "ends"])


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """``key, sizes, conv_id, n, ends`` for each different sequence: its smallest conversation, how many
    there are, and the hash of their ids in order.

    Ids of copies are sorted over all partitions and joined there to texts of thousands of ids each; the
    one task that has to hash them in order reads these texts as a stream.
    """
    members = sequences.select(F.unhex(F.md5("key")).alias("digest"), "conv_id")
    runs = members.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(joined_ids, "digest binary, first long, n long, ids string")
    groups = runs.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed_ids, "first long, n long, ends string")
    return sequences.join(groups, F.col("conv_id") == F.col("first")).select("key", "sizes", "conv_id", "n", "ends")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (``conv_id, key, sizes``; ids are unique).

    ``conv_id`` (the smallest member), ``depth, parent_conv_id`` (null for the root), ``n_convs`` (members),
    ``n_children, n_leaves, saved_tokens`` (over the subtree, each node's members but one times its last
    size) and ``ends_sha256`` (of the ids of members that end here, in order, with commas).  Without
    sequences there are no nodes; an empty sequence is a member of the root.
    """
    spark = sequences.sparkSession
    rows = written(distinct_sequences(sequences), "trie-sequences")
    first = written(rows.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(fold_partition, FOLD), "trie-parts")
    open_rows, upper = first.where("side is not null"), spark.createDataFrame([], NODE)
    while (most := open_rows.agg(F.max("part")).first()[0]) is not None:
        level = written(open_rows.groupBy((F.col("part") / FOLDED).cast("long").alias("group")).applyInArrow(fold_parts(most < FOLDED), FOLD), "trie-parts")
        upper = upper.unionByName(level.where("side is null").select(NODE_COLUMNS))
        open_rows = level.where("side is not null")
    # what was open in a part knows its digest; nodes that hang there ask for their parent by it, part by part
    known = upper.select(F.col("digest").alias("known"), F.col("conv_id").alias("known_conv"))
    spines = first.where("side is not null").select("part", F.explode("digests").alias("digest")).distinct()
    nodes = first.where("side is null")
    parents = spines.join(known, F.col("digest") == F.col("known")).select("part", "digest", F.col("known_conv").alias("conv_id"))
    parents = parents.unionByName(nodes.where("digest is not null").select("part", "digest", "conv_id"))
    parents = parents.select(F.col("part").alias("p"), F.col("digest").alias("d"), F.col("conv_id").alias("found"))
    orphans = nodes.where("parent_digest is not null").join(parents, (F.col("part") == F.col("p")) & (F.col("parent_digest") == F.col("d")))
    upper = upper.join(known, F.col("parent_digest") == F.col("known"), "left").withColumnRenamed("known_conv", "found")
    every = nodes.where("parent_digest is null").withColumn("found", F.lit(None).cast("long"))
    columns = [*NODE_COLUMNS, "found"]
    every = every.select(columns).unionByName(orphans.select(columns)).unionByName(upper.select(columns))
    return every.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "found").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of :func:`rebuilt_conversations`."""
    return prefix_trie(written(rebuilt_conversations(conversations), "trie-conversations"))
