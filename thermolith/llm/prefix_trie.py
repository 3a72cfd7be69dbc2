"""The prefix trie of conversations, by an external mergesort that knows common prefixes.

A conversation is a sequence of turns; a turn goes by a 16-byte digest of its role and text, so a
sequence is a string of bytes and its order is theirs. Texts are not shuffled.

* **Runs.** Each task sorts bounded buffers of sequences (by turns, then by conversation) and
  writes them as runs; a row carries its LCP, the number of turns that it shares with the row before it.
* **Ranges.** The runs are dealt by ranges of (sequence, conversation), so no prefix, however common, and no group of
  copies has to lie in one task. A range's part of a run is a run.
* **Merge.** A loser tree merges the runs of a range. A loser keeps the LCP with what it lost
  against, so of two heads the one with the longer LCP is next without a look at the turns, and if both are
  equally long, they are compared from there on. The winner comes out with its LCP with the last one.
* **Nodes.** A stack has the path of the last sequence. What the next one doesn't share is
  finished and comes off the stack, what is new goes on it; a finished node adds its counts to its parent.
* **Ends of ranges.** A node on the path of a range's first or last sequence may go on in another range. Those, one path each,
  are handed on as they are, and one more pass in the order of ranges closes them by the same stack: as many rows as there are
  ranges times twice the depth. A node that ends as many conversations as a group of copies has hands on their
  ids in pieces, since a SHA-256 of all of them has to be made in order; that is a stream of constant memory.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Bytes of a turn's digest.
TURN = 16
#: Rows and bytes at which a run is closed, and bytes of a range.
RUN_ROWS, RUN_BYTES, RANGE_BYTES = 50_000, 16 << 20, 32 << 20
#: Characters in which the ids of an unfinished node are handed on; rows of a frame.
IDS_CHARS, FRAME_ROWS = 1 << 16, 10_000


def _turn() -> tuple[Column, Column, Column]:
    """Role and text, missing ones empty, and the digest of both, in hexadecimal digits."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return role, text, F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, digest, bytes>>): each conversation's turns in order of ``turn``,
    missing ones first; equal ones go by digest. Rows without a conv_id are left out."""
    role, text, digest = _turn()
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("bytes")).alias("turn"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def joined_heads(own: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``own`` (conv_id, turns) with the first h turns taken from the first conversation of each ``every``, h = crc32(conv_id) % ``most``;
    all of them if it has fewer, none if it doesn't exist."""
    c = F.col("conv_id")
    heads = own.where(c % every == 0).select(c.alias("__of"), F.slice("turns", 1, most - 1).alias("__head"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    head = F.coalesce(F.slice("__head", F.lit(1), h), F.slice("turns", 1, 0))
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.join(heads, c - c % every == F.col("__of"), "left").select("conv_id", F.concat(head, tail).alias("turns"))


def _key(turns: str) -> list[Column]:
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("key"), F.transform(turns, lambda t: t["bytes"]).alias("sizes")]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The number of turns at the start of both, of which ``known`` need no look."""
    i, n = known * TURN, min(len(a), len(b))
    while i < n and a[i : i + TURN] == b[i : i + TURN]:
        i += TURN
    return i // TURN


RUNS = "run bigint, pos bigint, conv_id bigint, key binary, sizes array<int>, lcp int"


def _runs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    run = TaskContext.get().partitionId() << 24
    rows: list[tuple] = []
    size = 0

    def closed() -> pd.DataFrame:
        rows.sort(key=lambda r: r[:2])
        out = [(run, i, c, k, s, common(rows[i - 1][0], k) if i else 0) for i, (k, c, s) in enumerate(rows)]
        return pd.DataFrame(out, columns=["run", "pos", "conv_id", "key", "sizes", "lcp"])

    for frame in frames:
        for row in zip(frame["key"], frame["conv_id"].tolist(), frame["sizes"]):
            rows.append(row)
            size += len(row[0])
            if len(rows) >= RUN_ROWS or size >= RUN_BYTES:
                yield closed()
                rows, size, run = [], 0, run + 1
    if rows:
        yield closed()


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """The rows (key, conv_id, sizes, LCP with the row before in its run) of all runs in order, each with its LCP with the one that came out before it."""
    runs = [r for r in runs if r]
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    # A contestant is (run, LCP with the last winner on its way); a run that has ended is None.
    heads: list[tuple | None] = [r[0] for r in runs] + [None] * (leaves - len(runs))
    places = [0] * len(runs)
    losers: list[tuple[int, int]] = [(0, 0)] * leaves

    def game(a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """The winner and the loser, the latter with its LCP with the former."""
        (x, shared_x), (y, shared_y) = a, b
        if heads[y] is None:
            return a, b
        if heads[x] is None:
            return b, a
        if shared_x != shared_y:
            return (a, b) if shared_x > shared_y else (b, a)
        (k, c, *_), (l, d, *_) = heads[x], heads[y]
        shared = common(k, l, shared_x)
        i = shared * TURN
        first = (k[i : i + TURN], c) < (l[i : i + TURN], d)
        return (a, (y, shared)) if first else (b, (x, shared))

    def played(node: int) -> tuple[int, int]:
        if node >= leaves:
            return node - leaves, 0
        winner, losers[node] = game(played(2 * node), played(2 * node + 1))
        return winner

    winner, shared = played(1) if leaves > 1 else (0, 0)
    while heads and heads[winner] is not None:
        key, conv, sizes, _ = heads[winner]
        yield key, conv, sizes, shared
        places[winner] += 1
        run = runs[winner]
        heads[winner] = run[places[winner]] if places[winner] < len(run) else None
        contestant = (winner, heads[winner][3] if heads[winner] is not None else 0)
        node = (winner + leaves) // 2
        while node:
            contestant, losers[node] = game(contestant, losers[node])
            node //= 2
        winner, shared = contestant


class Node:
    """What is known so far of a node on the open path."""

    __slots__ = ("depth", "size", "digest", "begun", "first", "conv", "n_convs", "n_children", "n_leaves", "saved", "ids", "waiting", "refs")

    def __init__(self, depth: int, size: int, digest: bytes, begun: int = 0, first: bool = False):
        self.depth, self.size, self.digest, self.begun, self.first = depth, size, digest, begun, first
        self.conv: int | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.ids: list[str] = []  # of the conversations that end here
        self.waiting: list[tuple] = []  # finished children, until this node's smallest member is known
        self.refs: list[tuple[int, int]] = []

    def meets(self, conv: int | None) -> None:
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv

    def finished(self, ends: str, parent: Node | None) -> tuple:
        """Its row, without the parent's conversation; its counts go to the parent."""
        leaves, saved = self.n_leaves if self.n_children else 1, self.saved + (self.n_convs - 1) * self.size
        row = (self.conv, self.depth, self.n_convs, self.n_children, leaves, saved, ends, self.digest)
        if parent is not None:
            parent.meets(self.conv)
            parent.n_children += 1
            parent.n_leaves += leaves
            parent.saved += saved
            parent.waiting.append(row)
        return row


#: Kinds of rows: a node; a node whose parent is (part, ref) and still open; an open node; ids that end there; an open node's smallest member.
NODE, CHILD, OPEN, IDS, SMALLEST = range(5)
_FIELDS = "conv_id bigint, depth int, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, digest binary"
_ROWS = f"kind int, part int, ref bigint, piece int, parent_conv_id bigint, {_FIELDS}, size int, ids string"
#: Refs of nodes on the path of the last sequence only come after the others of their range.
RIGHT = 1 << 40


class _Out:
    """Rows of _ROWS in frames of bounded size."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, kind: int, part=0, ref=0, piece=0, parent=None, fields=(None,) * 8, size=0, ids=None) -> None:
        self.rows.append((kind, part, ref, piece, parent, *fields, size, ids))

    def frames(self, least: int = FRAME_ROWS) -> Iterator[pd.DataFrame]:
        if len(self.rows) >= least:
            names = [c.split()[0] for c in _ROWS.split(", ")]
            yield pd.DataFrame({n: pd.array(x, "Int64") if n not in ("ends_sha256", "digest", "ids") else pd.Series(x, dtype=object) for n, x in zip(names, zip(*self.rows))})
            self.rows = []


def _range_nodes(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the runs of a range: its nodes, and what is known of those that may go on in others."""
    part = TaskContext.get().partitionId()
    runs: list[list[tuple]] = []
    last = None
    for frame in frames:
        for run, key, conv, sizes, shared in zip(frame["run"].tolist(), frame["key"], frame["conv_id"].tolist(), frame["sizes"], frame["lcp"].tolist()):
            if run != last:
                runs.append([])
                last = run
            runs[-1].append((key, conv, sizes, shared))
    if not runs:
        return
    out, index = _Out(), 0
    stack = [Node(0, 0, b"", first=True)]

    def opened(node: Node, ref: int) -> None:
        """Hands on a node as it is."""
        fields = (node.conv, node.depth, index - node.begun, node.n_children, node.n_leaves, node.saved, None, node.digest)
        out.add(OPEN, part, ref, fields=fields, size=node.size)
        pieces = itertools.groupby(_pieces(node.ids), key=lambda x: x[0])
        for piece, ids in pieces:
            out.add(IDS, part, ref, piece + 1, fields=(*[0] * 6, None, None), ids=",".join(x for _, x in ids))
        for row in node.waiting:
            out.add(CHILD, part, ref, fields=row)

    def popped() -> None:
        node = stack.pop()
        node.n_convs = index - node.begun
        if node.first:
            opened(node, node.depth)
            stack[-1].meets(node.conv)
        else:
            node.finished(hashlib.sha256(",".join(node.ids).encode()).hexdigest(), stack[-1])
            for row in node.waiting:
                out.add(NODE, parent=node.conv, fields=row)

    for key, conv, sizes, shared in merged(runs):
        while len(stack) - 1 > shared:
            popped()
        for d in range(shared, len(key) // TURN):
            stack.append(Node(d + 1, int(sizes[d]), key[d * TURN : (d + 1) * TURN], index, index == 0))
        stack[-1].ids.append(str(conv))
        stack[-1].meets(conv)
        index += 1
        yield from out.frames()
    for below, node in zip(stack[::-1], stack[-2::-1]):
        node.meets(below.conv)
    for node in stack:
        opened(node, node.depth if node.first else RIGHT + node.depth)
    yield from out.frames(1)


def _pieces(ids: list[str]) -> Iterator[tuple[int, str]]:
    """Each id with the number of its piece of about IDS_CHARS."""
    size = 0
    for x in ids:
        size += len(x) + 1
        yield size // IDS_CHARS, x


def _closed(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Puts the open paths of all ranges together, in the order of ranges; nothing but one path and the open children of its nodes is kept."""
    out, stack = _Out(), []
    hashes: list = []  # of the nodes on the stack: a SHA-256 in the making, or None
    part = current = None
    matching, tip = True, 0

    def popped() -> None:
        node, made = stack.pop(), hashes.pop()
        row = node.finished((made or hashlib.sha256()).hexdigest(), stack[-1] if stack else None)
        if not stack:
            out.add(NODE, fields=row)
        for child in node.waiting:
            out.add(NODE, parent=node.conv, fields=child)
        for p, ref in node.refs:
            out.add(SMALLEST, p, ref, fields=(node.conv, *[None] * 7))

    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.kind == IDS:
                if hashes[current] is None:
                    hashes[current] = hashlib.sha256(r.ids.encode())
                else:
                    hashes[current].update(b"," + r.ids.encode())
                continue
            if r.part != part:
                while len(stack) - 1 > tip:
                    popped()
                part, matching = r.part, True
            depth = int(r.depth)
            matching = matching and r.ref < RIGHT and depth < len(stack) and stack[depth].digest == bytes(r.digest)
            if not matching:
                while len(stack) > depth:
                    popped()
                stack.append(Node(depth, int(r.size), bytes(r.digest)))
                hashes.append(None)
            node, tip, current = stack[depth], depth, depth
            node.meets(int(r.conv_id))
            node.n_convs += int(r.n_convs)
            node.n_children += int(r.n_children)
            node.n_leaves += int(r.n_leaves)
            node.saved += int(r.saved_tokens)
            node.refs.append((int(r.part), int(r.ref)))
            yield from out.frames()
    while stack:
        popped()
    yield from out.frames(1)


def trie(rebuilt: DataFrame, ranges: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of ``rebuilt`` (conv_id, turns array<struct<digest, bytes>> as :func:`sequences` makes it).

    A row for each distinct sequence of the first turns of some conversation, the empty one included: conv_id (the
    smallest member, which has these turns first), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (over the subtree, bytes of a node's last text times the members beyond the first),
    ends_sha256 (of the ids of the members that end here, ascending, by commas), digest (of the last turn, hexadecimal).

    An id that repeats is a conversation for each of its rows. No conversations, no rows. A conversation
    of any length is one row of some 20 bytes a turn; it has to fit in one. ``ranges``: how many ranges, by default by size.
    """
    scratch = Scratch(rebuilt.sparkSession)
    runs = scratch.written(rebuilt.where("conv_id IS NOT NULL").select("conv_id", *_key("turns")).mapInPandas(_runs, RUNS), "runs")
    if ranges is None:
        n, size = runs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
        ranges = max(1, -(-n // (2 * RUN_ROWS)), -(-size // RANGE_BYTES))
    dealt = runs.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("run", "pos")
    found = scratch.written(dealt.mapInPandas(_range_nodes, _ROWS), "range-nodes")
    paths = found.where(F.col("kind").isin(OPEN, IDS)).drop("parent_conv_id").repartition(1).sortWithinPartitions("part", "ref", "piece")
    closed = scratch.written(paths.mapInPandas(_closed, _ROWS), "closed-nodes")
    smallest = closed.where(F.col("kind") == SMALLEST).select("part", "ref", F.col("conv_id").alias("__parent"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "digest"]
    children = found.where(F.col("kind") == CHILD).drop("parent_conv_id").join(smallest, ["part", "ref"]).withColumnRenamed("__parent", "parent_conv_id")
    nodes = found.where(F.col("kind") == NODE).select(names).unionByName(closed.where(F.col("kind") == NODE).select(names)).unionByName(children.select(names))
    return scratch.result(nodes.withColumn("digest", F.lower(F.hex("digest"))), "nodes")


def rebuilt_trie(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), each with its head taken from the first of its
    ``every`` (:func:`joined_heads`). Missing roles and texts are empty; rows without a conv_id are left
    out; repeated rows are turns of their own; other columns aren't read."""
    return trie(joined_heads(sequences(conversations), every, most))


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of their last turns; the root has none."""
    role, text, digest = _turn()
    said = conversations.select(digest.alias("digest"), role.alias("role"), text.alias("text")).groupBy("digest").agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    return nodes.join(said, "digest", "left")
