"""The trie of conversation prefixes by an external mergesort that knows common prefixes.

A turn is a code of CODE bytes: 128 bits of the SHA-256 over its role and text, and the length of its
text. So only codes travel, whatever the length of the texts, and sequences of turns
compare as strings of codes. Conversations are dealt by ranges of (sequence, conv_id), so that no
prefix, nor a conversation with many copies, makes a task larger than others.

In a task, batches are sorted into runs in which each conversation carries the number of turns that it
shares with the one before (LCP) and only the codes after these. Runs are cut at common
splitters and handed to Spark's sorter, which is the external storage; so the worker then holds
one segment of all runs at a time. A loser tree merges them: of two conversations the one that shares more
turns with the last one out is the smaller; only if both share as many are turns compared, from there
on, and the loser keeps what it shares with the winner. The merged stream is folded by a
stack of the nodes on the open path: a node is finished when a conversation comes that
doesn't begin with it.

Nodes on a task's first and last path may go on in its neighbours. Their parts, a row for each task and
depth, meet in one small task, which folds them by the same stack; nodes whose parent is such a
node, or one with more than MOST_CHILDREN children, learn its conv_id through a join on a number.

Defined results: rows without conv_id are ignored; null role or text counts as empty; turns come by `turn`, null first, and
equal ones by their codes; repeated rows are turns of their own; an empty table gives no node;
other columns are ignored. The codes of one conversation have to fit a task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle, settle_table

DIGEST = 16
CODE = DIGEST + 8
#: Bytes of codes in a run, and conversations between two splitters of the first run.
RUN_BYTES = 32 << 20
SEGMENT = 4096
MOST_CHILDREN = 10_000
#: Rows handed on at once.
ROWS = 10_000

Item = tuple[int, bytes, int]  # turns shared with the one before, codes, conv_id


# -- conversations as sequences of codes ----------------------------------------------------


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, its block of five conversations (base) and the codes of its turns in order, in hexadecimal digits."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(text).cast("long")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    code = F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(size), 16, "0"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", code.alias("code"))
    based = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "code"))), lambda t: t["code"])
    return based.repartition("base").groupBy("base", "conv_id").agg(turns.alias("turns"))


def grafted(sequences: DataFrame) -> DataFrame:
    """sequences in which each conversation's first turns are those of its base: h of them, by a hash of conv_id."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    heads = sequences.where("conv_id = base").select("base", F.slice("turns", 1, 8).alias("head"))
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return sequences.join(heads, "base", "left").select("base", "conv_id", F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h), tail).alias("turns"))


# -- sorted runs ------------------------------------------------------------------------------


def shared_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """The number of turns that two sequences begin with alike, `at` of which are known."""
    most = min(len(a), len(b)) // CODE
    while at < most and a[at * CODE : (at + 1) * CODE] == b[at * CODE : (at + 1) * CODE]:
        at += 1
    return at


RUN = "segment int, run int, ids array<long>, shared array<int>, turns array<int>, codes binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splitters: list[tuple[bytes, int]] = []
    rows: list[tuple[bytes, int]] = []
    size = run = 0

    def sorted_run() -> pa.RecordBatch:
        rows.sort()
        if run == 0:
            splitters.extend(rows[SEGMENT::SEGMENT])
        cuts = [0, *(bisect_left(rows, s) for s in splitters), len(rows)]
        told = []
        for segment, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if lo < hi:
                shared = [0, *(shared_turns(rows[i - 1][0], rows[i][0]) for i in range(lo + 1, hi))]
                rest = [seq[n * CODE :] for (seq, _), n in zip(rows[lo:hi], shared, strict=True)]
                told.append({"segment": segment, "run": run, "ids": [c for _, c in rows[lo:hi]], "shared": shared, "turns": [len(x) // CODE for x in rest], "codes": b"".join(rest)})
        return pa.RecordBatch.from_pylist(told, _RUN)

    for batch in batches:
        for seq, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            rows.append((seq, conv))
            size += len(seq) + 64
            if size >= RUN_BYTES:
                yield sorted_run()
                rows.clear()
                size, run = 0, run + 1
    if rows:
        yield sorted_run()


_RUN = pa.schema([("segment", pa.int32()), ("run", pa.int32()), ("ids", pa.list_(pa.int64())), ("shared", pa.list_(pa.int32())), ("turns", pa.list_(pa.int32())), ("codes", pa.binary())])


def read_run(row: dict) -> Iterator[Item]:
    seq, at, codes = b"", 0, row["codes"]
    for conv, shared, turns in zip(row["ids"], row["shared"], row["turns"], strict=True):
        seq = seq[: shared * CODE] + codes[at : at + turns * CODE]
        at += turns * CODE
        yield shared, seq, conv


# -- merging ----------------------------------------------------------------------------------


def merged(runs: list[Iterable[Item]]) -> Iterator[Item]:
    """Sorted runs as one, by (sequence, conv_id), each with the turns it shares with the one before; the first counts as sharing none."""
    sources = [iter(r) for r in runs]
    k = len(sources)
    none: Item = (-1, b"", 0)  # shares less than any other: loses against all
    heads = [next(s, none) for s in sources]

    def wins(a: int, b: int) -> bool:
        """Whether the head of a is the smaller one; the loser keeps what it shares with the winner."""
        (x, seq_a, conv_a), (y, seq_b, conv_b) = heads[a], heads[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        both = shared_turns(seq_a, seq_b, x)
        rest_a, rest_b = seq_a[both * CODE : (both + 1) * CODE], seq_b[both * CODE : (both + 1) * CODE]
        first = rest_a < rest_b if rest_a != rest_b else conv_a <= conv_b
        if first:
            heads[b] = (both, seq_b, conv_b)
        else:
            heads[a] = (both, seq_a, conv_a)
        return first

    best = [0] * k + list(range(k))
    losers = [0] * k
    for node in range(k - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        best[node], losers[node] = (a, b) if wins(a, b) else (b, a)
    top = best[1] if k > 1 else 0
    while heads[top][0] >= 0:
        yield heads[top]
        heads[top] = next(sources[top], none)
        node = (top + k) // 2
        while node:
            if not wins(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


# -- nodes of the open path ------------------------------------------------------------------


class Node:
    """A node while conversations that begin with it come by."""

    __slots__ = ("children", "code", "convs", "done", "ends", "first", "leaves", "low", "saved", "slots")

    def __init__(self, code: bytes, first: bool = False):
        self.code, self.first = code, first
        self.convs = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends: list[bytes] = []
        self.done: list[list] = []  # finished children, which don't know their parent yet
        self.slots: list[int] = []  # numbers under which children that were handed on know it

    def take(self, convs: int, low: int | None, children: int, leaves: int, saved: int) -> None:
        self.convs += convs
        self.low = low if self.low is None else self.low if low is None else min(self.low, low)
        self.children += children
        self.leaves += leaves
        self.saved += saved


#: kind 0: a node; 1: a node whose parent is a slot; 2: a slot's conv_id; 3: a part of a node, with its slot as parent
_OUT = pa.schema(
    [("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
    + [("part", pa.int64()), ("side", pa.int32()), ("code", pa.binary()), ("ends", pa.binary())]
)
OUT = "kind int, conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part long, side int, code binary, ends binary"


class Path:
    """The stack of open nodes; rows of finished ones gather in `out`."""

    def __init__(self, part: int):
        self.part, self.stack, self.out, self.numbers = part, [], [], 0

    def slot(self, node: Node) -> int:
        """A number of its own in all tasks: the task above 32 bits of a counter."""
        node.slots.append((self.part << 32) | self.numbers)
        self.numbers += 1
        return node.slots[-1]

    def push(self, code: bytes, first: bool = False) -> None:
        self.stack.append(Node(code, first))

    def hand_on(self, node: Node, slot: int) -> None:
        self.out += [[1, *child[1:3], slot, *child[4:]] for child in node.done]
        node.done = []

    def close(self) -> None:
        """Finish the deepest node."""
        node, depth = self.stack.pop(), len(self.stack)
        leaves = node.leaves if node.children else 1
        size = int.from_bytes(node.code[DIGEST:], "big")
        saved = node.saved + (node.convs - 1) * size
        self.out += [[0, *child[1:3], node.low, *child[4:]] for child in node.done]
        self.out += [[2, node.low, None, slot, *[None] * 9] for slot in node.slots]
        row = [0, node.low, depth, None, node.convs, node.children, leaves, saved, hashlib.sha256(b",".join(node.ends)).hexdigest(), *[None] * 4]
        if not self.stack:
            self.out.append(row)
            return
        above = self.stack[-1]
        above.take(node.convs, node.low, 1, leaves, saved)
        above.done.append(row)
        if len(above.done) > MOST_CHILDREN:
            self.hand_on(above, above.slots[-1] if above.slots else self.slot(above))

    def part_of(self, node: Node, depth: int, side: int) -> None:
        """Hand on a node that may have members in other tasks."""
        slot = node.slots[-1] if node.slots else self.slot(node)
        self.hand_on(node, slot)
        self.out.append([3, node.low, depth, slot, node.convs, node.children, node.leaves, node.saved, None, self.part, side, node.code, b",".join(node.ends) if node.ends else None])

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*self.out, strict=True), _OUT, strict=True)], schema=_OUT)
            self.out = []


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a task's range: rows of runs by segment in, finished nodes and parts of nodes out."""
    path = Path(TaskContext.get().partitionId())
    last: bytes | None = None

    def take(runs: list[dict]) -> Iterator[pa.RecordBatch]:
        nonlocal last
        begun = True
        for shared, seq, conv in merged([read_run(r) for r in runs]):
            if begun:  # the last one of the segment before
                shared, begun = shared_turns(last or b"", seq), False
            if last is None:
                path.push(b"", True)
            while len(path.stack) > shared + 1:
                if path.stack[-1].first:
                    path.part_of(path.stack.pop(), len(path.stack), 0)
                else:
                    path.close()
            for at in range(shared * CODE, len(seq), CODE):
                path.push(seq[at : at + CODE], last is None)
            top = path.stack[-1]
            top.take(1, conv, 0, 0, 0)
            top.ends.append(b"%d" % conv)
            last = seq
            yield from path.batches(ROWS)

    segment, runs = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["segment"] != segment:
                if runs:
                    yield from take(runs)
                segment, runs = row["segment"], []
            runs.append(row)
    if runs:
        yield from take(runs)
    depth = len(path.stack)
    while path.stack:
        node, depth = path.stack.pop(), depth - 1
        if node.first:  # on both paths: its part is told once
            path.out.append([3, None, depth, None, 0, 0, 0, 0, None, path.part, 0, node.code, None])
        path.part_of(node, depth, 1)
    yield from path.batches(1)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of which tasks have parts: their first and last paths in order, each from the root down."""
    path, place, shared = Path(-1), None, False
    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if (row["part"], row["side"]) != place:
                place, shared = (row["part"], row["side"]), True
            if shared and (depth >= len(path.stack) or path.stack[depth].code != row["code"]):
                shared = False  # from here on the path is a new one
                while len(path.stack) > depth:
                    path.close()
            if not shared:
                path.push(row["code"])
            node = path.stack[depth]
            node.take(row["n_convs"], row["conv_id"], row["n_children"], row["n_leaves"], row["saved_tokens"])
            if row["ends"] is not None:
                node.ends.append(row["ends"])
            if row["parent"] is not None:
                node.slots.append(row["parent"])
            yield from path.batches(ROWS)
    while path.stack:
        path.close()
    yield from path.batches(1)


# -- the operator -------------------------------------------------------------------------------


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """A row for each node of the trie of sequences (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The turn of a node at depth d is the d-th of its conv_id, which is its smallest member.
    """
    rows = settle_table(sequences.select("conv_id", F.unhex(F.array_join("turns", "")).alias("seq")))
    runs = rows.repartitionByRange("seq", "conv_id").mapInArrow(_runs, RUN).sortWithinPartitions("segment", "run")
    told = settle_table(runs.mapInArrow(_folded, OUT))
    between = settle(told.where("kind = 3").repartition(1).sortWithinPartitions("part", "side", "depth").mapInArrow(_joined, OUT))
    both = lambda kind: told.where(F.col("kind") == kind).unionByName(between.where(F.col("kind") == kind))
    slots = both(2).select("parent", F.col("conv_id").alias("parent_conv_id"))
    late = both(1).join(slots, "parent")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return both(0).withColumnRenamed("parent", "parent_conv_id").select(*columns).unionByName(late.select(*columns))


def grafted_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations that begin with turns of their base."""
    return prefix_trie(grafted(turn_sequences(conversations)))
