"""Suffix-array de-duplication with two-stage sorting.

Every byte is removed that a string of WINDOW bytes covers which also starts anywhere else,
in the same document or another; matches never cross documents and are judged on the
input. `windows` routes text that may recur to shards; a shard sorts the suffixes of its
pieces in two stages. Only suffixes smaller than their successor are sorted directly, as
strings of WINDOW bytes. The others are induced: a scan over the buckets of first
bytes, from small to large, finds each of them - as the predecessor of a suffix in its
place - in the order they belong in; those of a run of equal bytes are placed at once. Then
the common prefixes of neighbours are computed; neighbours that share WINDOW bytes are
occurrences of one string.

Defined results: null text is empty; a row that is repeated makes its strings occur twice;
repeated rows are each returned; an empty table gives no rows; other columns are ignored. A
very long text is cut into pieces by anchors and rejoined by its spans alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import utf8
from millrace.llm.windows import Units, cover, keyed, merged_spans, shared_windows

WINDOW = 200
GRAM = 64
#: Suffixes that are sorted as strings at once.
SORTED_AT_ONCE = 400_000
_BYTE = np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=np.uint64)


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _BYTE[raw], offsets


def _bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(raw))
    return at, at + 1


BYTES = Units(WINDOW, GRAM, _hashes, _bounds, bytes)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; text ends with its smallest symbol."""
    n = len(text)
    rises = np.zeros(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    deciding = np.where(differs, np.arange(n), n - 1)
    deciding = np.minimum.accumulate(deciding[::-1])[::-1]
    rises[n - 1] = True  # the empty suffix follows
    return rises[deciding]


def _strings(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes from each place as one comparable value; text is padded by as many zeros."""
    return np.lib.stride_tricks.sliding_window_view(text, size)[at].view(f"S{size}").ravel()


def direct_order(text: np.ndarray, found: np.ndarray, depth: int, done: int = 0) -> np.ndarray:
    """Suffixes `found`, alike in their first `done` bytes, in order of their first `depth`, equal ones as they stand.

    text is padded by depth + 8 zeros. Many suffixes are split by their next eight bytes
    first, so that strings of a bounded number are held at once.
    """
    if len(found) <= SORTED_AT_ONCE or done >= depth:
        return found[np.argsort(_strings(text, found, depth), kind="stable")] if done < depth else found
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8)[found + done]).view(">u8").ravel().astype(np.uint64)
    turn = np.argsort(key, kind="stable")
    found, key = found[turn], key[turn]
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    out, lo = [], 0
    while lo < len(found):
        hi = int(edges[np.searchsorted(edges, lo + SORTED_AT_ONCE, "right") - 1])
        if hi > lo:
            out.append(found[lo:hi][np.argsort(_strings(text, found[lo:hi], depth), kind="stable")])
        else:  # more than enough that share these eight bytes too
            hi = int(edges[np.searchsorted(edges, lo, "right")])
            out.append(direct_order(text, found[lo:hi], depth, done + 8))
        lo = hi
    return np.concatenate(out)


def two_stage_sort(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text, bytes that end with its smallest one, 0, in the order of their first `depth` bytes at least."""
    n = len(text)
    small = smaller_than_next(text)
    sizes = np.bincount(text, minlength=256)
    head = np.cumsum(sizes) - sizes
    direct = direct_order(np.concatenate((text, np.zeros(depth + 8, np.uint8))), np.flatnonzero(small), depth)
    order = np.full(n, -1, np.int64)
    smalls = np.bincount(text[direct], minlength=256)
    tail = head + sizes - smalls  # where a bucket's directly sorted suffixes begin
    at = np.cumsum(smalls) - smalls
    order[np.arange(len(direct)) - at[text[direct]] + tail[text[direct]]] = direct
    free = head.copy()
    new_run = np.concatenate(([True], text[1:] != text[:-1]))
    run_start = np.maximum.accumulate(np.where(new_run, np.arange(n), 0))

    def induce(found: np.ndarray, own: int) -> None:
        before = found[found > 0] - 1
        symbol = text[before]
        before = before[~small[before] & (symbol != own)]
        symbol = text[before]
        turn = np.argsort(symbol, kind="stable")
        before, symbol = before[turn], symbol[turn]
        counts = np.bincount(symbol, minlength=256)
        begin = np.cumsum(counts) - counts
        order[free[symbol] + np.arange(len(before)) - begin[symbol]] = before
        free[:] += counts

    for c in np.flatnonzero(sizes):
        # a suffix induces the rest of its run: those one byte longer follow it, then those two longer, each in its order
        first = order[head[c] : free[c]]
        longer = first - run_start[first]
        if longer.any():
            steps = np.arange(longer.sum()) - np.repeat(np.cumsum(longer) - longer, longer) + 1
            run = np.repeat(first, longer) - steps
            order[free[c] : free[c] + len(run)] = run[np.argsort(steps, kind="stable")]
            free[c] += len(run)
        induce(order[head[c] : free[c]], c)
        induce(order[tail[c] : head[c] + sizes[c]], c)
    return order


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes, `most` at the utmost, that the suffixes at each of a (ascending) and of b share.

    Neighbours of consecutive suffixes mostly are consecutive too: along such a chain each
    byte is compared once, and only from its end on further bytes are.
    """
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((text, np.zeros(most + 16, np.uint8)))
    ends = np.flatnonzero(np.concatenate(((a[1:] - a[:-1] != 1) | (b[1:] - b[:-1] != 1), [True])))
    reach = np.zeros(len(ends), np.int64)
    words = np.ndarray((len(padded) - 8,), "<u8", padded, strides=(1,))
    open_ = np.arange(len(ends))
    for at in range(0, most, 8):
        if not len(open_):
            break
        x = words[a[ends[open_]] + at] ^ words[b[ends[open_]] + at]
        reach[open_] = at + (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        open_ = open_[x == 0]
    stop = np.full(n, n, np.int64)
    differ = np.flatnonzero(text[a] != text[b])
    stop[differ] = differ
    stop[ends] = ends
    stop = np.minimum.accumulate(stop[::-1])[::-1]  # where a chain differs next, or ends
    further = np.zeros(n, np.int64)
    further[ends] = reach
    return np.minimum(stop - np.arange(n) + further[stop], most)


def repeated_spans(pieces: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """Piece, from, to and 0 of the spans of starts whose window occurs again, counting each piece `times` times."""
    raw, offsets = utf8(pieces.column("piece"))
    lengths = np.diff(offsets)
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    used = np.flatnonzero(np.bincount(raw, minlength=256))  # fewer than 256, as UTF-8 never has them all
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    text = np.zeros(int(ends[-1]), np.uint8)
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False
    text[inner] = code[raw]
    order = two_stage_sort(text, window)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, np.maximum(begins, ends - window), -1)
    starts = np.cumsum(change[:-1]) > 0  # windows that end within their piece
    order = order[starts[order]]
    flags = np.zeros(len(text), bool)
    if len(order):
        neighbour = np.full(len(text), -1, np.int64)
        neighbour[order[1:]] = order[:-1]
        a = np.flatnonzero(neighbour >= 0)
        shared = np.zeros(len(text), np.int64)
        shared[a] = common_prefixes(text, a, neighbour[a], window)
        opens = np.flatnonzero(shared[order] < window)
        weight = np.repeat(pieces.column("times").to_numpy(), lengths + 1)[order]
        total = np.add.reduceat(weight, opens)
        flags[order] = np.repeat(total > 1, np.diff(np.append(opens, len(order))))
    # no run goes over the end of its piece, where windows don't fit
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    a, b = edges[::2], edges[1::2]
    piece = np.searchsorted(ends, a, "right")
    return piece, a - begins[piece], b - begins[piece], np.zeros(len(a), np.int64)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        covered = batch.column("covered").to_pylist() if "covered" in batch.schema.names else [None] * batch.num_rows
        for body, spans in zip(batch.column("body").to_pylist(), covered, strict=True):
            gone, pieces = 0, 0
            if spans:
                flags = cover(len(body), spans)
                gone, pieces = int(flags.sum()), int((flags & ~np.concatenate(([False], flags[:-1]))).sum())
                kept = np.frombuffer(body, np.uint8)[~flags].tobytes()
            else:
                kept = body
            rows.append((len(body), gone, pieces, hashlib.sha256(kept).hexdigest()))
        n, gone, pieces, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([batch.column("id"), batch.column("key"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(pieces, pa.int64()), pa.array(sha, pa.string())], names=["id", "key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs."""
    rows = keyed(docs)
    candidates, spans = shared_windows(rows, BYTES, repeated_spans, across=False)
    covered = merged_spans(spans, WINDOW)
    own, schema = ["id", "key"], "id long, key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    plain = rows.select(*own, "doc_id", "body").mapInArrow(_kept, schema)
    cut = candidates.select(*own, "doc_id", "body").dropDuplicates(own).join(covered, own).mapInArrow(_kept, schema)
    cut = cut.select(*own, *(F.col(c).alias(f"cut_{c}") for c in ("n_removed", "n_spans", "kept_sha256")))
    return plain.join(cut, own, "left").select("doc_id", "n_bytes", *(F.coalesce(f"cut_{c}", c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256")))
