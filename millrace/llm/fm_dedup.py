"""Substring de-duplication by a compressed FM-index per shard.

Words are maximal runs of bytes other than the six ASCII white ones. A window is WINDOW
consecutive words of one document; each word is removed that a window covers whose words
also start in a document with a smaller doc_id. Windows are judged on the input.

`windows` routes text that may recur to shards. A shard numbers its words, builds the
Burrows-Wheeler transform of its pieces and keeps of it: wavelet bits of the transform,
wavelet bits of the owners in the order of suffixes, and a bit wherever neighbours share
fewer than WINDOW - 1 words. Suffix order and text are dropped. The pieces of documents that
may lose words - all but an anchor's first holder - are then streamed through it: backward
search extends a match by one word to the left, after widening its interval to the matches of
WINDOW - 1 words where it has as many. So at every position the matching statistic (capped
at the threshold) and its interval are known; where it reaches the threshold, a descent
through the owners' bits gives the least doc_id of the interval. All streamed pieces of a
shard move one step at a time, as arrays.

Defined results: null text has no words; kept words are joined by one space (no words: the
digest of the empty text); a null doc_id is larger than any other, and rows that share a
doc_id don't remove each other's words; repeated rows are each returned; an empty table
gives no rows; other columns are ignored. A very long text is cut into pieces by anchors and
rejoined by its spans alone.
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
from millrace.llm.words import span_hashes, word_spans

WINDOW = 50
GRAM = 8
#: Starts of a streamed piece that are searched one after the other.
STRETCH = 256
OUT = "n_words long, n_removed long, kept_sha256 string"

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(raw, _WORD, offsets)
    return span_hashes(raw, starts, ends), first


def _bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_spans(raw, _WORD, offsets)[:2]


def _plain(text: bytes) -> bytes:
    return b" ".join(text.split())


WORDS = Units(WINDOW, GRAM, _hashes, _bounds, _plain)


class Bits:
    """Packed bits with counts for each 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64)))).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many are set before each position."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[block] + np.bitwise_count(self.words[block] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the bit stands before which k are set."""
        block = np.searchsorted(self.counts, k, "right") - 1
        word, left = self.words[block], k - self.counts[block]
        at = np.zeros(len(k), np.int64)
        for span in (32, 16, 8, 4, 2, 1):  # halves of what is left of the word
            low = np.bitwise_count((word >> at.astype(np.uint64)) & np.uint64((1 << span) - 1))
            right = left >= low
            left, at = np.where(right, left - low, left), np.where(right, at + span, at)
        return block * 64 + at


class WaveletMatrix:
    """Counts of symbols and least symbols of ranges over a sequence of small numbers, from bits alone."""

    def __init__(self, values: np.ndarray, distinct: int):
        self.levels = max(1, int(distinct - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1 == 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate((values[~bit], values[bit]))
        self.origin = self._descend(np.arange(distinct), np.zeros(distinct, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bits, zeros, level in zip(self.bits, self.zeros, reversed(range(self.levels)), strict=True):
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position `at`."""
        return self._descend(symbol, at) - self.origin[symbol]

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least symbol of each range, which isn't empty."""
        out = np.zeros(len(low), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            ones = bits.rank(np.concatenate((low, high)))
            a, b = ones[: len(low)], ones[len(low) :]
            none = high - b == low - a  # no zero in the range
            low, high = np.where(none, zeros + a, low - a), np.where(none, zeros + b, high - b)
            out = out * 2 + none
        return out


class FmIndex:
    """An index over pieces (arrays of numbers from 1), for matches of at most `most` symbols."""

    def __init__(self, pieces: list[np.ndarray], owners: np.ndarray, distinct: int, most: int):
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1)
        self.n, self.most = int(ends[-1]), most
        # big-endian numbers of one width compare as strings do; a separator is 0
        text = np.zeros(self.n + most, ">u2" if distinct < 1 << 16 else ">u4")
        inner = np.ones(self.n, bool)
        inner[ends - 1] = False
        text[: self.n][inner] = np.concatenate(pieces)
        size = text.itemsize
        at = np.lib.stride_tricks.sliding_window_view(text.view(np.uint8), most * size)[:: size][: self.n]
        order = np.argsort(np.ascontiguousarray(at).view(f"S{most * size}").ravel(), kind="stable")
        near = np.ascontiguousarray(at[order, : (most - 1) * size]).view(f"S{(most - 1) * size}").ravel()
        self.opens = Bits(np.concatenate(([True], near[1:] != near[:-1], [True])))
        plain = text[: self.n].astype(np.int64)
        self.transform = WaveletMatrix(plain[order - 1], distinct + 1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(plain, minlength=distinct + 1))))
        self.known = np.unique(owners)
        self.owners = WaveletMatrix(np.repeat(np.searchsorted(self.known, owners), lengths + 1)[order], len(self.known))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches extended by one symbol to the left."""
        both = self.transform.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return self.before[symbol] + both[: len(symbol)], self.before[symbol] + both[len(symbol) :]

    def widened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals around a position whose suffixes share `most` - 1 symbols."""
        k = self.opens.rank(low + 1)
        return self.opens.select(k - 1), self.opens.select(k)

    def statistics(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """For each start in each piece the least owner of the pieces that hold the `most` symbols there (-1: none, or fewer are left).

        Their symbols are the index's. A match of a piece of the index can always be extended;
        pieces with one that can't are searched once more, each window by itself.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        text = np.concatenate(pieces)
        out = np.full(len(text), -1, np.int64)
        # stretches of starts, each with the symbols that its last windows reach
        parts = np.maximum(1, -(-np.maximum(0, lengths - self.most + 1) // STRETCH))
        own = np.repeat(np.arange(len(pieces)), parts)
        start = (np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRETCH
        size_of = np.minimum(lengths[own] - start, STRETCH + self.most - 1)
        turn = np.argsort(-size_of, kind="stable")
        lengths, at = size_of[turn], ((ends - lengths)[own] + start + size_of - 1)[turn]
        low, high = np.zeros(len(own), np.int64), np.full(len(own), self.n, np.int64)
        size = np.zeros(len(own), np.int64)
        strange: set[int] = set()
        for done in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -done, "left"))  # longer than done
            full = np.flatnonzero(size[:live] == self.most)
            low[full], high[full] = self.widened(low[full])
            size[full] -= 1
            here = at[:live] - done
            low[:live], high[:live] = self.step(text[here], low[:live], high[:live])
            size[:live] += 1
            lost = np.flatnonzero(low[:live] >= high[:live])
            low[lost], high[lost], size[lost] = 0, self.n, -len(text)
            strange.update(own[turn[lost]].tolist())
            found = np.flatnonzero(size[:live] == self.most)
            out[here[found]] = self.known[self.owners.least(low[found], high[found])]
        for k in strange:
            lo = ends[k] - len(pieces[k])
            out[lo : ends[k]] = self._each_window(pieces[k])
        return np.split(out, ends[:-1])

    def _each_window(self, piece: np.ndarray) -> np.ndarray:
        out = np.full(len(piece), -1, np.int64)
        at = np.arange(len(piece) - self.most + 1)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        for k in reversed(range(self.most)):
            low, high = self.step(piece[at + k], low, high)
            there = low < high
            at, low, high = at[there], low[there], high[there]
        out[at] = self.known[self.owners.least(low, high)]
        return out


def least_owners(pieces: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """Piece, from, to and least id, among the pieces that hold the window, of the spans of windows that have one such id."""
    anchor, ids, last = (pieces.column(c).to_numpy() for c in ("anchor", "id", "last_id"))
    raw, offsets = utf8(pieces.column("piece"))
    known: dict[bytes, int] = {}
    data = raw.tobytes()
    numbered = [np.array([known.setdefault(w, len(known) + 1) for w in data[a:b].split()], np.int64) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    opens = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first = np.repeat(np.minimum.reduceat(ids, opens), np.diff(np.append(opens, len(ids))))
    streamed = np.flatnonzero(last > first)  # the first holder of an anchor loses nothing there
    if not len(streamed):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    stream = [numbered[k] for k in streamed.tolist()]
    who = np.concatenate(FmIndex(numbered, ids, len(known), window).statistics(stream))
    ends = np.cumsum(np.fromiter(map(len, stream), np.int64, len(stream)))
    # no span goes over the end of its piece, where windows don't fit
    edges = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1], [True])))
    a, b = edges[:-1], edges[1:]
    told = who[a] >= 0
    a, b = a[told], b[told]
    piece = np.searchsorted(ends, a, "right")
    begin = np.concatenate(([0], ends))[piece]
    return streamed[piece], a - begin, b - begin, who[a]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, removed, shas = [], [], []
        covered = batch.column("covered").to_pylist() if "covered" in batch.schema.names else [None] * batch.num_rows
        for body, spans in zip(batch.column("body").to_pylist(), covered, strict=True):
            words = body.split()
            totals.append(len(words))
            if spans:
                gone = cover(len(words), spans)
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            removed.append(totals[-1] - len(words))
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.record_batch([batch.column("id"), batch.column("key"), batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["id", "key", "doc_id", "n_words", "n_removed", "kept_sha256"])


def covered_words(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keyed rows, those that hold candidates, and by id and key the word spans to remove."""
    rows = keyed(docs)
    candidates, spans = shared_windows(rows, WORDS, least_owners, across=True)
    return rows, candidates, merged_spans(spans.where("who < id"), WINDOW)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of docs.

    Rows without a repeated window are done in the scan; only the others' texts are joined
    with their spans.
    """
    rows, candidates, covered = covered_words(docs)
    own, schema = ["id", "key"], f"id long, key long, doc_id long, {OUT}"
    plain = rows.select(*own, "doc_id", "body").mapInArrow(_kept, schema)
    cut = candidates.select(*own, "doc_id", "body").dropDuplicates(own).join(covered, own).mapInArrow(_kept, schema)
    cut = cut.select(*own, F.col("n_removed").alias("cut_removed"), F.col("kept_sha256").alias("cut_sha"))
    return plain.join(cut, own, "left").select("doc_id", "n_words", F.coalesce("cut_removed", "n_removed").alias("n_removed"), F.coalesce("cut_sha", "kept_sha256").alias("kept_sha256"))
