"""Windows that documents share: routing them to the shards that decide.

A window is a fixed number of consecutive units (words or bytes). Its anchor is the least
hash of the short grams in it, so equal windows have equal anchors wherever they are, and
a document's windows fall into few runs of equal anchor. Only anchors are shuffled at first;
those found once go, with nearly all of the corpus. Documents that hold a shared anchor are
fetched, and the text under each run of a shared anchor becomes a piece, dealt out by anchor.
Equal pieces are one piece with a count, so a group of copies costs a shard no more than one
of them. An anchor with very many different pieces - a passage in ever new surroundings - is
not left to one task: its windows are counted by their own hash, and the texts of those whose
hash occurs again are dealt out, each text once with its counts, to a shard for each hash. The
hash only routes: what decides compares the texts.

What decides - an FM-index or a suffix array over the pieces of a shard - is handed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import in_chunks, utf8
from millrace.llm.exact_dedup import content_key, row_id
from millrace.llm.words import mix
from millrace.session import settle, settle_table

#: Bytes of text that a task turns into arrays at once.
CHUNK_BYTES = 1 << 19
#: Windows of a piece; a longer run of one anchor is several pieces.
LONGEST_RUN = 1 << 16
#: Different pieces under one anchor, and their bytes, beyond which its windows are dealt out by their own hash.
CROWDED = 4000
CROWDED_BYTES = 1 << 24
#: Bits of the hash that routes a window of a crowded piece.
ROUTE_BITS = 64
#: Windows of crowded pieces whose texts a task holds at once.
TEXTS_AT_ONCE = 20_000
#: Bytes of pieces that a shard indexes at once; a single anchor may have more.
SHARD_BYTES = 1 << 20


@dataclass(frozen=True)
class Units:
    """How text is cut into units.

    hashes: raw bytes and row offsets to a hash of each unit and the index of each row's
    first unit. bounds: the same to byte starts and ends of each unit. plain: a text to the
    form in which equal units are equal bytes.
    """

    window: int
    gram: int
    hashes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    bounds: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    plain: Callable[[bytes], bytes]


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each `width` consecutive values."""
    span = 1
    out = values
    while span * 2 <= width:
        out = best(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive units; size is a power of two."""
    base = 0x9E3779B97F4A7C15
    span = 1
    while span < size:
        h = h[:-span] * np.uint64(pow(base, span, 1 << 64)) + h[span:]
        span *= 2
    return mix(h)


def runs(h: np.ndarray, first: np.ndarray, units: Units, repeats: bool = False) -> tuple[np.ndarray, ...]:
    """Row, start, number of windows (LONGEST_RUN at most) and anchor of each run of windows with one anchor; with `repeats` also whether its anchor stands in it more than once."""
    n = len(h) - units.window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.astype(bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = _grams(h, units.gram)
    width = units.window - units.gram + 1
    least = _sliding(grams, width, np.minimum)
    whole = row[:n] == row[units.window - 1 :]
    new = np.ones(n + 1, bool)
    new[1:n] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1]) | (row[1:n] != row[: n - 1])
    edges = np.flatnonzero(new)
    start, count = edges[:-1], np.diff(edges)
    keep = whole[start]
    start, count = start[keep], count[keep]
    anchor = least[start]
    again = np.zeros(len(start), bool)
    if repeats and len(start):
        # a gram is an anchor where the greatest of the minima around it is itself
        padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
        at = np.flatnonzero(_sliding(padded, width, np.maximum)[: len(grams)] == grams)
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, start + count + width - 1)
        size = hi - lo
        pick = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own = np.repeat(np.arange(len(start)), size)
        again = np.bincount(own[grams[at[pick]] == anchor[own]], minlength=len(start)) > 1
    if len(start) and count.max() > LONGEST_RUN:
        parts = -(-count // LONGEST_RUN)
        own = np.repeat(np.arange(len(start)), parts)
        past = (np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST_RUN
        start, count, anchor, again = start[own] + past, np.minimum(count[own] - past, LONGEST_RUN), anchor[own], again[own] | (parts[own] > 1)
    return row[start], start - first[row[start]], count, anchor, again


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its rank id (null last), a key of the row's content, and the text as bytes (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("id"), content_key().alias("key"), text.cast("binary").alias("body"))


def _batch_runs(column: pa.Array, units: Units, repeats: bool = False) -> Iterator[tuple]:
    """Runs of a column, chunk by chunk: first row of the chunk, its bytes and offsets, and the runs."""
    raw, offsets = utf8(column)
    for lo, hi in in_chunks(np.diff(offsets), CHUNK_BYTES):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        h, first = units.hashes(part, at)
        yield lo, part, at, first, runs(h, first, units, repeats)


def anchors(rows: DataFrame, units: Units) -> DataFrame:
    """anchor, key, id and times (2 if the anchor stands in the run more than once) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rank = (batch.column(c).to_numpy() for c in ("key", "id"))
            for lo, _, _, _, (row, _, _, anchor, again) in _batch_runs(batch.column("body"), units, True):
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(key[lo + row]), pa.array(rank[lo + row]), pa.array(again.astype(np.int32) + 1)], names=["anchor", "key", "id", "times"])

    return rows.select("key", "id", "body").mapInArrow(run, "anchor long, key long, id long, times int")


def pieces_of(candidates: DataFrame, units: Units) -> DataFrame:
    """A row for each run of a shared anchor: anchor, a hash of its text, key, id, start, number of windows, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rank = (batch.column(c).to_numpy() for c in ("key", "id"))
            shared, body = batch.column("anchors"), batch.column("body")
            known, limits = shared.flatten().to_numpy(zero_copy_only=False).astype(np.int64), shared.offsets.to_numpy()
            for lo, part, at, first, (row, start, count, anchor, _) in _batch_runs(body, units):
                begin, end = units.bounds(part, at)
                keep = np.zeros(len(row), bool)
                for r in np.unique(row):
                    mine = row == r if len(at) > 2 else slice(None)
                    keep[mine] = np.isin(anchor[mine].view(np.int64), known[limits[lo + r] - limits[0] : limits[lo + r + 1] - limits[0]])
                row, start, count, anchor = row[keep], start[keep], count[keep], anchor[keep]
                if not len(row):
                    continue
                a = begin[first[row] + start]
                b = end[first[row] + start + count + units.window - 2]
                data = part.tobytes()
                texts = [units.plain(data[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                marks = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
                yield pa.record_batch(
                    [pa.array(anchor.view(np.int64)), pa.array(marks), pa.array(key[lo + row]), pa.array(rank[lo + row]), pa.array(start.astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(texts, pa.binary())],
                    names=["anchor", "mark", "key", "id", "start", "count", "piece"],
                )

    return candidates.select("key", "id", "anchors", "body").mapInArrow(run, "anchor long, mark long, key long, id long, start long, count int, piece binary")


def _windows(units: Units):
    """The windows of pieces, by the hash of their units."""
    kept = np.uint64((1 << ROUTE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("piece"))
            for lo, hi in in_chunks(np.diff(offsets), CHUNK_BYTES):
                part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                h, first = units.hashes(part, at)
                count = np.maximum(0, np.diff(first) - units.window + 1)
                row = np.repeat(np.arange(hi - lo), count)
                off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                total = np.zeros(max(0, len(h) - units.window + 1), np.uint64)
                for k in range(units.window):
                    total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)]
                hashed = (mix(total) & kept)[first[row] + off]
                of = lambda c: pa.array(batch.column(c).to_numpy()[lo + row])  # noqa: B023, E731
                yield pa.record_batch([pa.array(hashed.view(np.int64)), of("anchor"), of("mark"), pa.array(off.astype(np.int32)), of("id"), of("times"), of("last_id")], names=["hash", "anchor", "mark", "off", "id", "times", "last_id"])

    return run


def _texts(units: Units):
    """The listed windows of each piece: hash and a second hash of the text, place, counts, and the text where a chunk has it first."""
    names = ["hash", "tell", "anchor", "mark", "off", "id", "last_id", "times", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = [], set()
        for batch in batches:
            for row in batch.to_pylist():
                piece = row["piece"]
                raw = np.frombuffer(piece, np.uint8)
                begin, end = units.bounds(raw, np.array([0, len(raw)]))
                for w in row["wanted"]:
                    text = piece[begin[w["off"]] : end[w["off"] + units.window - 1]]
                    tell = int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))
                    out.append((w["hash"], tell, row["anchor"], row["mark"], w["off"], row["id"], row["last_id"], row["times"], None if text in seen else text))
                    seen.add(text)
                if len(out) >= TEXTS_AT_ONCE:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, seen = [], set()
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _decided(decide: Callable, units: Units):
    """Index whole anchors, a bounded number of units at a time; rows arrive sorted by anchor."""
    most = SHARD_BYTES

    def emit(rows: pa.RecordBatch) -> pa.RecordBatch:
        row, a, b, who = decide(rows, units.window)
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows.num_rows))))
        spans = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(who, pa.int64())], names=["a", "b", "who"])
        return pa.record_batch([rows.column("anchor"), rows.column("mark"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=["anchor", "mark", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += int(np.diff(utf8(batch.column("piece"))[1]).sum())
            last = batch.column("anchor")[-1].as_py()
            if size < most or held[0].column("anchor")[0].as_py() == last:
                continue
            rows = pa.concat_batches(held)
            cut = int(np.searchsorted(rows.column("anchor").to_numpy(), last))  # the last anchor may go on
            yield emit(rows.slice(0, cut))
            held = [rows.slice(cut)]
            size = int(np.diff(utf8(held[0].column("piece"))[1]).sum())
        if held:
            yield emit(pa.concat_batches(held))

    return run


def _shards(pieces: DataFrame, decide: Callable, units: Units) -> DataFrame:
    return pieces.select("anchor", "mark", "id", "last_id", "times", "piece").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_decided(decide, units), "anchor long, mark long, spans array<struct<a:int,b:int,who:long>>")


def shared_windows(rows: DataFrame, units: Units, decide: Callable, across: bool) -> tuple[DataFrame, DataFrame]:
    """Which windows of keyed() rows occur again.

    across: only windows of two ids count, else any two occurrences. decide(pieces with
    anchor, id, last_id and times, window) gives, as arrays in order of the piece, the piece,
    start, end and least id of spans of windows that occur again among them. Returns the rows that hold candidates (key, id, body, settled)
    and key, id, lo, hi, who for each span of windows lo <= start < hi that occurs again.
    """
    found = settle_table(anchors(rows, units))
    if across:
        shared = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    else:
        shared = found.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1")
    holders = found.select("anchor", "id", "key").join(shared.select("anchor"), "anchor").groupBy("id", "key").agg(F.collect_set("anchor").alias("anchors"))
    candidates = settle_table(rows.join(holders, ["id", "key"]))
    occurrences = settle_table(pieces_of(candidates, units))
    times = F.count("*").alias("times")
    pieces = settle_table(occurrences.groupBy("anchor", "mark").agg(F.min("id").alias("id"), F.max("id").alias("last_id"), times, F.first("piece").alias("piece")))
    held = pieces.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("piece")).alias("size"))
    crowded = settle(held.where((F.col("n") > CROWDED) | (F.col("n") > 1) & (F.col("size") > CROWDED_BYTES)).select("anchor"))
    if crowded.isEmpty():
        spans = _shards(pieces, decide, units)
    else:
        spans = _shards(pieces.join(crowded, "anchor", "left_anti"), decide, units).unionByName(_crowded(settle_table(pieces.join(crowded, "anchor", "left_semi")), decide, units, across))
    told = occurrences.select("anchor", "mark", "key", "id", "start").join(spans, ["anchor", "mark"]).select("key", "id", "start", F.explode("spans").alias("s"))
    return candidates, told.select("key", "id", (F.col("start") + F.col("s.a")).alias("lo"), (F.col("start") + F.col("s.b")).alias("hi"), F.col("s.who").alias("who"))


def _crowded(pieces: DataFrame, decide: Callable, units: Units, across: bool) -> DataFrame:
    """Spans of pieces under crowded anchors: windows whose hash occurs again go to the shard of that hash, which compares their texts."""
    wins = settle(pieces.mapInArrow(_windows(units), "hash long, anchor long, mark long, off int, id long, times long, last_id long"))
    counted = wins.groupBy("hash").agg(F.min("id").alias("least"), F.max("last_id").alias("high"), F.sum("times").alias("times"))
    again = settle(counted.where("least < high" if across else "times > 1").select("hash"))
    wanted = wins.join(again, "hash").groupBy("anchor", "mark").agg(F.collect_list(F.struct("hash", "off")).alias("wanted"))
    told = pieces.select("anchor", "mark", "id", "last_id", "times", "piece").join(wanted, ["anchor", "mark"])
    told = settle_table(told.mapInArrow(_texts(units), "hash long, tell long, anchor long, mark long, off int, id long, last_id long, times long, text binary"))
    texts = told.groupBy("hash", "tell").agg(F.min("id").alias("id"), F.max("last_id").alias("last_id"), F.sum("times").alias("times"), F.first("text", ignorenulls=True).alias("piece"))
    decided = _shards(texts.withColumnsRenamed({"hash": "anchor", "tell": "mark"}), decide, units).select(F.col("anchor").alias("hash"), F.col("mark").alias("tell"), F.explode("spans").alias("s"))
    return told.select("hash", "tell", "anchor", "mark", "off").join(decided, ["hash", "tell"]).groupBy("anchor", "mark").agg(F.collect_list(F.struct(F.col("off").alias("a"), (F.col("off") + 1).alias("b"), F.col("s.who").alias("who"))).alias("spans"))


def merged_spans(spans: DataFrame, width: int) -> DataFrame:
    """id, key and the list of (a, b): what the windows of each row's spans cover, in units; not merged yet where spans overlap."""
    return spans.groupBy("id", "key").agg(F.collect_set(F.struct(F.col("lo").alias("a"), (F.col("hi") + (width - 1)).alias("b"))).alias("covered"))


def cover(n: int, covered: list[dict]) -> np.ndarray:
    """A flag for each of n units."""
    change = np.zeros(n + 1, np.int64)
    for s in covered:
        change[s["a"]] += 1
        change[s["b"]] -= 1
    return np.cumsum(change[:n]) > 0


