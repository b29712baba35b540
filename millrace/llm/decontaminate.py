"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters, digits and bytes beyond ASCII; in scripts without
spaces between words every character is one. A seed is a mask
over token positions: it hashes the positions it keeps and ignores the others, so a
substituted token under an ignored position does not hide a hit. The two masks hit every
run of WINDOW aligned tokens that has at most SUBSTITUTIONS substitutions (which their
test proves by going through all cases). Hashes of the benchmark are joined with those of
the documents; around a hit the aligned tokens themselves are compared and the overlap is
reported if it holds such a run. Items of fewer tokens than WINDOW must occur as a whole: with
at most one substitution from TOLERANT tokens on, for which each of three masks leaves out a
third of them, and without any if they are shorter. Of these the first occurrence is reported.

Documents are read once, however large the benchmark is. A Bloom filter of fixed size over
the benchmark's seeds, which is broadcast, drops nearly all of their seeds in the scan; those
that are left are shuffled to the benchmark's, together with the text as far around them as
the longest item reaches, so that whole documents are neither shuffled nor read again.

Defined results: null text has no tokens, null items and items with a null id none either;
repeated documents are each reported, repeated items under their own ids; an empty table on
either side gives no rows; other columns are ignored. Very long texts are held one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import in_chunks, utf8
from millrace.llm.exact_dedup import content_key, row_id, without
from millrace.llm.words import mix, span_hashes, word_spans
from millrace.session import settle, settle_table

WINDOW = 13
SUBSTITUTIONS = 2
TOLERANT = 6
#: Of an item of one or two words nearly every document may be one: such items are reported, but no reason to drop a document.
LEAST_TOKENS = 3
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Bits, as a power of two, of the filter that is broadcast: 8 MB.
FILTER_BITS = 26
CHUNK_BYTES = 1 << 20
FOUND = "doc long, doc_id long, id long, key long, item long, item_id long, overlap_tokens long, equal_tokens long, doc_start long, item_start long"

# Code points of scripts without spaces between words: Thai and Lao, Burmese, Khmer, Japanese, Chinese.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))

_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True


def unspaced_edges(raw: np.ndarray) -> np.ndarray | None:
    """Marks of the bytes at which a character of an unspaced script begins or has just ended."""
    lead = np.flatnonzero(raw >= 0xE0)
    if not len(lead):
        return None
    four = raw[lead] >= 0xF0
    b = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.int64)
    low = [b[lead + k] & 63 for k in (1, 2, 3)]
    code = np.where(four, (b[lead] & 7) << 18 | low[0] << 12 | low[1] << 6 | low[2], (b[lead] & 15) << 12 | low[0] << 6 | low[1])
    found = np.zeros(len(lead), bool)
    for lo, hi in UNSPACED:
        found |= (code >= lo) & (code <= hi)
    edges = np.zeros(len(raw) + 4, bool)
    edges[lead[found]] = True
    edges[lead[found] + 3 + four[found]] = True
    return edges[: len(raw)]


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each token of a lower-cased column, and the index of each row's first token."""
    raw, offsets = utf8(column)
    starts, ends, first = word_spans(raw, _WORD, offsets, unspaced_edges(raw))
    return span_hashes(raw, starts, ends), first


def tolerated(width: int) -> int:
    """Substitutions in an aligned run of so many tokens."""
    return SUBSTITUTIONS if width == WINDOW else int(width >= TOLERANT)


def whole_masks(n: int) -> list[tuple[int, ...]]:
    """Masks that hit an item of n tokens with as many substitutions as are tolerated."""
    return [tuple(k for k in range(n) if k * 3 // n != third) for third in range(3)] if tolerated(n) else [tuple(range(n))]


def seeds(tokens: np.ndarray, first: np.ndarray, mask: tuple[int, ...], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions from which the span of a mask fits into its row, and the hashes there."""
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, len(mask) * 131 + span, np.uint64)
    for k in mask:
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
    h = mix(h)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[span - 1 :])
    return at, h[at]


def masks_of(lengths: list[int]) -> list[tuple[tuple[int, ...], int, bool]]:
    """Mask, its span and whether it is for items of just this length, for items of these lengths."""
    plain = [(mask, mask[-1] + 1, False) for mask in MASKS if max(lengths, default=0) >= WINDOW]
    return plain + [(mask, n, True) for n in sorted(set(lengths)) if 0 < n < WINDOW for mask in whole_masks(n)]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All seeds of items: hash, item and position; and how many tokens the item has."""
    for batch in batches:
        tokens, first = tokens_of(batch.column("body"))
        lengths, uid = np.diff(first), batch.column("item").to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        for mask, span, whole in masks_of(lengths.tolist()):
            at, h = seeds(tokens, first, mask, span)
            own = lengths[row[at]]
            keep = own == span if whole else own >= WINDOW
            at, h = at[keep], h[keep]
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(uid[row[at]]), pa.array((at - first[row[at]]).astype(np.int64)), pa.array(lengths[row[at]].astype(np.int64))], names=["hash", "item", "item_at", "n_tokens"])


#: Where in a hash the three bits of the filter begin.
BLOOM_SHIFTS = (0, 19, 38)


def _filter(found: DataFrame) -> np.ndarray:
    """The Bloom filter of the seeds' hashes, as 64-bit words; its size is fixed."""
    bits = F.array(*(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for k in BLOOM_SHIFTS))
    words = found.select(F.explode(bits).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _survivors(tokens: np.ndarray, first: np.ndarray, row_of: np.ndarray, masks: list, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order and hashes of the seeds that the filter lets pass."""
    places, hashes = [], []
    for mask, span, whole in masks:
        at, h = seeds(tokens, first, mask, span)
        for k in BLOOM_SHIFTS:
            bit = h >> np.uint64(k) & np.uint64(64 * len(words) - 1)
            there = words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1
            at, h = at[there], h[there]
        if whole and not tolerated(span) and len(at):  # all tokens are equal: the first occurrence in a row will do
            pick = np.lexsort((at, h, row_of[at]))
            at, h = at[pick], h[pick]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (row_of[at[1:]] != row_of[at[:-1]])))
            at, h = at[new], h[new]
        places.append(at)
        hashes.append(h)
    at, h = np.concatenate(places), np.concatenate(hashes)
    turn = np.argsort(at, kind="stable")
    return at[turn], h[turn]


def _regions(bloom, lengths: list[int], reach: int):
    """Text around the seeds that may be the benchmark's, with their hashes and places in the document."""
    masks = masks_of(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, rows_before = bloom.value, TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            raw, offsets = utf8(batch.column("body"))
            for lo, hi in in_chunks(np.diff(offsets), CHUNK_BYTES):
                part, limits = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, first = word_spans(part, _WORD, limits, unspaced_edges(part))
                tokens = span_hashes(part, starts, ends)
                row_of = np.repeat(np.arange(hi - lo), np.diff(first))
                at, h = _survivors(tokens, first, row_of, masks, words)
                if not len(at):
                    continue
                row = row_of[at]
                low, high = np.maximum(first[row], at - reach), np.minimum(first[row + 1], at + WINDOW + reach)
                opens = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (low[1:] > high[:-1]))))
                size = np.diff(np.append(opens, len(at)))
                row, low, high = row[opens], low[opens], high[opens + size - 1]
                data = part.tobytes()
                body = [data[a:b] for a, b in zip(starts[low].tolist(), ends[high - 1].tolist(), strict=True)]
                marks = pa.ListArray.from_arrays(pa.array(np.append(opens, len(at)), pa.int32()), pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(at - np.repeat(first[row], size))], names=["hash", "at"]))
                own = [batch.column(c).take(pa.array(lo + row)) for c in ("doc_id", "id", "key")]
                yield pa.record_batch([pa.array(task + rows_before + lo + row), *own, pa.array(low - first[row]), pa.array(body, pa.binary()), marks], names=["doc", "doc_id", "id", "key", "begins", "body", "marks"])
            rows_before += batch.num_rows

    return run


def overlap(doc: np.ndarray, own: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """(tokens, equal tokens, start in document, start in item) of what qualifying runs cover on a diagonal."""
    lo, hi = max(0, -diagonal), min(len(own), len(doc) - diagonal)
    width = min(WINDOW, len(own))
    if hi - lo < width:
        return None
    equal = own[lo:hi] == doc[lo + diagonal : hi + diagonal]
    sums = np.concatenate(([0], np.cumsum(equal)))
    good = np.flatnonzero(sums[width:] - sums[:-width] >= width - tolerated(width))
    if not len(good):
        return None
    change = np.zeros(hi - lo + 1, np.int64)
    np.add.at(change, good, 1)
    np.add.at(change, good + width, -1)
    covered = np.cumsum(change[:-1]) > 0
    start = lo + int(good[0])
    return int(covered.sum()), int((covered & equal).sum()), start + diagonal, start


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best overlap of each region with an item, token by token."""

    def numbered(known: dict[bytes, int], text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, np.uint8)
        starts, ends, _ = word_spans(raw, _WORD, np.array([0, len(raw)]), unspaced_edges(raw))
        return np.array([known.setdefault(text[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            known: dict[bytes, int] = {}
            own, doc = numbered(known, r["item_body"]), numbered(known, r["body"])
            seen = [x for x in (overlap(doc, own, d - r["begins"]) for d in r["diagonals"]) if x]
            if seen:
                a, b, c, d = max((x[0], x[1], -x[2], -x[3]) for x in seen)
                rows.append((r["doc"], r["doc_id"], r["id"], r["key"], r["item"], r["item_id"], a, b, r["begins"] - c, -d))
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each document (a row of doc_id, id, key, body) and item that overlap: doc, doc_id, id, key, item_id and the largest overlap."""
    spark = docs.sparkSession
    items = settle(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary").alias("item_body"))
        .where("item_id IS NOT NULL")
        .withColumn("item", F.monotonically_increasing_id())
    )
    found = settle(items.select("item", F.col("item_body").alias("body")).mapInArrow(_item_seeds, "hash long, item long, item_at long, n_tokens long"))
    known = found.agg(F.max("n_tokens").alias("most"), F.collect_set(F.when(F.col("n_tokens") < WINDOW, F.col("n_tokens"))).alias("short")).first()
    if known["most"] is None:
        return spark.createDataFrame([], FOUND).drop("item")
    bloom = spark.sparkContext.broadcast(_filter(found))
    schema = "doc long, doc_id long, id long, key long, begins long, body binary, marks array<struct<hash:long,at:long>>"
    regions = settle_table(docs.mapInArrow(_regions(bloom, [known["most"], *known["short"]], known["most"]), schema))
    marks = regions.select("doc", "begins", F.explode("marks").alias("m")).select("doc", "begins", "m.hash", F.col("m.at").alias("at"))
    hits = marks.join(found, "hash").groupBy("doc", "begins", "item").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"))
    pairs = regions.drop("marks").join(hits, ["doc", "begins"]).join(items, "item")
    best = pairs.mapInArrow(_compared, FOUND)
    rank = F.struct("overlap_tokens", "equal_tokens", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))
    of_doc = best.groupBy("doc", "item").agg(*(F.first(c).alias(c) for c in ("doc_id", "id", "key", "item_id")), F.max(rank).alias("r"))
    return of_doc.select("doc", "doc_id", "id", "key", "item_id", "r.overlap_tokens", "r.equal_tokens", (-F.col("r.d")).alias("doc_start"), (-F.col("r.i")).alias("item_start"))


def _lowered(docs: DataFrame) -> DataFrame:
    body = F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("id"), content_key().alias("key"), body.alias("body"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the largest overlap for each document that holds a passage of an item."""
    return overlaps(_lowered(docs), benchmark).select("doc_id", "item_id", "overlap_tokens", "equal_tokens", "doc_start", "item_start")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """The rows of docs, all columns, that hold no passage of the benchmark; items of fewer than least_tokens tokens are no passages."""
    held = overlaps(_lowered(docs), benchmark).where(F.col("overlap_tokens") >= least_tokens)
    return without(docs, held.select("id", "key").distinct())
