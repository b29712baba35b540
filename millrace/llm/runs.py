"""Periodic runs of words in linear time, on an alphabet of which only the order is known.

A run is a stretch of words whose smallest period fits it at least MIN_EXPONENT times, of
MIN_LENGTH words at least, that no neighbouring word extends. Every run has a Lyndon root under one of the two
orders of the alphabet: words i to j-1 such that the suffix at j is the next one smaller
than the suffix at i. So both Lyndon arrays are computed, and each of their edges (i, j) is
asked how far the text repeats at distance j - i.

The Lyndon array comes from one scan over j with a stack of suffixes that are still without a
smaller one. A comparison of suffixes i and j is never begun anew where words have been matched before:

- If i2 lies below i on the stack, the extensions of (i2, i) and (i, j) tell that of (i2, j) as the smaller of the two,
  and which suffix is smaller, unless they are equal; then it is that long at least.
- If words from j on lie in the stretch that has been matched furthest, by suffixes I and J, then
  j has a twin j - (J - I), and what was found out about the twin holds for j as far as the stretch reaches.

So matching words only ever moves the furthest end: a text of n words takes at most 3n
comparisons of words for each order, whatever it looks like. There are no suffix trees or
arrays and no hashes; words are compared as bytes.

Of a run's roots only the first is extended to the left, by fewer words than the period, and where
it is a twin, its twin's extension is reused.

Each text is one task's work; it takes some 100 bytes of memory for each word. Defined results: null text counts as empty
and has no run; words are `[^\\x20\\x09-\\x0D]+`; repeated rows are each returned, null ids too; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import in_chunks, utf8

MIN_EXPONENT = 4
MIN_LENGTH = 6
#: Bytes of text handed on at once, or one text.
CHUNK_BYTES = 1 << 22

Run = tuple[int, int, int]


def lyndon_runs(words: list[bytes], rising: bool, found: dict[tuple[int, int], int], counted: list[int] | None = None) -> None:
    """Put the runs (start, period) -> length that have a Lyndon root under one order into found.

    counted: its first item grows by the number of comparisons of words.
    """
    n = len(words)
    after, after_ext = [n] * n, [0] * n  # next smaller suffix, and how far both are equal
    before, before_ext = [-1] * n, [0] * n  # the next one below on the stack, likewise
    roots: list[tuple[int, int, int, int, int]] = []
    end = shift = box = compared = 0  # of the furthest match: its end, J - I and I
    for j in range(1, n):
        i, known, reach = j - 1, 0, 0
        word = words[j]
        while True:
            # how many words of suffixes i and j are equal, and which suffix is smaller
            if known != reach:
                smaller = known > reach  # else the suffix above had fewer words in common with i than with j
                ext = reach if smaller else known
                twin = -1
            elif j >= end and not known and (other := words[i]) != word:  # nothing matches, as mostly
                compared += 1
                smaller, ext, twin = (word < other) == rising, 0, -1
            else:
                ext, twin = known, -1
                if j < end:
                    a, b = i - shift, j - shift
                    if a >= 0 and after[a] == b:
                        ext, twin = after_ext[a], a
                    elif a >= 0 and before[b] == a:
                        ext, twin = before_ext[b], a
                    if j + ext >= end:
                        ext, twin = end - j, -1
                if twin < 0:
                    first = ext
                    while j + ext < n and words[i + ext] == words[j + ext]:
                        ext += 1
                    compared += ext - first + 1
                    if j + ext >= end:
                        end, shift, box = j + ext, j - i, i
                smaller = j + ext == n or (words[j + ext] < words[i + ext]) == rising
            if not smaller:
                before[j], before_ext[j] = i, ext
                break
            after[i], after_ext[i] = j, ext
            if ext > (MIN_EXPONENT - 2) * (j - i):
                roots.append((i, j, ext, twin, box))
            known, reach, i = before_ext[i], ext, before[i]
            if i < 0:
                break
    if counted is not None:
        counted[0] += compared
    lefts: dict[int, int] = {}
    for i, j, ext, twin, box in sorted(roots):
        p = j - i
        if i >= p and after[i - p] == i and after_ext[i - p] >= p:
            continue  # not the first root of its run
        left = lefts.get(twin, -1) if twin >= 0 else -1
        if left < 0 or twin - left <= box:
            left = 0
            while left < p and i - left > 0 and words[i - left - 1] == words[j - left - 1]:
                left += 1
        lefts[i] = left
        length = left + p + ext
        if length >= max(MIN_LENGTH, MIN_EXPONENT * p):
            found[i - left, p] = length


def runs_of(words: list[bytes]) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    if len(words) < MIN_LENGTH:
        return []
    found: dict[tuple[int, int], int] = {}
    for rising in (True, False):
        lyndon_runs(words, rising, found)
    return [(start, found[start, period], period) for start, period in sorted(found)]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    out, at = [], 0
    for lo, hi in sorted((start + period, start + length) for start, length, period in runs):
        if lo > at:
            out += words[at:lo]
        at = max(at, hi)
    return out + words[at:]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(ids, counts, runs, texts):
        shown = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(shown, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        _, offsets = utf8(batch.column("body"))
        for lo, hi in in_chunks(np.diff(offsets), CHUNK_BYTES):
            part = batch.slice(lo, hi - lo)
            counts, runs, texts = [], [], []
            for body in part.column("body"):
                words = (body.as_py() or b"").split()
                found = runs_of(words)
                counts.append(len(words))
                runs.append(found)
                texts.append(b" ".join(collapsed(words, found) if found else words))
            yield told(part.column("doc_id").to_pylist(), counts, runs, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text (words joined by one space) for each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")).mapInArrow(_found, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, compared exactly; of equal ones that with the smallest start, then period; null without a run."""
    better = lambda x, best: (x["length"] * best["period"] > best["length"] * x["period"]) | best.isNull()
    # runs come by start, then period, so that the first of equal ones stays
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    best = found.withColumn("_best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs with the text of every tenth document, by a hash of its id, made periodic from some word on; words are joined by one space there.

    With g from the hash and n words, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("_millrace_g", F.when(h % 10 == 0, g)).withColumn("_millrace_w", F.when(F.col("_millrace_g").isNotNull(), words))
    n = F.size("_millrace_w")
    a = (F.col("_millrace_g") % n).cast("int")
    p = (F.floor((n - a) / (3 + F.col("_millrace_g") % 8)) + 1).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("_millrace_w", a + 1, p), times)), F.lit(1), n - a)
    text = F.concat_ws(" ", F.slice("_millrace_w", F.lit(1), a), repeated)
    return chosen.withColumn("text", F.when(n > 0, text).otherwise(F.col("text"))).drop("_millrace_g", "_millrace_w")
