"""A quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators. The symbols of the n-grams are what quality shows in
whatever the language: small letters, capitals, digits and spaces each stand as one symbol
for a stretch of their kind, signs stand for themselves (two at most of a stretch), and a word that repeats the one
before it is a single symbol. N-grams of 1 to LONGEST symbols are hashed to BINS bins.

Each indicator is scaled by the log-ratio of its smoothed counts in the two classes, counted
over all labelled documents; the scaled vectors have length 1. A linear hinge-loss model is
fitted to them by dual coordinate descent, on at most about MOST_TRAINING labelled documents
chosen by a hash of id and text (the bound doesn't change with the table). Margins become
probabilities by a logistic curve fitted to margins of documents that their model hasn't seen: folds of
the sample, each scored by a model of the other four.

Bins of every document are written once to the shared folder; counts, sample and scores read
them there. Only the sample and BINS counts for each class reach the driver.

Defined results: null text counts as empty, and a text without a symbol has the score of the
bias alone; without a labelled row all scores are 0.5, with one class only its smoothed share. Labels
that contradict each other, are null or neither 0 nor 1, and labels of null ids are not learned from;
repeated labels count once. Repeated rows are each returned (and each learned from); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import in_chunks, utf8
from millrace.llm.words import mix, span_hashes, word_spans
from millrace.session import settle_table

LONGEST = 6
BITS = 18
BINS = 1 << BITS
SMOOTHING = 1.0
MOST_TRAINING = 10_000
#: Upper bound of a dual variable: what a document can weigh.
COST = 1.0
EPOCHS = 20
ENOUGH = 1e-3
#: A fold of the sample gets its margins from a model of the others; folds are taken until there are so many margins.
FOLDS = 5
ENOUGH_MARGINS = 2_000
CHUNK_BYTES = 1 << 19
GOOD = 0.3

_SMALL, _CAPITAL, _DIGIT, _SPACE, _LINE, _CONTROL, _AGAIN, _EDGE = range(1, 9)
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[:33] = _CONTROL
_SYMBOL[[9, 11, 12, 13, 32]] = _SPACE
_SYMBOL[10] = _LINE
_SYMBOL[128:] = _SYMBOL[ord("a") : ord("z") + 1] = _SMALL
_SYMBOL[ord("A") : ord("Z") + 1] = _CAPITAL
_SYMBOL[ord("0") : ord("9") + 1] = _DIGIT
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all rows, and the index of the first one of each row (and of the end)."""
    out = _SYMBOL[raw]
    starts, ends, first = word_spans(raw, _WORD, offsets)
    if len(starts) > 1:
        h = span_hashes(raw, starts, ends)
        again = h[1:] == h[:-1]
        inner = first[(first > 0) & (first < len(starts))]
        again[inner - 1] = False  # the first word of a row repeats none
        at = np.flatnonzero(again) + 1
        depth = np.zeros(len(raw) + 1, np.int8)
        depth[starts[at]] += 1
        depth[ends[at]] -= 1
        out[np.cumsum(depth[:-1], dtype=np.int8) > 0] = _AGAIN
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    same = np.zeros(len(raw), bool)
    same[1:] = out[1:] == out[:-1]
    same[edges] = False
    keep = ~same
    keep[1:] |= (out[1:] > _EDGE) & ~same[:-1]
    return out[keep], np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))[offsets]


def indicators(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of each row, one row after the other, and the offsets of the rows."""
    sym, at = symbols(raw, offsets)
    n = len(at) - 1
    padded = np.concatenate((sym, np.zeros(LONGEST, np.uint8))).astype(np.uint64)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(sym))  # symbols of the row from here on
    code, grams = np.zeros(len(sym), np.uint64), np.empty((len(sym), LONGEST), np.int32)
    for k in range(LONGEST):
        code = code * np.uint64(131) + padded[k : k + len(sym)] + np.uint64(k + 1)
        grams[:, k] = np.where(left > k, (mix(code) >> np.uint64(64 - BITS)).astype(np.int32), -1)
    found, seen = [], np.full(BINS + 1, -1, np.int32)
    for i in range(n):
        own = grams[at[i] : at[i + 1]].ravel()
        place = np.arange(len(own), dtype=np.int32)
        seen[own] = place  # the last place of each bin
        own = own[seen[own] == place]
        found.append(own[own >= 0])
    sizes = np.fromiter(map(len, found), np.int64, n)
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column("body"))
        for a, b in in_chunks(np.diff(offsets), CHUNK_BYTES):
            bins, at = indicators(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bins, pa.int32()))
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("pick").slice(a, b - a), lists], names=["doc_id", "pick", "bins"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, bins and a hash `pick` for sampling, for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("pick"), F.col("text").cast("binary").alias("body"))
    return rows.mapInArrow(_features, "doc_id long, pick long, bins array<int>")


def held_out() -> F.Column:
    """Documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BINS), np.int64)
    for batch in batches:
        bins, at = _flat(batch.column("bins"))
        good = np.repeat(batch.column("quality").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at))
        counts += np.bincount(good * BINS + bins, minlength=2 * BINS).reshape(2, BINS)
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["bin", "bad", "good"])


def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    """For counts of (bad, good) by bin: the log of the ratio of the smoothed shares, good above."""
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights by bin, and the bias last, of the linear model with the least hinge loss and length.

    Each step sets one document's dual variable to its best value between 0 and cost, and moves
    the weights accordingly; an epoch takes the documents in random order.
    """
    w, alpha, rng = np.zeros(BINS + 1), np.zeros(len(rows)), np.random.default_rng(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    for _ in range(EPOCHS):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gap = y[i] * (values[i] @ w[rows[i]] + w[BINS]) - 1.0
            new = min(max(alpha[i] - gap / norm[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * y[i] * values[i]
                w[BINS] += step * y[i]
                largest = max(largest, abs(step))
        if largest < ENOUGH:
            break
    return w


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve with the greatest likelihood, the classes' targets drawn in from 0 and 1; the slope isn't negative."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, np.log((good + 1) / (bad + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margins, g.sum()])
        hess = np.array([[h @ margins**2 + 1e-6, h @ margins], [h @ margins, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


@dataclass
class Model:
    """ratio by bin; weights by bin, bias last; slope and offset of the curve that makes a margin a score."""

    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margins(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = self.ratio[bins]
        sums = lambda v: np.diff(np.concatenate((np.zeros(1), np.cumsum(v)))[at])
        length = np.sqrt(np.maximum(sums(r * r), 1e-12))
        return sums(r * self.weights[bins]) / length + self.weights[BINS]

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))


def fit(counts: np.ndarray, rows: list[np.ndarray], quality: np.ndarray) -> Model:
    """counts: (bad, good) by bin of all labelled documents; rows and quality: the sample's bins and labels."""
    ratio = log_count_ratios(counts)
    y = np.where(quality > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(ratio, np.zeros(BINS + 1), 0.0, float(np.log(share / (1 - share))))
    values = [ratio[x] / max(np.linalg.norm(ratio[x]), 1e-6) for x in rows]
    fold, unseen, margins = np.arange(len(rows)) % FOLDS, [], []
    for k in range(FOLDS):
        seen, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[seen].tolist())) == 2 and sum(map(len, unseen)) < ENOUGH_MARGINS:
            w = coordinate_descent([rows[i] for i in seen], [values[i] for i in seen], y[seen])
            unseen.append(own)
            margins.append(np.array([values[i] @ w[rows[i]] + w[BINS] for i in own]))
    slope, offset = calibrated(np.concatenate(margins), y[np.concatenate(unseen)]) if unseen else (1.0, 0.0)
    return Model(ratio, coordinate_descent(rows, values, y), slope, offset)


def train(filed: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Model | None:
    """Fit on filed (doc_id, pick, bins) and labels (doc_id, quality); None without a label."""
    told = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("_other")).where("quality = _other")
    known = settle_table(filed.where(~held_out()).join(told.where(~held_out()).select("doc_id", "quality"), "doc_id").select("pick", "quality", "bins"))
    total = known.count()
    if not total:
        return None
    found = known.select("quality", "bins").mapInArrow(_count, "bin int, bad long, good long").groupBy("bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    counts = np.zeros((2, BINS))
    counts[:, found.column("bin").to_numpy()] = [found.column(c).to_numpy() for c in ("bad", "good")]
    some = known if total <= most else known.where(F.shiftrightunsigned("pick", 2) < F.lit(min(1 << 62, (most << 62) // total)))
    sample = some.orderBy("pick").select("quality", "bins").toArrow()
    bins, at = _flat(sample.column("bins").combine_chunks())
    return fit(counts, [bins[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], sample.column("quality").to_numpy())


def predict(filed: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, margin and score (0 to 1) for each row of filed."""
    if model is None:
        return filed.select("doc_id", F.lit(0.0).alias("margin"), F.lit(0.5).alias("score"))
    shared = filed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = shared.value.margins(*_flat(batch.column("bins")))
            yield pa.record_batch([batch.column("doc_id"), pa.array(margins), pa.array(shared.value.scores(margins))], names=["doc_id", "margin", "score"])

    return filed.select("doc_id", "bins").mapInArrow(run, "doc_id long, margin double, score double")


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from GOOD on) and margin for each row of docs."""
    filed = settle_table(features(docs))
    return predict(filed, train(filed, labels, most)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), "margin")
