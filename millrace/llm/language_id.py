"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1; each bit has a binary classifier over byte
trigrams that tells the languages whose bit is +1 from the others. Its weights are
log-odds of the trigram under the two sides (each side the mean of its languages, so
that a common language doesn't outvote a rare one); a text's margin is their mean over its
trigrams. Decoding is loss-weighted: bits that separate their sides well count for more,
and the codeword with the least weighted logistic loss is chosen. A text whose two nearest
codewords lie closer than AMBIGUOUS is flagged.

Training counts trigrams in the tasks; what reaches the driver is one table of BINS counts
for each of MOST_LANGS languages at the utmost (of more labels the most frequent are learned). About MOST_TRAINING documents
are used, chosen by a hash of id and text, and the bound doesn't change with the table.

Defined results: `und` with score 0 for null text and for text without a letter, and for
everything if there is no labelled row; of equally near codewords that of the first language by name wins; a language is learned from non-null labels only;
repeated rows are each returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import in_chunks, utf8

BINS = 1 << 14
SMOOTHING = 0.5
MOST_TRAINING = 20_000
MOST_LANGS = 500
#: Difference between the two least losses below which a text is ambiguous.
AMBIGUOUS = 0.03
SHARPNESS = 10.0
CHUNK_BYTES = 1 << 19
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams of folded bytes within each row, and the row of each; runs of non-letters give none."""
    b = _FOLD[raw].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.flatnonzero((row[2:] == row[:-2]) & (b[1:-1] != 32))
    code = (b[keep] << 16) | (b[keep + 1] << 8) | b[keep + 2]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64), row[keep]


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: all splits while these are few, else the best of random codes."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 6:
        return np.array([(1, *bits) for bits in itertools.product((1, -1), repeat=n - 1) if -1 in bits], float).T
    rng = np.random.default_rng(n)
    width = 10 * math.ceil(math.log2(n))
    tries = []
    for _ in range(200):
        code = rng.choice([1.0, -1.0], (n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        tries.append((min(gaps), len(tries), code))
    return max(tries)[2]


class Ecoc:
    """The binary classifiers and the decoder."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BINS)
        plus, minus = self.code > 0, self.code < 0
        mean = lambda side: (side.T @ share) / np.maximum(1, side.sum(axis=0))[:, None]
        weights = np.log(mean(plus.astype(float))) - np.log(mean(minus.astype(float))) if len(langs) > 1 else np.ones((1, BINS))
        margins = share @ weights.T  # expected margin of each language under each bit
        self.weights = (weights / np.abs(margins).mean(axis=0)[:, None]).T.astype(np.float32)
        apart = np.clip((margins * self.code).min(axis=0), 0.02 * np.abs(margins).mean(axis=0), None)
        self.trust = apart / apart.sum()

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bins, row = trigrams(raw, offsets)
        n = len(offsets) - 1
        out = np.zeros((n, self.weights.shape[1]))
        if len(bins):
            w = self.weights[bins]
            begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            sums = np.add.reduceat(w, begin, axis=0, dtype=np.float64)
            out[row[begin]] = sums / np.diff(np.append(begin, len(row)))[:, None]
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each text against each codeword: a bit's loss if it is +1, or else if it is -1."""
        plus, minus = (np.log1p(np.exp(-2 * sign * margins)) * self.trust for sign in (1, -1))
        return plus @ (self.code.T > 0) + minus @ (self.code.T < 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        raw, offsets = utf8(batch.column("body"))
        for i, lang in enumerate(langs):
            bins, _ = trigrams(raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
            counts.setdefault(lang, np.zeros(BINS, np.int64))
            counts[lang] += np.bincount(bins, minlength=BINS)
    for lang, n in counts.items():
        bins = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(n[bins], pa.int64())], names=["lang", "bin", "n"])


def sampled_below(most: int, total: int) -> int:
    """Of 2^62 equally likely numbers, as many as give `most` of `total` rows; no table is too large for it."""
    return min(1 << 62, (most << 62) // total)


def train(labelled: DataFrame, most: int = MOST_TRAINING) -> Ecoc | None:
    """Fit on text and lang of at most about `most` rows of labelled (doc_id, text, lang); None without labels."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    total = rows.count()
    if total > most:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) < F.lit(sampled_below(most, total)))
    often = rows.groupBy(F.col("lang").cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS + 1).collect()
    if len(often) > MOST_LANGS:
        rows = rows.where(F.col("lang").cast("string").isin([r.lang for r in often[:MOST_LANGS]]))
    found = (
        rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("body"))
        .mapInArrow(_count, "lang string, bin int, n long")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    if not found.num_rows:
        return None
    lang, bins, n = (found.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "bin", "n"))
    langs = sorted(set(lang.tolist()))
    counts = np.zeros((len(langs), BINS))
    counts[np.searchsorted(np.array(langs, object), lang), bins] = n
    return Ecoc(langs, counts)


def has_letter() -> F.Column:
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Ecoc | None) -> DataFrame:
    """All columns of docs with lang_pred, score (0 to 1) and ambiguous."""
    marked = docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0)).withColumn("ambiguous", F.lit(True))
    if model is None:
        return marked
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            names = batch.schema.names
            raw, offsets = utf8(batch.column(body))
            letters = batch.column("_millrace_letters").to_numpy(zero_copy_only=False).astype(bool)
            margins = [model.margins(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in in_chunks(np.diff(offsets), CHUNK_BYTES)]
            loss = model.losses(np.concatenate(margins)) if n else np.zeros((0, len(model.langs)))
            best = loss.argmin(axis=1)
            odds = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
            near = np.sort(loss, axis=1)
            doubt = near[:, 1] - near[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(n, bool)
            langs = [model.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
            score = np.where(letters, 1 / odds.sum(axis=1), 0.0)
            kept = [batch.column(i) for i, c in enumerate(names) if not c.startswith("_millrace_")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(score), pa.array(doubt | ~letters)], names=[c for c in names if not c.startswith("_millrace_")] + ["lang_pred", "score", "ambiguous"])

    own = docs.drop("lang_pred", "score", "ambiguous")
    # a string reaches the worker in UTF-8 already, so that the text goes there once
    body = "text" if ("text", "string") in own.dtypes else "_millrace_body"
    schema = own.limit(0).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("ambiguous", F.lit(True)).schema
    sent = own if body == "text" else own.withColumn(body, F.col("text").cast("binary"))
    return sent.withColumn("_millrace_letters", has_letter()).mapInArrow(run, schema)


def held_out() -> F.Column:
    """Documents that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for each row, learned from the rows not held out."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language is determined; learned from the rows not held out.

    Ambiguous texts stay: they are short or in several languages. Without a labelled row all that have a letter stay.
    """
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(has_letter())
    marks = ("lang_pred", "score", "ambiguous")
    own = [c for c in docs.columns if c in marks]
    renamed = docs.withColumnsRenamed({c: f"own_{c}" for c in own})
    kept = predict(renamed, model).where(f"lang_pred <> '{UNDETERMINED}'").drop(*marks)
    return kept.withColumnsRenamed({f"own_{c}": c for c in own}).select(*docs.columns)
