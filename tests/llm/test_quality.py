import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.arrow import utf8
from millrace.llm.quality import BINS, BITS, COST, GOOD, LONGEST, calibrated, coordinate_descent, features, fit, indicators, log_count_ratios, predict, score_quality, train
from millrace.llm.words import mix


def plain_symbols(text):
    """The symbols of a text in plain Python."""
    out, before, word, words = [], None, bytearray(), []
    raw = (text or "").encode()
    kinds = []
    at = 0
    for piece in raw.split():
        at = raw.index(piece, at)
        words.append((at, at + len(piece), piece))
        at += len(piece)
    again = set()
    for (_, _, x), (lo, hi, y) in zip(words, words[1:]):
        if x == y:
            again.update(range(lo, hi))
    for i, b in enumerate(raw):
        c = chr(b)
        kinds.append(7 if i in again else 1 if b >= 128 or "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c in " \t\r\x0b\x0c" else 5 if c == "\n" else 6 if b < 33 else b)
    for i, k in enumerate(kinds):
        alike = next((n for n in range(i) if kinds[i - n - 1] != k), i)  # equal ones just before
        if alike == 0 or k > 8 and alike == 1:
            out.append(k)
    return out


def plain_bins(text):
    sym, bins = plain_symbols(text), set()
    for at in range(len(sym)):
        code = 0
        for k in range(min(LONGEST, len(sym) - at)):
            code = (code * 131 + sym[at + k] + k + 1) % (1 << 64)
            bins.add(int(mix(np.array([code], np.uint64))[0] >> np.uint64(64 - BITS)))
    return bins


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_indicators_equal_plain_python(spark, sf_dir):
    rows = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    rows += ["", None, "a", "a a a", "a a\na  a b", "!!!! !! !", "\x01\x02x\t\r\n\n", "É é é", "a a", "12 345 345"]
    arrow = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string").orderBy("i").select(F.col("text").cast("binary").alias("body")).toArrow()
    bins, at = indicators(*utf8(arrow.column("body")))
    assert [set(bins[a:b].tolist()) for a, b in zip(at[:-1], at[1:])] == [plain_bins(t) for t in rows]
    assert all(len(set(bins[a:b].tolist())) == b - a for a, b in zip(at[:-1], at[1:]))


def test_held_out_accuracy(tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= GOOD) for r in got)


def test_only_texts_of_learned_rows_matter(tables):
    docs, labels = tables
    want = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y"))
    got = {r.doc_id: r.score for r in score_quality(other, turned).collect()}
    assert got == want


def test_coordinate_descent_reaches_the_optimum():
    """Primal and dual objective meet: the hinge-loss model is the best one."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 12)) for _ in range(150)]
    y = np.array([1.0 if (3 in r) ^ (rng.random() < 0.1) else -1.0 for r in rows])
    values = [rng.normal(size=len(r)) for r in rows]
    values = [v / np.linalg.norm(v) for v in values]
    w = coordinate_descent(rows, values, y)
    margins = np.array([v @ w[r] + w[BINS] for r, v in zip(rows, values)])
    primal = 0.5 * w @ w + COST * np.maximum(0, 1 - y * margins).sum()
    # against plain subgradient steps
    u = np.zeros(BINS + 1)
    best = np.inf
    for step in range(1, 4001):
        m = np.array([v @ u[r] + u[BINS] for r, v in zip(rows, values)])
        best = min(best, 0.5 * u @ u + COST * np.maximum(0, 1 - y * m).sum())
        grad = u.copy()
        for i in np.flatnonzero(y * m < 1):
            grad[rows[i]] -= COST * y[i] * values[i]
            grad[BINS] -= COST * y[i]
        u -= grad / (step + 20)
    assert primal <= best * 1.01


def test_scores_are_probabilities():
    rng = np.random.default_rng(1)
    margins = rng.normal(size=4000)
    y = np.where(rng.random(4000) < 1 / (1 + np.exp(-(2 * margins + 0.5))), 1.0, -1.0)
    slope, offset = calibrated(margins, y)
    assert abs(slope - 2) < 0.2 and abs(offset - 0.5) < 0.15


def test_ratios():
    r = log_count_ratios(np.array([[3.0, 0.0], [0.0, 1.0]]))
    assert np.allclose(r, [np.log((1 / 3) / (4 / 5)), np.log((2 / 3) / (1 / 5))])


def test_edges(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "fine words here"), (5, "!!! " * 100_000)], "doc_id long, text string").selectExpr("*", "1 AS pick", "2 AS bins", "3 AS quality")
    got = score_quality(odd, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    model = train(features(docs), labels)
    seen = {r.doc_id: r.score for r in predict(features(odd), model).collect()}
    assert seen[5] < GOOD < seen[None] and seen[1] == seen[2]
    assert score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    bad = labels.selectExpr("doc_id", "cast(null AS int) AS quality").unionByName(labels.selectExpr("doc_id", "7 AS quality"))
    assert {r.score for r in score_quality(docs, bad).collect()} == {0.5}
    contradicting = labels.select("doc_id", "quality").unionByName(labels.selectExpr("doc_id", "1 - quality AS quality"))
    assert {r.score for r in score_quality(docs, contradicting).collect()} == {0.5}
    ones = score_quality(docs, labels.selectExpr("doc_id", "1 AS quality")).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.9
    twice = {r.doc_id: r.score for r in score_quality(docs, labels.unionByName(labels)).collect()}
    assert twice == {r.doc_id: r.score for r in score_quality(docs, labels).collect()}


def test_the_sample_is_bounded(tables):
    docs, labels = tables
    assert train(features(docs), labels, most=60).slope > 0
    one = fit(np.ones((2, BINS)), [np.array([1, 2])], np.array([1]))
    assert one.scores(one.margins(np.array([1]), np.array([0, 1])))[0] == pytest.approx(2 / 3)
