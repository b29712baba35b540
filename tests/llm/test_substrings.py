import hashlib
import random
import time

import numpy as np
import pytest

from millrace.llm import suffix_dedup, windows
from millrace.llm.fm_dedup import Bits, FmIndex, WaveletMatrix, substring_dedup
from millrace.llm.suffix_dedup import common_prefixes, smaller_than_next, two_stage_sort


def brute_words(rows, w=50):
    first = {}
    split = [(i if i is not None else 1 << 62, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for s in range(len(words) - w + 1):
            k = tuple(words[s : s + w])
            first[k] = min(i, first.get(k, i))
    out = []
    for (i, _), (rank, words) in zip(rows, split):
        gone = set()
        for s in range(len(words) - w + 1):
            if first[tuple(words[s : s + w])] < rank:
                gone |= set(range(s, s + w))
        kept = [x for k, x in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, w=200):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - w + 1):
            seen[b[s : s + w]] = seen.get(b[s : s + w], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - w + 1):
            if seen[b[s : s + w]] > 1:
                gone[s : s + w] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))[: len(b)]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS id", "3 AS body")
    assert sorted(map(tuple, substring_dedup(docs).collect()), key=str) == brute_words(rows)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect()), key=str) == brute_bytes(rows)


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(70), text(55)
    rows = [(9, text(20) + " " + passage + "\n" + text(30)), (4, text(33) + " " + passage), (7, passage + " " + text(3)), (2, None), (3, ""), (None, passage), (5, " \n"), (6, "x " * 400), (8, "x " * 230 + text(5)), (1, "ab" * 300), (10, other), (10, other), (11, other + " " + other), (12, "é" * 500), (13, text(49)), (14, "\n".join(passage.split()))]
    return rows + [(20 + k, text(5) + " " + passage + " " + text(5)) for k in range(12)]


def test_edges(spark):
    check(spark, odd_rows())
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(docs).count() == 0 and suffix_dedup.suffix_dedup(docs).count() == 0


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(windows, "CROWDED", 5)
    monkeypatch.setattr(windows, "SHARD_BYTES", 2000)
    check(spark, odd_rows())


def test_tables_equal_brute_force(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_colliding_hashes_under_crowded_anchors(spark, monkeypatch):
    """Hashes route windows; texts decide."""
    monkeypatch.setattr(windows, "CROWDED", 5)
    monkeypatch.setattr(windows, "ROUTE_BITS", 3)
    check(spark, odd_rows()[::2])


def test_very_long_texts(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60_000))
    rows = [(1, text), (2, "x y " + text[100_000:130_000]), (3, "a" * 300_000), (5, "x " * 80_000), (6, "y " + "x " * 80_000), (4, text[::-1] + "b " * 40_000)]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(4))
def test_two_stage_sort_sorts(seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED_AT_ONCE", 150 if seed > 1 else 400_000)
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(1, 4 if seed % 2 else 60, 3000), 0).astype(np.uint8)
    text[500:800] = 2
    text[[900, 950, 951]] = 0
    text[1000:1400] = text[2000:2400]
    n = len(text)
    whole = [text[i:].tobytes() for i in range(n)]
    assert smaller_than_next(text).tolist() == [whole[i] < whole[i + 1] if i + 1 < n else True for i in range(n)]
    order = two_stage_sort(text, 1024)
    assert order.tolist() == sorted(range(n), key=lambda i: whole[i])
    a = np.sort(order[1:])
    after = dict(zip(order[1:].tolist(), order[:-1].tolist()))
    b = np.array([after[i] for i in a.tolist()])

    def shared(i, j):
        k = 0
        while k < 200 and i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        return k

    assert [g for g, i, j in zip(common_prefixes(text, a, b, 200).tolist(), a, b) if max(i, j) + 200 < n] == [shared(i, j) for i, j in zip(a, b) if max(i, j) + 200 < n]


def test_runs_of_one_byte_take_linear_time():
    for text in (np.full(1 << 20, 7), np.tile([7] * 1000 + [9], 1000), np.tile([9] * 1000 + [7], 1000)):
        began = time.perf_counter()
        order = two_stage_sort(np.append(text, 0).astype(np.uint8), 200)
        assert time.perf_counter() - began < 10 and len(set(order.tolist())) == len(text) + 1
    assert two_stage_sort(np.append(np.full(1000, 7), 0).astype(np.uint8), 200).tolist() == list(range(1000, -1, -1))


def test_wavelet_matrix_and_backward_search():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 37, 5000)
    tree = WaveletMatrix(values, 37)
    symbol, at = rng.integers(0, 37, 300), rng.integers(0, 5001, 300)
    assert tree.rank(symbol, at).tolist() == [int((values[:a] == s).sum()) for s, a in zip(symbol, at)]
    low = rng.integers(0, 4999, 300)
    high = low + 1 + rng.integers(0, 40, 300) % (5000 - low)
    assert tree.least(low, high).tolist() == [int(values[a:b].min()) for a, b in zip(low, high)]
    flags = rng.random(1000) < 0.1
    bits = Bits(flags)
    assert bits.select(np.arange(flags.sum())).tolist() == np.flatnonzero(flags).tolist()
    pieces = [rng.integers(1, 4, n) for n in (40, 7, 900, 1, 33)]
    owners = np.array([5, 3, 9, 1, 4])
    index = FmIndex(pieces, owners, 3, 6)
    queries = [*pieces[::-1], rng.integers(1, 4, 700), np.array([1, 2])]
    holds = {}
    for p, o in zip(pieces, owners):
        for s in range(len(p) - 5):
            k = tuple(p[s : s + 6])
            holds[k] = min(int(o), holds.get(k, 99))
    for q, got in zip(queries, index.statistics(queries)):
        want = [holds.get(tuple(q[s : s + 6]), -1) if s + 6 <= len(q) else -1 for s in range(len(q))]
        assert got.tolist() == want
