import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from millrace.llm.runs import collapsed, lyndon_runs, periodic_runs, run_digests, runs_of, with_repeats


def plain_runs(w):
    """Every stretch in which words p apart are equal, for each p, unless a smaller period fits it."""
    runs = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            e = i + p
            if e - s >= max(6, 4 * p) and not any(w[s : e - q] == w[s + q : e] for q in range(1, p)):
                runs.append((s, e - s, p))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        letters, n, w = b"abcd"[: rng.choice([1, 2, 2, 3, 4])], rng.randint(0, 80), []
        while len(w) < n:
            w += [bytes([rng.choice(letters)]) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 3, 5, 7])
            if rng.random() < 0.3:
                w *= rng.randint(1, 5)
        yield w[:200]


def test_runs_equal_brute_force():
    for w in texts(3, 3000):
        assert runs_of(w) == plain_runs(w)


def nested(levels):
    s = "a"
    for i in range(levels):
        s = s * 4 + "ab"[i % 2] + s[: len(s) // 2]
    return s


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b


@pytest.mark.parametrize("s", ["a" * 30000, "ab" * 15000, "a" * 10000 + "b" + "a" * 10000, nested(7), fibonacci(30000), "".join("a" * i + "b" for i in range(250))])
def test_comparisons_are_linear(s):
    w = [c.encode() for c in s]
    for rising in (True, False):
        counted = [0]
        lyndon_runs(w, rising, {}, counted)
        assert counted[0] <= 3 * len(w)


def test_what_is_left_of_runs():
    w = b"x a b a b a b a b y y y y y y z".split()
    runs = runs_of(w)
    assert runs == [(1, 8, 2), (9, 6, 1)]
    assert collapsed(w, runs) == b"x a b y z".split()
    # runs that overlap
    for w in texts(5, 300):
        gone = {i for s, n, p in runs_of(w) for i in range(s + p, s + n)}
        assert collapsed(w, runs_of(w)) == [x for i, x in enumerate(w) if i not in gone]


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and w and doc_id is not None:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join("%d,%d,%d\n" % r for r in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(lines), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(plain_row(r.doc_id, r.text) for r in docs.collect())
    got = sorted(tuple(r) for r in run_digests(periodic_runs(with_repeats(docs))).collect())
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10


def test_edges(spark):
    chosen = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    long = " ".join(f"w{i % 7}" for i in range(50_000))
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (2, ""), (3, " \t\n\x0b\f\r "), (4, "A A A ü ü ü ü ü ü"), (-5, "a a a a a a"), (chosen[0], ""), (chosen[1], None), (chosen[2], long), (6, "no run here at all")]
    rows += [(i, "one two three four five six seven eight nine ten eleven twelve"[: 5 + i % 50]) for i in chosen[3:]]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "'x' AS _best", "array(1) AS collapsed")
    got = run_digests(periodic_runs(with_repeats(odd))).collect()
    by = {(r.doc_id, r.n_runs, r.collapsed_sha256) for r in got}
    assert len(got) == len(rows)
    for r in rows:
        if r[1] is not long:
            want = plain_row(*r)
            assert (want[0], want[1], want[7]) in by
    whole = periodic_runs(odd.where(f"doc_id = {chosen[2]}")).first()
    assert whole.n_words == 50_000 and [tuple(x) for x in whole.runs] == [(0, 50_000, 7)] and whole.collapsed == "w0 w1 w2 w3 w4 w5 w6"
    assert periodic_runs(odd.limit(0)).count() == 0
