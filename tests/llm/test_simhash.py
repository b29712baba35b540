import numpy as np
import xxhash

from millrace.llm import simhash
from millrace.llm.simhash import fingerprint, simhash_components, similar_fingerprints


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 2):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(p))]


def check(rows, got):
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    low = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted(((i, f"{p:016x}", low.get(r)) for (i, _), p, r in zip(rows, prints, roots)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_edges(spark):
    rows = [(5, "a b c d"), (3, "A b\tc  d"), (9, None), (7, ""), (8, "  \n"), (1, "one"), (2, "one two"), (None, "zz"), (5, "a b c d"), (11, "x " * 70000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, simhash_components(docs.withColumnsRenamed({}).selectExpr("*", "1 AS fingerprint", "2 AS fp")))
    assert simhash_components(docs.limit(0)).count() == 0
    assert fingerprint(b"") == 0


def test_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], simhash_components(docs))


def test_dense_buckets(spark, monkeypatch):
    """Clusters around few centres: the bit-flip comparison and the longer keys find what brute force finds."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    prints = set()
    for b in base:
        for _ in range(400):
            flips = rng.integers(0, 64, rng.integers(0, 5))
            x = b
            for k in flips:
                x ^= np.uint64(1) << np.uint64(k)
            prints.add(int(x))
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    roots = brute_components(prints)
    for small, full in ((256, 50_000), (4, 50_000), (4, 20)):
        monkeypatch.setattr(simhash, "SMALL_GROUP", small)
        monkeypatch.setattr(simhash, "FULL_BUCKET", full)
        edges = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in similar_fingerprints(df).collect()]
        at = {p: i for i, p in enumerate(prints)}
        root = list(range(len(prints)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = find(at[a]), find(at[b])
            root[max(x, y)] = min(x, y)
        assert [find(i) for i in range(len(prints))] == roots
