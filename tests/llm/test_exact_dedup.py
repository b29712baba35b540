import hashlib
import random
import re

import pyarrow as pa

from millrace.llm import exact_dedup as exact
from millrace.llm.exact_dedup import CuckooIndex, exact_dedup


def test_cuckoo_index_follows_a_set():
    rng = random.Random(1)
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    index, live = CuckooIndex(2), set()
    for _ in range(20000):
        k = rng.choice(keys)
        assert (index.find(k) is not None) == (k in live)
        if k in live and rng.random() < 0.4:
            assert index.remove(k)
            live.discard(k)
        elif k not in live:
            index.add(k)
            live.add(k)
    assert index.live == len(live)
    assert not index.remove("0" * 64)
    assert {e[0] for e in index.entries if e} == live


def test_a_full_index_hands_on_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(exact, "LIVE_KEYS", 50)
    rng = random.Random(4)
    rows = [(hashlib.sha256(str(rng.randint(0, 400)).encode()).hexdigest(), rng.randint(0, 3), rng.randint(0, 9), k) for k in range(3000)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[a : a + 20])], names=["sha", "n_points", "doc_id", "uid"]) for a in range(0, 3000, 20)]
    parts = sorted((r for b in exact._partial(iter(batches)) for r in b.to_pylist()), key=lambda r: r["sha"][:2])
    done = [r for b in exact._merged(iter([pa.RecordBatch.from_pylist(parts)])) for r in b.to_pylist()]
    want = {}
    for sha, *candidate in rows:
        want.setdefault(sha, []).append(candidate)
    assert {r["sha"]: (r["keep_uid"], r["members"]) for r in done} == {sha: (min(c, key=lambda x: (-x[0], x[1], x[2]))[2], len(c)) for sha, c in want.items()}
    assert len(done) == len(want) and len(parts) > 2 * len(want)


def test_groups(spark):
    rows = [(4, "a b"), (2, "ab"), (1, "a\tb"), (9, None), (8, ""), (7, " \n"), (3, "x" * 100000), (3, "x" * 100000), (6, "a\u00a0b"), (None, "q"), (5, "q")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, sha string")
    got = exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    want = {}
    for i, t in rows:
        want.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest(), []).append((i, t or ""))
    assert set(by) == set(want)
    for sha, members in want.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        assert {(r.keep_id, r.group_size) for r in by[sha]} == {(keep[0], len(members))}
        assert [r.kept for r in by[sha]].count(True) == 1
        assert next(r.doc_id for r in by[sha] if r.kept) == keep[0]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_of_rows_alike_in_id_and_text_the_first_stays(spark):
    from millrace.llm.exact_dedup import keep_best

    rows = [(1, "a b", "z", None), (1, "a b", "x", 2), (1, "a b", "y", 1), (2, "ab", "a", 0), (None, "c", "q", 1), (None, "c", "p", 1)]
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(parts, "source")
        assert sorted(((r.doc_id or 0), r.source, r.n) for r in keep_best(docs).collect()) == [(0, "p", 1), (1, "x", 2)]
