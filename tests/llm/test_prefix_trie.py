import hashlib
import random
import zlib

import duckdb

from millrace.llm import prefix_trie
from millrace.llm.prefix_trie import CODE, grafted, grafted_trie, merged, shared_turns, turn_sequences
from millrace.llm.queries import ORACLES


def plain_trie(rows):
    """Nodes of the trie of rebuilt conversations, from dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, built = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if built[c] == k).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids.get(k, [])), leaves[k], saved[k], digest(k)) for k, m in members.items())


def told(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


ROWS = "conv_id long, turn long, role string, text string"


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        hot = rng.random() < 0.3
        for t in range(rng.choice([0, 1, 2, 3, 9, 12])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hot" if hot else rng.choice(["a", "b", "", None, "é" * 5])))
    return rows


def test_table_equals_sql_and_plain_python(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = told(grafted_trie(df))
    sql = con.execute(ORACLES["op12_prefix_trie"])
    at = [d[0] for d in sql.description]
    assert at == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got == sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in sql.fetchall())
    assert got == plain_trie([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_many_tasks_runs_and_segments(spark, monkeypatch):
    rows = made(1, 400)
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    want = plain_trie(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert told(grafted_trie(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # small runs, segments and lists of children; the functions of tasks, as workers have their own module
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 3000)
    monkeypatch.setattr(prefix_trie, "SEGMENT", 5)
    monkeypatch.setattr(prefix_trie, "MOST_CHILDREN", 2)
    paths = grafted(turn_sequences(df)).selectExpr("conv_id", "unhex(array_join(turns, '')) AS seq").toArrow().to_batches(max_chunksize=50)
    runs = sorted((r for b in prefix_trie._runs(iter(paths)) for r in b.to_pylist()), key=lambda r: (r["segment"], r["run"]))
    assert len({r["run"] for r in runs}) > 3 and len({r["segment"] for r in runs}) > 3
    monkeypatch.setattr(prefix_trie.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    out = [r for b in prefix_trie._folded(iter([prefix_trie.pa.RecordBatch.from_pylist(runs, prefix_trie._RUN)])) for r in b.to_pylist()]
    parts = sorted((r for r in out if r["kind"] == 3), key=lambda r: (r["part"], r["side"], r["depth"]))
    out += [r for b in prefix_trie._joined(iter([prefix_trie.pa.RecordBatch.from_pylist(parts, prefix_trie._OUT)])) for r in b.to_pylist()]
    slots = {r["parent"]: r["conv_id"] for r in out if r["kind"] == 2}
    assert slots
    names = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [(r["conv_id"], r["depth"], slots[r["parent"]] if r["kind"] else -1 if r["parent"] is None else r["parent"], *(r[c] for c in names)) for r in out if r["kind"] < 2]
    assert sorted(got) == want


def test_merging_keeps_order_and_prefixes():
    rng = random.Random(2)
    code = lambda c: c.encode() * CODE
    for k in (1, 2, 3, 5, 8, 13):
        everything, runs = [], []
        for _ in range(k):
            own = sorted((b"".join(code(rng.choice("ab")) for _ in range(rng.randint(0, 5))), rng.randint(0, 9)) for _ in range(rng.randint(0, 30)))
            everything += own
            runs.append([(shared_turns(own[i - 1][0], s) if i else 0, s, c) for i, (s, c) in enumerate(own)])
        got = list(merged(runs))
        assert [(s, c) for _, s, c in got] == sorted(everything)
        assert all(got[i][0] == shared_turns(got[i - 1][1], got[i][1]) for i in range(1, len(got)))


def test_edges(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 3, "user", "x" * 200_000), (7, 1, "user", "é"), (8, 0, "", ""), (8, 1, None, ""), (-4, 0, "user", "x"), (10, 0, "user", "x"), (12, 0, "user", "x"), (12, 5, "user", "y")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS base", "2 AS depth", "array(1) AS code")
    assert told(grafted_trie(df)) == plain_trie(rows)
    assert grafted_trie(df.limit(0)).count() == 0
    assert grafted_trie(df.where("conv_id IS NULL")).count() == 0
    one = df.where("conv_id = 10")
    assert told(grafted_trie(one)) == plain_trie([r for r in rows if r[0] == 10])
