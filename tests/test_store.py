import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import load as o
from millrace.operators.resolve import MatchRule
from millrace.operators.store import History, MatchIndex, Store, upsert_into

ENTITY = "id long, name string, balance double, confidence double, version int, duplicate_count long"
FIELDS = ["name", "balance"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_small_load_touches_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path), "id", buckets=50)
    old = spark.range(1000).selectExpr("id", "concat('n', id) AS name", "cast(id AS double) AS balance", "0.5D AS confidence", "1 AS version", "0L AS duplicate_count")
    store.write(old)
    before = {f: os.stat(f).st_mtime_ns for f in files(tmp_path)}
    new = spark.createDataFrame([(3, "x", None, 0.9), (7, None, 1.0, 0.2), (2000, "new", 5.0, 0.7)], "id long, name string, balance double, confidence double")
    assert len(store.touched(new)) <= 3
    read = store.read(store.touched(new))
    assert read.count() < 100
    want = rows(o.upsert(old, new, "id", FIELDS, "newer_wins"))
    n = upsert_into(store, new, FIELDS, "newer_wins")
    assert rows(store.read()) == want
    assert {f: os.stat(f).st_mtime_ns for f in before} == before  # nothing written is changed
    assert len({f.split("bucket=")[1].split("/")[0] for f in files(tmp_path) - set(before)}) <= 3
    # a load without Spark's marker doesn't count
    os.remove(tmp_path / f"load={n}" / "_SUCCESS")
    assert rows(store.read()) == rows(old)
    assert rows(store.read([store.touched(old.where("id = 5"))[0]]).where("id = 5")) == rows(old.where("id = 5"))


def test_loads_into_an_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path), "id", buckets=4)
    assert store.read() is None
    new = spark.createDataFrame([(1, "a", 1.0, 0.9), (2, None, None, None)], "id long, name string, balance double, confidence double")
    for _ in range(2):
        upsert_into(store, new, FIELDS, "newer_wins")
    assert rows(store.read()) == [(1, "a", 1.0, 0.9, 1, 0), (2, None, None, None, 1, 0)]
    upsert_into(store, new.limit(0), FIELDS, "newer_wins")
    assert store.read().count() == 2


def names(rng, n):
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([8, 12, 15]))) for _ in range(n)]
    out = []
    for x in plain:
        at, kind = rng.randrange(len(x)), rng.random()
        out.append(x if kind < 0.2 else x[:at] + "z" + x[at + 1 :] if kind < 0.6 else x[:at] + x[at + 1 :] if kind < 0.8 else "".join(rng.sample(x, len(x))))
    return plain, out


def test_index_equals_matching_against_all(spark, tmp_path):
    rng = random.Random(3)
    plain, changed = names(rng, 120)
    old = spark.createDataFrame([(i, x) for i, x in enumerate(plain)] + [(500, None), (501, "")], "id long, name string")
    new = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(changed)] + [(3000, None), (3001, ""), (3002, "ab")], "id long, name string")
    rules = [MatchRule("name", "levenshtein", 1.0, preprocess=["lowercase"], blocking=True)]
    index = MatchIndex(spark, str(tmp_path), "id", ["name"], rules, 0.85, buckets=6)
    assert {r.action for r in index.classify(new).collect()} == {"new"}
    for part in range(3):
        index.add(old.where(F.col("id") % 3 == part))
    got = rows(index.classify(new))
    assert got == rows(o.classify(new, old, "id", ["name"], rules))
    assert {r[2] for r in got} == {"new", "update", "duplicate"}
    with pytest.raises(ValueError, match="edit distance"):
        MatchIndex(spark, str(tmp_path), "id", ["name"], [MatchRule("name", "soundex", blocking=True)], 0.85)


def test_uniqueness_over_loads(spark, tmp_path):
    rng = random.Random(5)
    history = History(spark, str(tmp_path), bits=1 << 17, buckets=5)
    seen, order = set(), 0
    for load in range(3):
        batch = []
        for _ in range(300):
            batch.append((order, rng.choice([None, *range(400)]), rng.choice(["x", "y", None])))
            order += 1
        df = spark.createDataFrame(batch, "n long, a long, b string").repartition(3)
        want, own = {}, set()
        for n, a, b in batch:
            want[n] = a is None or b is None or ((a, b) not in seen and (a, b) not in own)
            own.add((a, b))
        assert {r.n: r.is_unique for r in history.check(df, ["a", "b"], "n").collect()} == want
        known = {(a, b) for _, a, b in batch if a is not None and b is not None} & seen
        asked = history.asked(df, ["a", "b"]).count()
        assert len(known) <= asked <= len(known) + 10  # few are looked up in vain
        assert history.known(df, ["a", "b"]).count() == len(known)
        history.add(df, ["a", "b"])
        seen |= {(a, b) for a, b in own if a is not None and b is not None}
    none = spark.createDataFrame([], "n long, a long, b string")
    assert history.check(none, ["a", "b"], "n").count() == 0
