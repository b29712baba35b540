import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import load as o
from millrace.operators import resolve as r
from millrace.operators.components import connected_components
from millrace.operators.resolve import MatchRule
from millrace.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(n, seed, letters="abc", sizes=(1, 14)):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(n)})


@pytest.mark.parametrize("t", [0.6, 0.75, 0.85, 0.9])
@pytest.mark.parametrize("frequent", [2000, 3])
def test_no_similar_pair_is_lost(spark, monkeypatch, t, frequent):
    """Segments, and longer keys where segments are frequent, find what comparing all finds."""
    monkeypatch.setattr(r, "FREQUENT", frequent)
    values = words(150, 1) + words(60, 2, "ab", (8, 12)) + ["prefix" + w for w in words(30, 3)]
    values = sorted(set(values))
    df = spark.createDataFrame([(k, 0, v) for k, v in enumerate(values)], "id long, side int, v string")
    got = {(x.a, x.b) for x in r.candidate_pairs(df, "levenshtein", t).distinct().collect()}
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values[:]) if i < j and 1 - distance(a, b) / max(len(a), len(b)) >= t}
    assert want <= got and all(a < b for a, b in got)


@pytest.mark.parametrize("strategy", ["jaccard", "cosine", "semantic"])
def test_no_similar_set_is_lost(spark, strategy):
    rng = random.Random(5)
    values = sorted({" ".join(rng.choice(["red", "blue", "old", "ring", "bolt", "nut", "gear"]) for _ in range(rng.randint(1, 6))) for _ in range(90)})
    df = spark.createDataFrame([(k, 0, v) for k, v in enumerate(values)], "id long, side int, v string")
    a, b = df.alias("a"), df.alias("b")
    score = r.similarity(MatchRule("v", strategy), F.col("a.v"), F.col("b.v"))
    want = {(x.i, x.j) for x in a.join(b, F.col("a.id") < F.col("b.id")).where(score >= 0.7).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).collect()}
    assert want and want <= {(x.a, x.b) for x in r.candidate_pairs(df, strategy, 0.7).distinct().collect()}


def test_links_equal_all_pairs(spark):
    rng = random.Random(9)
    names = words(80, 4, "abcd", (4, 9))
    rows = [(k, rng.choice([None, *names]), rng.choice([None, "x", "y"])) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, name string, city string")
    rules = [MatchRule("name", "levenshtein", 0.9, blocking=True), MatchRule("city", "exact", 0.1)]
    links, members = r.similar_records(df, "id", rules, 0.8)
    of = {m.id: m.representative for m in members.collect()}
    got = {(x.a, x.b): round(x.score, 9) for x in links.collect()}
    first = {}
    for i, n, c in rows:
        first.setdefault((n, c), i)
    assert of == {i: first[n, c] for i, n, c in rows}
    want = {}
    for (n, c), i in first.items():
        for (m, d), j in first.items():
            if i < j and n and m:
                w = 0.9 + (0.1 if c and d else 0)
                s = (0.9 * (1 - distance(n, m) / max(len(n), len(m))) + (0.1 * (c == d) if c and d else 0)) / w
                if s >= 0.8:
                    want[i, j] = round(s, 9)
    assert got == want and want


def test_blocking_must_bound_the_pairs():
    with pytest.raises(ValueError, match="too little"):
        r.field_threshold([MatchRule("a", weight=1.0, blocking=True), MatchRule("b", weight=9.0)], 0.8)
    with pytest.raises(ValueError, match="at least one"):
        r.field_threshold([MatchRule("a")], 0.8)


def test_a_hot_value_makes_no_pairs(spark):
    """A third of all rows in one group of copies is one class."""
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'the same name' ELSE md5(cast(id AS string)) END AS name")
    links, members = r.similar_records(df, "id", [MatchRule("name", blocking=True)], 0.9)
    assert links.count() == 0
    assert members.where("representative = 0").count() == 1000


def test_groups_merge(spark):
    df = spark.createDataFrame([(1, "anna berg", None), (2, "anna bergh", "0123"), (3, "zoe", "9"), (4, None, "7")], "id long, name string, phone string")
    links, members = r.similar_records(df, "id", [MatchRule("name", blocking=True)], 0.85)
    grouped = r.groups(links, members, "id")
    assert {x.id: x.master for x in grouped.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    merged = {x.master: (x.name, x.phone) for x in r.merged(df, "id", grouped, "merge").collect()}
    assert merged == {1: ("anna bergh", "0123"), 3: ("zoe", "9"), 4: (None, "7")}
    assert {x.master: x.name for x in r.merged(df, "id", grouped, "best_quality").collect()}[1] == "anna bergh"
    assert {x.master: x.name for x in r.merged(df, "id", grouped, "first").collect()}[1] == "anna berg"


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (5, 5), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# -- what becomes of conflicts: worked examples ---------------------------------------------


def resolve(spark, strategy, old, new, kind, confidence=1.0):
    df = spark.createDataFrame([(old, new, confidence)], f"old {kind}, new {kind}, c double")
    return df.select(o.resolved(strategy, F.col("old"), F.col("new"), df.schema["old"].dataType, F.col("c")).alias("x")).first().x


def test_conflicts(spark):
    assert resolve(spark, "newer_wins", "john.old@example.com", "john.new@example.com", "string") == "john.new@example.com"
    assert resolve(spark, "newer_wins", "kept", None, "string") == "kept"
    assert resolve(spark, "score_based", "john@old.com", "john@new.com", "string", 0.95) == "john@new.com"
    assert resolve(spark, "score_based", 30, 31, "int", 0.8) == 31
    assert resolve(spark, "score_based", 31, 30, "int", 0.8) == 31
    assert resolve(spark, "score_based", "USA", "Canada", "string", 0.8) == "USA"
    assert resolve(spark, "conservative", "John Smith", "Jon Smith", "string") == "John Smith"
    assert resolve(spark, "conservative", None, True, "boolean") is True
    assert resolve(spark, "merge", {"street": "123 Main St", "city": "New York"}, {"city": "Boston", "zip": "02101"}, "map<string,string>") == {"street": "123 Main St", "city": "Boston", "zip": "02101"}
    assert set(resolve(spark, "merge", ["active", "verified"], ["verified", "premium"], "array<string>")) == {"active", "verified", "premium"}
    assert resolve(spark, "merge", "old", "new", "string") == "old"
    with pytest.raises(ValueError, match="no conflict strategy"):
        resolve(spark, "coin", "a", "b", "string")


def test_upsert_counts_versions(spark):
    cols = "id long, name string, confidence double, version int, duplicate_count long"
    old = spark.createDataFrame([(1, "a", 0.5, 3, 0), (2, "b", 0.9, 1, 0)], cols)
    new = spark.createDataFrame([(1, "z", 0.8), (2, "b", 0.1), (3, "c", 0.7)], "id long, name string, confidence double")
    got = {x.id: (x.name, x.confidence, x.version) for x in o.upsert(old, new, "id", ["name"], "newer_wins").collect()}
    assert got == {1: ("z", 0.8, 4), 2: ("b", 0.9, 1), 3: ("c", 0.7, 1)}
    log = {(x.record_id, x.operation, x.old_value, x.new_value) for x in o.change_log(old, o.upsert(old, new, "id", ["name"], "newer_wins"), "id", ["name"], "t").collect()}
    assert log == {("1", "UPDATE", "a", "z"), ("3", "INSERT", None, "c")}


def test_lineage_and_keys(spark):
    assert o.lineage("raw", "entity", {"email": ("mail", "lower")}, "x1") == [("raw", "mail", "entity", "email", "lower", "x1")]
    df = spark.createDataFrame([("A ", None), ("a", "")], "x string, y string")
    keys = [x.k for x in df.select(o.match_key(["x", "y"]).alias("k")).collect()]
    assert keys[0] == keys[1]


@pytest.mark.parametrize("strategy", ["soundex", "exact"])
def test_frequent_codes_lose_no_link(spark, monkeypatch, strategy):
    """Records of a frequent code are compared by their other field, and those without one with all."""
    rng = random.Random(3)
    near = words(40, 6, "abcd", (8, 10))
    rows = [(k, rng.choice(["Robert", "Rupert", "Ribert", "Anna", None]), rng.choice([None, *near, *(w[:-1] + "z" for w in near)])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, street string")
    rules = [MatchRule("name", strategy, 0.3, blocking=True), MatchRule("street", "levenshtein", 0.7)]
    want = {(x.a, x.b): round(x.score, 9) for x in r.similar_records(df, "id", rules, 0.9)[0].collect()}
    monkeypatch.setattr(r, "FREQUENT", 10)
    got = {(x.a, x.b): round(x.score, 9) for x in r.similar_records(df, "id", rules, 0.9)[0].collect()}
    assert got == want and len(want) > 20


def test_many_records_of_one_code(spark):
    """Twenty thousand names of one soundex code: as many pairs as have similar streets, not two hundred million."""
    df = spark.range(20_000).selectExpr("id", "concat('R', repeat('o', cast(1 + id % 40 AS int)), 'bert') AS name", "substr(md5(cast(id AS string)), 1, 12) AS street")
    df = df.unionAll(df.where("id % 500 = 0").selectExpr("id + 100000", "name", "concat(substr(street, 1, 11), 'x')"))
    links, _ = r.similar_records(df, "id", [MatchRule("name", "soundex", 0.3, blocking=True), MatchRule("street", "levenshtein", 0.7)], 0.9)
    assert {(x.a, x.b) for x in links.collect()} == {(i, i + 100000) for i in range(0, 20_000, 500)}


def test_sequential_equals_a_loop_over_records(spark):
    import random

    rng = random.Random(6)
    for n, m in ((8, 9), (40, 60), (60, 40)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        score = {p: round(rng.choice([0.9, 0.95, rng.random()]), 3) for p in pairs}
        kept, want = [], {}
        for i in range(n):
            like = [(-score[k, i], k) for k in kept if (k, i) in score]
            if like:
                want[i] = (True, min(like)[1], -min(like)[0])
            else:
                kept.append(i)
                want[i] = (False, None, None)
        links = spark.createDataFrame([(*p, s) for p, s in score.items()], "a long, b long, score double")
        members = spark.createDataFrame([(i, i) for i in range(n)] + [(1000 + i, i) for i in range(4)], "id long, representative long")
        got = {x.id: tuple(x)[1:] for x in r.sequential(links, members, "id").collect()}
        for i in range(4):
            want[1000 + i] = (True, i, 1.0) if i in kept else want[i]
        assert got == want
    # a - b - c: c is like b only, which was dropped
    links = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "a long, b long, score double")
    members = spark.range(1, 4).selectExpr("id", "id AS representative")
    assert {x.id: x.duplicate_of for x in r.sequential(links, members, "id").collect()} == {1: None, 2: 1, 3: None}
    assert [x.is_duplicate for x in r.sequential(links.limit(0), members, "id").collect()] == [False] * 3


@pytest.mark.parametrize("name", ["load_classify", "load_duplicate_counts", "load_duplicate_edges", "load_statistics"])
def test_loads_shuffle_what_grows(spark, sf_dir, name):
    """However small the optimizer takes records to be, none are broadcast through the driver."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def alike(values, t):
    return {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and 1 - distance(a, b) / max(len(a), len(b)) >= t - 1e-9}


@pytest.mark.parametrize("two_sided", [False, True])
@pytest.mark.parametrize("frequent", [2000, 3])
def test_values_of_one_segment_are_no_pairs(spark, monkeypatch, two_sided, frequent):
    """Short values that share a segment, as most here do, become a pair only if they are alike: what is shuffled grows with the links."""
    monkeypatch.setattr(r, "FREQUENT", frequent)
    values = sorted({"shared" + w for w in words(120, 7, "abcd", (5, 6))})
    df = spark.createDataFrame([(k, k % 2 if two_sided else 0, v) for k, v in enumerate(values)], "id long, side int, v string")
    got = {(x.a, x.b) for x in r.candidate_pairs(df, "levenshtein", 0.9, two_sided).distinct().collect()}
    want = alike(values, 0.9)
    if two_sided:
        want = {(a, b) if a % 2 < b % 2 else (b, a) for a, b in want if a % 2 != b % 2}
    assert got == want and len(want) > 30


@pytest.mark.parametrize("frequent", [2000, 3])
@pytest.mark.parametrize("lengths", [200, 1])
def test_values_too_long_to_travel_are_matched(spark, monkeypatch, frequent, lengths):
    monkeypatch.setattr(r, "FREQUENT", frequent)
    monkeypatch.setattr(r, "MOST_LENGTHS", lengths)
    rng = random.Random(8)
    values = set()
    for base in words(12, 9, "abcdef", (r.CARRIED - 1, r.CARRIED + 2)):
        values |= {base, *(base[:at] + rng.choice(["", "z", "zz", base[at] + "y"]) + base[at + 1 :] for at in rng.sample(range(len(base)), 3))}
    values = sorted(values)
    df = spark.createDataFrame([(k, 0, v) for k, v in enumerate(values)], "id long, side int, v string")
    got = {(x.a, x.b) for x in r.candidate_pairs(df, "levenshtein", 0.93).distinct().collect()}
    assert alike(values, 0.93) <= got and len(alike(values, 0.93)) > 30
    # equal records are a class whether their text is shorter than a digest or not
    twice = df.union(df.selectExpr("id + 1000", "side", "v")).union(spark.createDataFrame([(5000, 0, "ab"), (5001, 0, "ab"), (5002, 0, None), (5003, 0, None)], df.schema))
    links, members = r.similar_records(twice, "id", [MatchRule("v", blocking=True)], 0.93)
    assert {(x.a, x.b) for x in links.collect()} == alike(values, 0.93)
    assert {x.id: x.representative for x in members.collect()} == {**{k + d: k for k in range(len(values)) for d in (0, 1000)}, 5000: 5000, 5001: 5000, 5002: 5002, 5003: 5002}
