import pytest

from millrace.operators import ingest as i
from millrace.operators import profile as p
from millrace.operators import windows as w


def test_numbers_follow_a_total_order(spark):
    df = spark.range(0, 5000, 1, 13).selectExpr("(id * 7919) % 5003 AS k")
    got = sorted((r.k, r.row_number) for r in w.numbered(df, ["k"]).collect())
    assert [n for _, n in got] == list(range(1, 5001))
    assert w.numbered(df.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("window, block", [(1, 10), (3, 3), (7, 50), (40, 50)])
def test_blocks_roll_like_one_window(spark, window, block):
    values = [(k, float((k * 37) % 101)) for k in range(230)]
    got = {r.k: r.rolling_sum for r in w.rolling(spark.createDataFrame(values, "k long, v double").repartition(5), ["k"], "v", window, ["sum"], block=block).collect()}
    for k, _ in values:
        want = sum(v for _, v in values[k - window + 1 : k + 1]) if k >= window - 1 else None
        assert got[k] == (pytest.approx(want) if want is not None else None)


def test_latest_rows_by_either_way(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, None)], "k long, t long, v string")
    assert sorted(map(tuple, w.latest_by_key(df, ["k"], ["t"]).collect())) == [(1, 9, "b"), (2, 1, None)]
    assert sorted(map(tuple, w.latest(df, ["k"], [df.t.desc()]).collect())) == [(1, 9, "b"), (2, 1, None)]


def test_type_ladder(spark):
    df = spark.createDataFrame([("1", "1,000", "2024-01-01", "x", "", None)] * 4 + [("0", "oops", "soon", "1", "", None)], "b string, n string, d string, s string, e string, z string")
    got = {r.column_name: (r.data_type, r.null_count, r.unique_count) for r in p.profile(df).collect()}
    assert got["b"] == ("BOOLEAN", 0, 2)
    assert got["n"][0] == "STRING" and got["d"][0] == "STRING"  # four of five is not more than 80 %
    assert got["e"] == ("STRING", 0, 1) and got["z"] == ("STRING", 5, 0)
    more = df.unionAll(df.where("s = 'x'").limit(1))
    got = {r.column_name: r.data_type for r in p.profile(more).collect()}
    assert got["n"] == "NUMBER" and got["d"] == "DATE"


def test_schema_walk(spark):
    df = spark.sql("SELECT named_struct('b', array(named_struct('c', 1))) AS a, 2 AS d")
    assert p.schema_fields(df.schema) == [("a", "object", 0), ("a.b", "array", 1), ("a.b.c", "primitive", 2), ("d", "primitive", 0)]
    assert p.depth(df.schema) == 3
    assert p.type_mismatches(df, {"d": "int", "x": "string"}) == [("x", "string", "")]


def test_records_are_split_whole(spark):
    df = spark.createDataFrame([(1, ""), (2, "y" * 10_001), (3, 'a"b'), (4, "fine"), (None, None)], "k int, t string")
    checks = i.csv_checks(df)
    marked = i.checked(df, checks, ["record is blank", "field too long"])
    good, bad = i.split_records(marked)
    assert sorted(r.k for r in good.collect()) == [1, 3, 4]
    assert {(r.k, r.rejection_reason) for r in bad.collect()} == {(2, "field too long"), (None, "record is blank")}
    assert [r.k for r in good.where("size(_warnings) > 0").collect()] == [3]
    assert tuple(i.ingest_stats(marked).first()) == (5, 3, 2, 1)


def test_hash_ignores_the_order_of_columns(spark):
    df = spark.sql("SELECT 1 AS a, cast(NULL AS string) AS b")
    assert df.select(i.record_hash(["a", "b"])).first() == df.select("b", "a").select(i.record_hash(["b", "a"])).first()


def test_flatten_and_unwrap(spark):
    df = spark.sql("SELECT named_struct('x', 1, 'y', array()) AS a, array('q') AS one, array(named_struct('z', 3)) AS many")
    got = i.flatten(df).first().asDict()
    assert got == {"a.x": 1, "a.y": None, "one": "q", "many": '[{"z":3}]'}
    assert i.unwrapped(df.select("one")).first().one == "q"
