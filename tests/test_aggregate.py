import numpy as np
import pytest

from millrace.operators import aggregate as a
from millrace.operators.aggregate import Key, Measure


@pytest.fixture(scope="module")
def groups(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 2), ("a", 2.0, 3), ("a", 1.0, 4), ("b", None, 5), ("b", None, 6), (None, 9.0, 7), ("c", 5.0, 8)]
    return spark.createDataFrame(rows, "g string, v double, ord int")


def by_key(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_null_keys_go_and_empty_groups_stay(groups):
    got = by_key(a.aggregate(groups, [Key("g")], [Measure("v", "sum"), Measure("v", "count"), Measure("v", "stddev"), Measure("v", "mode"), Measure("v", "entropy")]))
    assert set(got) == {"a", "b", "c"}
    assert got["a"][:2] == (6.0, 4) and got["a"][3:] == (1.0, 1.0)  # of equally frequent values the smaller
    assert got["b"] == (0.0, 0, None, None, None)
    assert got["c"] == (5.0, 1, None, 5.0, 0.0)


def test_conditions_lists_and_order(groups):
    got = by_key(a.aggregate(groups, [Key("g")], [Measure("v", "sum", "s", "$v > 1"), Measure("v", "list", "l"), Measure("v", "first", "f", params={"order": ["ord"]}), Measure("v", "last", "z", params={"order": ["ord"]})]))
    assert got["a"] == (4.0, [1.0, 1.0, 2.0, 2.0], 1.0, 1.0)
    assert got["b"] == (None, [None, None], None, None)


def test_nulls(spark, groups):
    got = by_key(a.aggregate(groups, [Key("g")], [Measure("v", "count")], nulls="zero"))
    assert got["b"] == (2,)
    with pytest.raises(Exception, match="v is null"):
        a.aggregate(groups, [Key("g")], [Measure("v", "sum")], nulls="error").collect()


def test_empty_tables(groups):
    none = groups.where("false")
    assert a.aggregate(none, [Key("g")], [Measure("v", "sum")]).count() == 0
    assert [tuple(r) for r in a.aggregate(none, [], [Measure("v", "sum"), Measure("v", "count"), Measure("v", "mode")]).collect()] == [(0.0, 0, None)]


def test_unknown_measures_are_refused(groups):
    with pytest.raises(ValueError, match="no measure"):
        a.aggregate(groups, [], [Measure("v", "wisdom")])
    with pytest.raises(ValueError, match="label"):
        a.aggregate(groups, [Key("v", ranges=[1.0], labels=["x"])], [])


def test_names_of_keys_and_measures(groups):
    assert a.aggregate(groups, [Key("g", "group"), Key("absent")], [Measure("v", "max"), Measure("v", "min", "low")]).columns == ["group", "v_max", "low"]


def test_bracketed_percentiles_are_exact(spark):
    rng = np.random.default_rng(4)
    groups = {"large": rng.normal(size=9000).round(3), "small": np.array([3.0, 1.0, 2.0, 10.0]), "one": np.array([7.0]), "ties": np.repeat([1.0, 2.0], 3000)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), (None, 1.0)], "k string, v double")
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = by_key(a.bracketed_percentiles(df, ["k"], "v", shares, accuracy=500))
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k][0] == pytest.approx(np.percentile(vs, [100 * p for p in shares]).tolist())
    assert a.quantile_bounds(df.where("k = 'small'"), "v", 2) == [2.5]
    assert a.bracketed_percentiles(df.where("false"), [], "v", [0.5]).count() == 0


def test_fill_periods_without_keys(spark):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-04", 2)], "d string, n int").selectExpr("cast(d AS date) AS d", "n")
    assert sorted(r.n for r in a.fill_periods(df, "d", "day", [], {"n": 0}).collect()) == [0, 0, 1, 2]


def test_partitions_make_no_difference(groups):
    measures = [Measure("v", k) for k in ("sum", "avg", "median", "unique_count")]
    one, many = (sorted(map(tuple, a.aggregate(groups.repartition(n), [Key("g")], measures).collect())) for n in (1, 8))
    assert one == many


def test_ranks_of_large_groups_are_the_same(spark, monkeypatch):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 9 = 0 THEN 'small' ELSE 'big' END AS k", "CASE WHEN id % 50 = 0 THEN null WHEN id % 977 = 0 THEN 90000 ELSE (id * 7919) % 1000 END AS v")
    kinds = ["median", "percentile", "percentile_25", "percentile_75", "iqr", "quartiles", "outlier_count", "avg"]
    measures = [a.Measure("v", kind, condition="$v != 5" if kind == "iqr" else None, params={"p": 90} if kind == "percentile" else {}) for kind in kinds]
    want = by_key(a.aggregate(df, [a.Key("k")], measures))
    whole = a.aggregate(df, [], measures).first()
    asked = []
    plain = a.bracketed_percentiles
    monkeypatch.setattr(a, "bracketed_percentiles", lambda *x: asked.append(x) or plain(*x, accuracy=500))
    assert by_key(a.aggregate(df, [a.Key("k")], measures, large=5_000)) == want
    assert len(asked) == 7
    assert a.aggregate(df, [], measures, large=5_000).first() == whole
    asked.clear()
    assert by_key(a.aggregate(df, [a.Key("k")], measures, large=100_000)) == want and not asked
