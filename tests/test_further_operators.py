import datetime
import difflib
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import dates, formats, text
from millrace.operators import aggregate as a
from millrace.operators import mapping as m
from millrace.operators import profile as p
from millrace.operators import windows as w
from millrace.sources import files, sinks


def test_addresses_are_what_python_says(spark):
    rng = random.Random(1)
    given = ["", "1.2.3", "01.2.3.4", "1.2.3.256", "a", ":", "1::2::3", ":::", "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:", "::1", "::", "1:2:3:4:5:6:7:8", "FE80::1", "::8.8.8.8", "1::10.1.2.3", "1:2:3:4:5:6:7::"]
    for n in (*formats.PRIVATE_V4, *formats.SHARED_V4, *formats.PUBLIC_IN_PRIVATE_V4, *formats.PRIVATE_V6, *formats.PUBLIC_IN_PRIVATE_V6, *formats.RESERVED_V6, "224.0.0.0/4", "ff00::/8"):
        x = ipaddress.ip_network(n)
        first, last = int(x[0]), int(x[-1])
        given += [str(type(x[0])(v)) for v in (first, last, first - 1, last + 1, rng.randint(first, last)) if 0 <= v < 1 << x.max_prefixlen]
    given += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(50)] + [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(10)]
    given += [f"::ffff:{ipaddress.IPv4Address(rng.getrandbits(32))}" for _ in range(20)]
    names = ("version", "is_private", "is_global", "is_loopback", "is_multicast", "is_link_local", "is_reserved")
    df = spark.createDataFrame([(x,) for x in given], "ip string")
    for r in df.select("ip", formats.ip_properties(F.col("ip")).alias("p")).collect():
        try:
            x = ipaddress.ip_address(r.ip)
        except ValueError:
            assert r.p is None, r.ip
            continue
        assert r.p is not None and {n: r.p[n] for n in names} == {n: getattr(x, n) for n in names}, r.ip
        assert ipaddress.ip_address(r.p.exploded) == x


def test_ratio_is_that_of_the_sequence_matcher(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choices("abcd ", k=rng.randint(0, 12))), "".join(rng.choices("abcd ", k=rng.randint(0, 12)))) for _ in range(200)] + [(None, "a"), ("", "")]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.ratio_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == (None if r.a is None else round(100 * difflib.SequenceMatcher(None, r.a, r.b).ratio()) / 100)


def test_years_are_filled(spark):
    df = spark.createDataFrame([(datetime.date(2019, 5, 1), 1), (datetime.date(2022, 1, 1), 2)], "d date, v int")
    by_year = a.aggregate(df, [a.Key("d", "year", granularity="year")], [a.Measure("v", "count", "n")])
    assert sorted(map(tuple, a.fill_periods(by_year, "year", "year", [], {"n": 0}).collect())) == [(2019, 1), (2020, 0), (2021, 0), (2022, 1)]


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_a_hot_key_rolls_in_blocks(spark, block):
    rows = [(k % 5 if k % 3 == 0 else 9, k, float(k * k % 31)) for k in range(200)]
    got = {r.t: r.rolling_sum for r in w.rolling(spark.createDataFrame(rows, "k int, t int, v double").repartition(4), ["t"], "v", 4, ["sum"], ["k"], block=block).collect()}
    for k, t, _ in rows:
        own = [v for x, u, v in rows if x == k and u <= t][-4:]
        assert got[t] == (pytest.approx(sum(own)) if len(own) == 4 else None)


def test_numbers_by_unique_columns(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS g", "repeat('x', 100) AS wide")
    got = {r.id: r.n for r in w.numbered(df, [F.col("g").desc(), "id"], "n", ["id"]).collect()}
    want = sorted(range(100), key=lambda i: (-(i % 7), i))
    assert got == {i: k + 1 for k, i in enumerate(want)}


def test_samples_and_distinct_values_of_long_texts(spark):
    rows = [("long text number %05d of the column" % (k * 7919 % 30_000), k % 3, None) for k in range(30_000)]
    df = spark.createDataFrame(rows, "t string, few int, none string").repartition(5)
    got = {r.column_name: r.sample_values for r in p.samples(df).collect()}
    assert got == {"t": ["long text number %05d of the column" % k for k in range(10)], "few": ["0", "1", "2"]}
    told = {r.column_name: (r.unique_count, r.null_count, r.min_length) for r in p.profile(df).collect()}
    assert told == {"t": (30_000, 0, 36), "few": (3, 0, 1), "none": (0, 30_000, None)}
    assert [r.total_count for r in p.profile(df.limit(0)).collect()] == [0, 0, 0]
    assert p.samples(df.limit(0)).count() == 0


def test_dry_runs_load_nothing_and_show_errors(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "n") for k in range(30)], "id int, name string")
    got = m.dry_run(df, [m.Mapping("key", source="id"), m.Mapping("name", source="name", required=True)], [{"type": "calculation", "target": "twice", "expression": "$key * 2"}])
    rows = got.collect()
    assert len(rows) == m.SAMPLES and got.columns == ["input", "output", "_errors"]
    assert all(r.output.twice == 2 * r.input.id and r._errors == (["name: required"] if r.input.name is None else []) for r in rows)


def test_statements_put_rows_back(spark):
    df = spark.sql("SELECT 1 AS i, 'it''s' AS s, cast(NULL AS string) AS n, array(1, 2) AS l, DATE '2024-01-02' AS d")
    assert sinks.insert_statements(df, "t").first().value == "INSERT INTO t (i, s, n, l, d) VALUES (1, 'it''s', NULL, '[1,2]', '2024-01-02');"


def test_databases_answer_queries(spark):
    url = "jdbc:derby:memory:millrace;create=true"
    spark.range(20).selectExpr("cast(id AS int) AS k", "concat('n', id) AS v").write.jdbc(url, "numbers", "overwrite")
    got = files.read_jdbc(spark, url, 'SELECT "k", "v" FROM numbers WHERE "k" < 15')
    assert sorted(map(tuple, got.collect())) == sorted((k, f"n{k}") for k in range(15))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():  # noqa: N802
                        class Nothing:
                            @staticmethod
                            def isDefined():  # noqa: N802
                                return False

                        return Nothing

                return Sc

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_now_is_one_time(spark):
    assert spark.range(3).select(dates.format_datetime(dates.now(), "yyyy").alias("y")).distinct().count() == 1
