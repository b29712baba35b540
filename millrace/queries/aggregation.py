"""Grouping, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregate as a
from millrace.operators import windows as w
from millrace.operators.aggregate import Key, Measure
from millrace.queries.registry import query
from millrace.session import table

# Both engines read these: parts with values and keys that are missing here and there.
GAPPY = "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS p_brand, p_type, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice, p_name"


def gappy(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("_millrace_part")
    return spark.sql(f"{GAPPY} FROM _millrace_part")


G = f"({GAPPY} FROM part)"


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"SELECT p_brand, sum(p_size)::BIGINT AS total, count(p_size) AS n, round(avg(p_size), 6) AS average, min(p_size) AS least, max(p_size) AS most FROM {G} WHERE p_brand IS NOT NULL GROUP BY 1")
def agg_basic(spark, sf_dir):
    measures = [Measure("p_size", k, t) for k, t in (("sum", "total"), ("count", "n"), ("avg", "average"), ("min", "least"), ("max", "most"))]
    return rounded(a.aggregate(gappy(spark, sf_dir), [Key("p_brand")], measures), "average")


@query(f"SELECT round(sum(p_retailprice), 2) AS total, count(p_size) AS n, round(avg(p_size), 6) AS average, count(DISTINCT p_brand) AS brands, (SELECT count(*) FROM (SELECT 1 FROM {G} WHERE p_size IS NULL)) AS gaps FROM {G}")
def agg_global(spark, sf_dir):
    d = gappy(spark, sf_dir).withColumn("gap", F.when(F.col("p_size").isNull(), 1))
    out = a.aggregate(d, [], [Measure("p_retailprice", "sum", "total"), Measure("p_size", "count", "n"), Measure("p_size", "avg", "average"), Measure("p_brand", "unique_count", "brands"), Measure("gap", "count", "gaps")])
    return rounded(rounded(out, "average"), "total", digits=2)


@query(f"""SELECT p_brand, round(median(p_size), 6) AS middle, round(stddev_samp(p_size), 6) AS sd, round(var_samp(p_size), 6) AS spread, round(stddev_pop(p_size), 6) AS sd_pop, round(var_pop(p_size), 6) AS spread_pop,
  round(quantile_cont(p_size, 0.9), 6) AS p90, round(quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25), 6) AS iqr FROM {G} WHERE p_brand IS NOT NULL GROUP BY 1""")
def agg_spread(spark, sf_dir):
    measures = [Measure("p_size", "median", "middle"), Measure("p_size", "stddev", "sd"), Measure("p_size", "variance", "spread"), Measure("p_size", "std", "sd_pop"), Measure("p_size", "var", "spread_pop"), Measure("p_size", "percentile", "p90", params={"p": 90}), Measure("p_size", "iqr", "iqr")]
    return rounded(a.aggregate(gappy(spark, sf_dir), [Key("p_brand")], measures), *(m.name for m in measures))


@query(f"""SELECT p_brand, mode, round(entropy, 6) AS entropy FROM (SELECT p_brand, first(p_size ORDER BY n DESC, p_size) AS mode, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy
  FROM (SELECT p_brand, p_size, count(*) AS n FROM {G} WHERE p_brand IS NOT NULL AND p_size IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""")
def agg_mode_and_entropy(spark, sf_dir):
    return rounded(a.aggregate(gappy(spark, sf_dir), [Key("p_brand")], [Measure("p_size", "mode", "mode"), Measure("p_size", "entropy", "entropy")]), "entropy")


@query(f"""SELECT p_brand, first(p_size ORDER BY p_partkey) FILTER (p_size IS NOT NULL) AS first_size, last(p_size ORDER BY p_partkey) FILTER (p_size IS NOT NULL) AS last_size, count(DISTINCT p_type) AS types FROM {G} WHERE p_brand IS NOT NULL GROUP BY 1""")
def agg_first_last_unique(spark, sf_dir):
    order = {"order": ["p_partkey"]}
    return a.aggregate(gappy(spark, sf_dir), [Key("p_brand")], [Measure("p_size", "first", "first_size", params=order), Measure("p_size", "last", "last_size", params=order), Measure("p_type", "unique_count", "types")])


@query(f"""SELECT p_type, array_to_string(list(coalesce(p_brand, '-') ORDER BY p_brand NULLS FIRST), '|') AS listed, string_agg(p_brand, ';' ORDER BY p_brand) AS joined FROM (SELECT DISTINCT p_type, p_brand FROM {G}) GROUP BY 1""")
def agg_list_and_concat(spark, sf_dir):
    d = gappy(spark, sf_dir).select("p_type", "p_brand").distinct()
    out = a.aggregate(d, [Key("p_type")], [Measure("p_brand", "list", "listed"), Measure("p_brand", "concat", "joined", params={"separator": ";"})])
    return out.withColumn("listed", F.array_join("listed", "|", "-"))


@query(f"""SELECT p_brand, sum(p_size) FILTER (p_retailprice > 950)::BIGINT AS dear, count(*) FILTER (p_type = 'SMALL' AND p_name IS NOT NULL) AS small, max(p_size) FILTER (p_retailprice > 1000000) AS never
  FROM {G} WHERE p_brand IS NOT NULL GROUP BY 1""")
def agg_conditional(spark, sf_dir):
    out = a.aggregate(gappy(spark, sf_dir), [Key("p_brand")], [Measure("p_size", "sum", "dear", "$p_retailprice > 950"), Measure("p_name", "count", "small", "$p_type == 'SMALL'"), Measure("p_size", "max", "never", "$p_retailprice > 1000000")])
    return out.withColumn("small", F.coalesce("small", F.lit(0)))


@query(f"""SELECT p_brand, round(sum(p_size * p_retailprice) / sum(CASE WHEN p_size IS NOT NULL THEN p_retailprice END), 6) AS weighted, round(count(*) FILTER (p_size > 0) / sum(1.0 / p_size) FILTER (p_size > 0), 6) AS harmonic,
  round(exp(avg(ln(p_size)) FILTER (p_size > 0)), 6) AS geometric, round(corr(p_size, p_retailprice), 6) AS correlation FROM {G} WHERE p_brand IS NOT NULL GROUP BY 1""")
def agg_special_means(spark, sf_dir):
    measures = [Measure("p_size", "weighted_avg", "weighted", params={"weight": "p_retailprice"}), Measure("p_size", "harmonic_mean", "harmonic"), Measure("p_size", "geometric_mean", "geometric"), Measure("p_size", "correlation", "correlation", params={"with": "p_retailprice"})]
    return rounded(a.aggregate(gappy(spark, sf_dir), [Key("p_brand")], measures), *(m.name for m in measures))


@query("""SELECT l_returnflag, round(avg(pow(z, 3)), 4) AS skew, round(avg(pow(z, 4)) - 3, 4) AS kurtosis FROM (SELECT l_returnflag, (l_quantity * l_discount - avg(l_quantity * l_discount) OVER (PARTITION BY l_returnflag)) / stddev_pop(l_quantity * l_discount) OVER (PARTITION BY l_returnflag) AS z FROM lineitem) GROUP BY 1""")
def agg_moments(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * F.col("l_discount")).alias("x"))
    return rounded(a.aggregate(d, [Key("l_returnflag")], [Measure("x", "skew", "skew"), Measure("x", "kurtosis", "kurtosis")]), "skew", "kurtosis", digits=4)


@query("""SELECT o_orderpriority, count(*) FILTER (o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a)) AS outliers, first(a) AS q1, first(m) AS q2, first(b) AS q3 FROM
  (SELECT o_orderpriority, o_totalprice * o_totalprice AS o_totalprice FROM orders) JOIN (SELECT o_orderpriority, round(quantile_cont(o_totalprice * o_totalprice, 0.25), 2) AS a, round(quantile_cont(o_totalprice * o_totalprice, 0.5), 2) AS m, round(quantile_cont(o_totalprice * o_totalprice, 0.75), 2) AS b FROM orders GROUP BY 1) USING (o_orderpriority) GROUP BY 1""")
def agg_outliers_and_quartiles(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") * F.col("o_totalprice")).alias("x"))
    out = a.aggregate(d, [Key("o_orderpriority")], [Measure("x", "outlier_count", "outliers"), Measure("x", "quartiles", "q")])
    return out.select("o_orderpriority", "outliers", *(F.round(F.col("q")[i], 2).alias(f"q{i + 1}") for i in range(3)))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def agg_percentile_of_large_groups(spark, sf_dir):
    out = a.bracketed_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5, 0.95])
    return out.select("l_returnflag", *(F.round(F.col("percentiles")[i], 4).alias(n) for i, n in enumerate(("p50", "p95"))))


@query("""SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def agg_by_hour(spark, sf_dir):
    out = a.aggregate(table(spark, sf_dir, "events"), [Key("ts", "hour", granularity="hour")], [Measure("event_id", "count", "n"), Measure("value", "sum", "total")])
    return rounded(out, "total", digits=2).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""SELECT o_orderdate::DATE AS day, date_trunc('week', o_orderdate)::DATE AS week, date_trunc('month', o_orderdate)::DATE AS month, date_trunc('quarter', o_orderdate)::DATE AS quarter, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY ALL""")
def agg_by_granularity(spark, sf_dir):
    return a.aggregate(table(spark, sf_dir, "orders"), [Key("o_orderdate", g, granularity=g) for g in ("day", "week", "month", "quarter", "year")], [Measure("o_orderkey", "count", "n")])


@query(f"""SELECT CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 30 THEN 'middle' ELSE 'high' END AS range, coalesce(MAP {{'Brand#1': 'first', 'Brand#2': 'second'}}[p_brand], 'Other') AS brand, count(*) AS n FROM {G} WHERE p_size IS NOT NULL GROUP BY ALL""")
def agg_by_buckets(spark, sf_dir):
    keys = [Key("p_size", "range", ranges=[10, 30], labels=["low", "middle", "high"]), Key("p_brand", "brand", mapping={"Brand#1": "first", "Brand#2": "second"})]
    return a.aggregate(gappy(spark, sf_dir), keys, [Measure("p_partkey", "count", "n")])


@query("""SELECT CASE WHEN o_totalprice <= b[1] THEN 'Q1' WHEN o_totalprice <= b[2] THEN 'Q2' WHEN o_totalprice <= b[3] THEN 'Q3' ELSE 'Q4' END AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS b FROM orders) GROUP BY 1""")
def agg_by_quantile(spark, sf_dir):
    out = a.aggregate(table(spark, sf_dir, "orders"), [Key("o_totalprice", "bucket", quantiles=4)], [Measure("o_orderkey", "count", "n"), Measure("o_totalprice", "sum", "total")])
    return rounded(out, "total", digits=2)


@query("""SELECT lower(c_mktsegment) AS low, length(c_mktsegment)::INT AS long, round_even(c_acctbal / 1000, 0) AS thousands, count(*) AS n FROM customer GROUP BY ALL""")
def agg_by_transform(spark, sf_dir):
    d = table(spark, sf_dir, "customer").withColumn("k", F.col("c_acctbal") / 1000)
    return a.aggregate(d, [Key("c_mktsegment", "low", transform="lower"), Key("c_mktsegment", "long", transform="length"), Key("k", "thousands", transform="round")], [Measure("c_custkey", "count", "n")])


@query(f"SELECT p_type, round(avg(coalesce(p_size, 0)), 6) AS average FROM {G} GROUP BY 1")
def agg_nulls_as_zero(spark, sf_dir):
    return rounded(a.aggregate(gappy(spark, sf_dir), [Key("p_type")], [Measure("p_size", "avg", "average")], nulls="zero"), "average")


@query(f"SELECT DISTINCT p_brand, p_type FROM {G} WHERE p_brand IS NOT NULL")
def agg_distinct_keys(spark, sf_dir):
    return a.aggregate(gappy(spark, sf_dir), [Key("p_brand"), Key("p_type"), Key("no_such_column")], [])


@query("""SELECT l_returnflag, l_linestatus, (2 - grouping(l_linestatus))::INT AS hierarchy_level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""")
def agg_hierarchy(spark, sf_dir):
    out = a.hierarchy(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [Measure("l_orderkey", "count", "n"), Measure("l_quantity", "sum", "quantity")])
    return rounded(out, "quantity", digits=2)


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS grouping, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def agg_cube(spark, sf_dir):
    return a.cube(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [Measure("l_orderkey", "count", "n")])


@query("""SELECT p_brand, p_type, grouping(p_brand, p_type)::BIGINT AS grouping, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY ROLLUP (p_brand, p_type)""")
def agg_rollup(spark, sf_dir):
    return a.cube(table(spark, sf_dir, "part"), ["p_brand", "p_type"], [Measure("p_partkey", "count", "n"), Measure("p_size", "sum", "size")], "rollup")


@query("""SELECT o_custkey, coalesce(first(o_totalprice ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), 0.0) AS F, coalesce(first(o_totalprice ORDER BY o_orderkey) FILTER (o_orderstatus = 'O'), 0.0) AS O, coalesce(first(o_totalprice ORDER BY o_orderkey) FILTER (o_orderstatus = 'P'), 0.0) AS P FROM orders GROUP BY 1""")
def agg_pivot(spark, sf_dir):
    return a.pivot(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ["F", "O", "P"], ["o_orderkey"], 0.0)


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'X') AS X FROM orders GROUP BY 1""")
def agg_crosstab(spark, sf_dir):
    return a.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "X"])


def _summary(c: str) -> str:
    return f"SELECT '{c}' AS column_name, count({c})::DOUBLE AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(sum({c}), 2) AS sum FROM lineitem"


@query(" UNION ALL ".join(_summary(c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
def agg_numeric_summary(spark, sf_dir):
    out = a.numeric_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(rounded(out, "mean", "std", digits=4), "sum", digits=2)


@query("""SELECT * FROM (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)::INT AS place, count(*) OVER (PARTITION BY column_name) AS unique_values FROM
  (SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2)) WHERE place <= 10""")
def agg_top_values(spark, sf_dir):
    return a.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_size"])


@query("SELECT (SELECT count(*) FROM lineitem) AS input_rows, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS output_rows, round((SELECT count(*) FROM lineitem) / (SELECT count(DISTINCT l_partkey) FROM lineitem), 6) AS ratio")
def agg_compression(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return rounded(a.compression(d, a.aggregate(d, [Key("l_partkey")], [])), "ratio")


DAILY = "(SELECT c_mktsegment, o_orderdate::DATE AS day, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query(f"""SELECT s.c_mktsegment, s.day, coalesce(n, 0) AS n FROM (SELECT c_mktsegment, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM {DAILY} GROUP BY 1) s LEFT JOIN {DAILY} d ON s.c_mktsegment = d.c_mktsegment AND s.day = d.day""")
def agg_fill_periods(spark, sf_dir):
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    days = a.aggregate(d, [Key("c_mktsegment"), Key("o_orderdate", "day", granularity="day")], [Measure("o_orderkey", "count", "n")])
    return a.fill_periods(days, "day", "day", ["c_mktsegment"], {"n": 0})


@query("""SELECT day, n, CASE WHEN row_number() OVER w >= 7 THEN round(avg(n) OVER w, 6) END AS rolling_avg, CASE WHEN row_number() OVER w >= 7 THEN (sum(n) OVER w)::BIGINT END AS rolling_sum, CASE WHEN row_number() OVER w >= 7 THEN round(stddev_samp(n) OVER w, 6) END AS rolling_std,
  CASE WHEN row_number() OVER w >= 7 THEN min(n) OVER w END AS rolling_min, CASE WHEN row_number() OVER w >= 7 THEN max(n) OVER w END AS rolling_max FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def win_rolling_days(spark, sf_dir):
    days = a.aggregate(table(spark, sf_dir, "orders"), [Key("o_orderdate", "day", granularity="day")], [Measure("o_orderkey", "count", "n")])
    return rounded(w.rolling(days, ["day"], "n", 7, ["avg", "sum", "std", "min", "max"]), "rolling_avg", "rolling_std")


@query("""SELECT event_id, CASE WHEN row_number() OVER w >= 50 THEN round(sum(value) OVER w, 2) END AS rolling_sum FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def win_rolling_rows(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return rounded(w.rolling(d, ["ts", "event_id"], "value", 50, ["sum"]), "rolling_sum", digits=2).select("event_id", "rolling_sum")


@query("""SELECT event_id, CASE WHEN count(*) OVER w = 5 THEN round(max(value) OVER w, 6) END AS rolling_max, CASE WHEN count(*) OVER w = 5 THEN round(min(value) OVER w, 6) END AS rolling_min FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def win_rolling_by_key(spark, sf_dir):
    out = w.rolling(table(spark, sf_dir, "events"), ["ts", "event_id"], "value", 5, ["max", "min"], ["user_id"])
    return rounded(out, "rolling_max", "rolling_min").select("event_id", "rolling_max", "rolling_min")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders")
def win_row_numbers(spark, sf_dir):
    return w.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_number")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def win_latest_rows(spark, sf_dir):
    return w.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def win_latest_by_key(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return w.latest_by_key(d, ["user_id"], ["ts", "event_id"])


@query("""SELECT user_id, date_trunc('day', ts) AS bucket, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2""")
def win_buckets(spark, sf_dir):
    out = w.buckets(table(spark, sf_dir, "events"), ["user_id"], "ts", "day", [F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")])
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
