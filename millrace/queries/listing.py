"""Criteria, sorting, pages, set operations and calendar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates as d
from millrace.functions import text
from millrace.operators import criteria as c
from millrace.queries.registry import query
from millrace.session import table


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' AND (o_totalprice >= 300000 OR o_orderpriority ILIKE '%urgent%') AND o_orderpriority NOT IN ('5-LOW')")
def crit_tree(spark, sf_dir):
    tree = {
        "and": [["o_orderstatus", "!=", "P"], {"field": "o_orderpriority", "operator": "not_in", "value": "5-LOW"}],
        "or": [["o_totalprice", ">=", "300000"], ["o_orderpriority", "like", "URGENT"]],
    }
    return c.listed(table(spark, sf_dir, "orders"), tree).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def crit_equal(spark, sf_dir):
    return c.equal_to(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=3, c_name=None).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 40 AND p_size <= 39 AND p_brand IS NOT NULL AND NOT (p_type ILIKE '%small%') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def crit_operators(spark, sf_dir):
    tree = [["p_size", ">", 10], ["p_size", "<", 40], ["p_size", "<=", "39"], ["p_brand", "is_not_null"], ["p_type", "not_like", "small"], ["p_brand", "in", ["Brand#1", "Brand#2", "Brand#3"]]]
    return c.listed(table(spark, sf_dir, "part"), tree).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01' AND o_orderstatus = 'F'")
def crit_time_range(spark, sf_dir):
    return c.listed(table(spark, sf_dir, "orders"), [["o_orderdate", ">=", "1998-01-01"], ["o_orderdate", "<", "1998-07-01"], ["o_orderstatus", "=", "F"]]).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%77%' OR c_mktsegment ILIKE '%77%' OR c_custkey::VARCHAR ILIKE '%77%'")
def crit_search(spark, sf_dir):
    return c.search_any(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_custkey"], "77").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity * l_discount > 3 AND l_returnflag IN ('A', 'R') AND NOT (l_tax = 0)")
def crit_expression(spark, sf_dir):
    return c.where_expression(table(spark, sf_dir, "lineitem"), "$l_quantity * $l_discount > 3 and $l_returnflag in ['A', 'R'] and not ($l_tax == 0)").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name ILIKE '%_1%' ESCAPE '$' AND c_acctbal > 9000".replace("%_1%", "%$_1%"))
def crit_relation_path(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.listed(rows, [["n_name", "like", "_1"], ["c_acctbal", ">", 9000]]).select("c_custkey", "n_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 100")
def page_sorted(spark, sf_dir):
    return c.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [("o_custkey", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")], 100)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def page_top_counts(spark, sf_dir):
    return c.top_counts(table(spark, sf_dir, "orders"), "o_orderpriority", 3)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 100")
def page_offset(spark, sf_dir):
    return c.page(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [("p_retailprice", "desc"), ("p_partkey", "asc")], 3, 50)


@query("SELECT count(*) AS total, ceil(count(*) / 70.0)::BIGINT AS pages, 3 < ceil(count(*) / 70.0) AS has_next, true AS has_previous FROM orders WHERE o_orderstatus = 'O'")
def page_info(spark, sf_dir):
    return c.page_info(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), 3, 70)


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderkey > 100) > 40 AS has_more FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 40")
def page_cursor(spark, sf_dir):
    return c.after_cursor(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 40)


@query("SELECT c_nationkey AS k, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def set_union_all(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("side"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("k")))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).subtract(table(spark, sf_dir, "events").select("user_id"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "events").select("user_id"))


@query("""SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_type), ['view', 'other']))), ',') AS kinds FROM events GROUP BY 1""")
def set_list_union(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", F.array_join(F.sort_array(F.array_union("k", F.array(F.lit("view"), F.lit("other")))), ",").alias("kinds"))


@query("SELECT c_custkey, md5(c_name) AS md5, sha1(c_name) AS sha1, sha256(c_name) AS sha256 FROM customer")
def fn_digests(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("md5"), F.sha1("c_name").alias("sha1"), F.sha2("c_name", 256).alias("sha256"))


@query("SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS json, strlen('{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}') <= 1048576 AS fits FROM events")
def fn_json(spark, sf_dir):
    json = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    return table(spark, sf_dir, "events").select("event_id", json.alias("json"), (F.octet_length(json) <= 1 << 20).alias("fits"))


@query("SELECT page_id, CASE WHEN s >= 1048576 THEN printf('%.1f MB', s / 1048576.0) WHEN s >= 1024 THEN printf('%.1f KB', s / 1024.0) WHEN s >= 1 THEN printf('%.1f B', s::DOUBLE) ELSE '0.0 B' END AS size FROM (SELECT page_id, strlen(coalesce(html, '')) AS s FROM pages)")
def fn_file_size(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.file_size(F.octet_length(F.coalesce("html", F.lit("")))).alias("size"))


@query("""SELECT page_id, CASE WHEN contains(string_split(u, '/')[-1], '.') THEN lower(string_split(string_split(u, '/')[-1], '.')[-1]) ELSE '' END AS extension FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/a.b/c.TAR.Gz' WHEN 1 THEN '/x' ELSE '/p.HTML' END AS u FROM pages)""")
def fn_file_extension(spark, sf_dir):
    ends = F.when(F.col("page_id") % 3 == 0, "/a.b/c.TAR.Gz").when(F.col("page_id") % 3 == 1, "/x").otherwise("/p.HTML")
    return table(spark, sf_dir, "pages").select("page_id", text.file_extension(F.concat("url", ends)).alias("extension"))


# -- calendar ------------------------------------------------------------------------------

DAYS = "SELECT o_orderkey, o_orderdate::DATE AS day, (o_orderdate + to_days((o_orderkey % 40)::INT))::DATE AS later FROM orders"


def days(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return rows.withColumn("later", F.date_add("day", (F.col("o_orderkey") % 40).cast("int")))


@query("""SELECT o_orderkey, o_orderdate AS parsed, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate END AS parsed_some FROM orders""")
def date_parse(spark, sf_dir):
    key = F.col("o_orderkey") % 5
    shown = F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(key == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(key == 2, F.date_format("o_orderdate", "d MMM yyyy")).when(key == 3, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("no date")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "orders").select("o_orderkey", d.parse_datetime(iso).cast("timestamp_ntz").alias("parsed"), d.parse_datetime(shown).cast("timestamp_ntz").alias("parsed_some"))


# Both engines read these: sentences with a date in them.
_SAID = """CASE o_orderkey % 5 WHEN 0 THEN 'Shipped on ' || {long} || ' at 3:07 pm, as agreed' WHEN 1 THEN 'Due the ' || {short} || ', please; 12 boxes' WHEN 2 THEN 'order (' || {slashed} || ') 17:45:10'
  WHEN 3 THEN 'paid ' || {american} || '.' ELSE 'no date in it, 12 times' END"""
_SENTENCES = _SAID.format(long="strftime(o_orderdate, '%B %-d, %Y')", short="strftime(o_orderdate, '%-dth of %b %Y')", slashed="strftime(o_orderdate, '%Y/%m/%d')", american="strftime(o_orderdate, '%m/%d/%Y')")


@query(rf"""SELECT o_orderkey, coalesce(try_strptime(regexp_extract(s, '[A-Z][a-z]+ \d+, \d{{4}} at \d+:\d+ [ap]m'), '%B %d, %Y at %I:%M %p'), try_strptime(replace(regexp_extract(s, '\d+th of [A-Z][a-z]+ \d{{4}}'), 'th of', ''), '%d %b %Y'),
  try_strptime(replace(regexp_extract(s, '\d{{4}}/\d\d/\d\d. [\d:]+'), ')', ''), '%Y/%m/%d %H:%M:%S'), try_strptime(regexp_extract(s, '\d\d/\d\d/\d{{4}}'), '%m/%d/%Y')) AS found FROM (SELECT o_orderkey, {_SENTENCES} AS s FROM orders)""")
def date_in_text(spark, sf_dir):
    shown = {n: f"date_format(o_orderdate, {f})" for n, f in {"long": '"MMMM d, yyyy"', "short": "\"d'th of 'MMM yyyy\"", "slashed": "'yyyy/MM/dd'", "american": "'MM/dd/yyyy'"}.items()}
    return table(spark, sf_dir, "orders").select("o_orderkey", d.find_datetime(F.expr(_SAID.format(**shown))).cast("timestamp_ntz").alias("found"))


@query("SELECT event_id, ts + INTERVAL 7 HOUR AS jakarta, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events")
def date_timezone(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", d.convert_timezone(F.col("ts"), "UTC", "Asia/Jakarta").cast("timestamp_ntz").alias("jakarta"), d.format_datetime(F.col("ts"), "yyyy-MM-dd HH:mm").alias("shown"))


@query("SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 6 DAY, INTERVAL 3 DAY))::DATE AS day FROM orders")
def date_range(spark, sf_dir):
    return days(spark, sf_dir).select("o_orderkey", F.explode(d.date_range(F.col("day"), F.date_add("day", 6), 3)).alias("day"))


@query(f"""SELECT o_orderkey, (s - s % 86400 + s % 86400)::BIGINT AS seconds, CASE WHEN s = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN s >= 86400 THEN (s // 86400) || 'd' END, CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || 'h' END) END AS shown
  FROM (SELECT o_orderkey, (later - day) * 86400 + (o_orderkey % 7) * 3600 AS s FROM ({DAYS}))""")
def date_duration(spark, sf_dir):
    ends = F.timestamp_add("HOUR", (F.col("o_orderkey") % 7).cast("int"), F.col("later").cast("timestamp"))
    seconds = d.duration_seconds(F.col("day"), ends)
    return days(spark, sf_dir).select("o_orderkey", seconds.alias("seconds"), d.format_duration(seconds).alias("shown"))


@query("""SELECT DISTINCT o_orderdate::DATE AS day, date_trunc('week', o_orderdate)::DATE AS monday, date_trunc('week', o_orderdate)::DATE + 6 AS sunday, date_trunc('month', o_orderdate)::DATE AS month_start, last_day(o_orderdate) AS month_end,
  date_trunc('quarter', o_orderdate)::DATE AS quarter_start, last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS quarter_end FROM orders""")
def date_bounds(spark, sf_dir):
    day = F.col("day")
    (a, b), (e, f), (g, h) = d.week_bounds(day), d.month_bounds(day), d.quarter_bounds(day)
    return days(spark, sf_dir).select("day", a.alias("monday"), b.alias("sunday"), e.alias("month_start"), f.alias("month_end"), g.alias("quarter_start"), h.alias("quarter_end")).distinct()


@query(f"""SELECT o_orderkey, isodow(day) < 6 AS business, len(list_filter(generate_series(day::TIMESTAMP, later::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS business_days FROM ({DAYS})""")
def date_business_days(spark, sf_dir):
    return days(spark, sf_dir).select("o_orderkey", d.is_business_day(F.col("day")).alias("business"), d.count_business_days(F.col("day"), F.col("later")).alias("business_days"))


@query(f"""SELECT o_orderkey, list_filter(generate_series(day::TIMESTAMP + INTERVAL 1 DAY, day::TIMESTAMP + INTERVAL 30 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6)[10]::DATE AS after_ten,
  list_reverse(list_filter(generate_series(day::TIMESTAMP - INTERVAL 30 DAY, day::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda x: isodow(x) < 6))[3]::DATE AS before_three FROM ({DAYS})""")
def date_add_business_days(spark, sf_dir):
    return days(spark, sf_dir).select("o_orderkey", d.add_business_days(F.col("day"), 10).alias("after_ten"), d.add_business_days(F.col("day"), -3).alias("before_three"))


@query(f"SELECT o_orderkey, ((day + INTERVAL 14 MONTH)::DATE + 10) AS moved FROM ({DAYS})")
def date_relative(spark, sf_dir):
    return days(spark, sf_dir).select("o_orderkey", d.relative_date(F.col("day"), years=1, months=2, weeks=1, days=3).alias("moved"))


@query(f"""SELECT o_orderkey, round_even(m // 12 + (m % 12) / 12.0 + (DATE '2002-01-15' - (day + to_months(m::INT))::DATE) / 365.25, 2)::DOUBLE AS age FROM (SELECT o_orderkey, day, datesub('month', day, DATE '2002-01-15') AS m FROM ({DAYS}))""")
def date_age(spark, sf_dir):
    return days(spark, sf_dir).select("o_orderkey", d.age_years(F.col("day"), F.lit("2002-01-15").cast("date")).alias("age"))


@query("SELECT event_id, ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR AS recent FROM events")
def date_recent(spark, sf_dir):
    from millrace.operators.control import newest

    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", d.is_recent(F.col("ts"), F.lit(newest(rows, "ts")).cast("timestamp_ntz"), 48).alias("recent"))


@query(f"SELECT DISTINCT day, (date_trunc('month', day) - to_months(k::INT))::DATE AS month FROM (SELECT day, unnest([0, 1, 2, 3]) AS k FROM ({DAYS}))")
def date_last_periods(spark, sf_dir):
    return days(spark, sf_dir).select("day", F.explode(d.last_periods(F.col("day"), "month", 4)).alias("month")).distinct()


@query(f"SELECT o_orderkey, later >= day AND later - day <= 30 AS valid FROM ({DAYS})")
def date_valid_range(spark, sf_dir):
    return days(spark, sf_dir).select("o_orderkey", ((F.col("later") >= F.col("day")) & (F.datediff("later", "day") <= 30)).alias("valid"))
