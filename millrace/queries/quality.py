"""Formats, validation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.formats import FORMATS, PATTERNS, email_parts, ip_properties, is_json, parsed_date, parsed_datetime, url_parts
from millrace.operators import quality as q
from millrace.operators import validate as v
from millrace.operators.store import History
from millrace.queries.registry import query
from millrace.session import shared_path, table

# Both engines read these: texts of every format, good and bad.
SAMPLES = {
    "email": "CASE c_custkey % 4 WHEN 0 THEN 'user' || c_custkey || '@mail.example.com' WHEN 1 THEN 'user@' WHEN 2 THEN c_name ELSE 'a.b+c@x.io' END",
    "phone": "CASE c_custkey % 4 WHEN 0 THEN '+62 812-3456-' || c_custkey WHEN 1 THEN '(021) 55' WHEN 2 THEN '12345678' ELSE 'call me' END",
    "url": "CASE c_custkey % 3 WHEN 0 THEN 'https://example.com:80/a/b?x=1#y' WHEN 1 THEN 'ftp://x' ELSE 'http://h' || c_custkey END",
    "ipv4": "CASE c_custkey % 5 WHEN 0 THEN '10.0.0.' || (c_custkey % 300) WHEN 1 THEN '1.2.3' WHEN 2 THEN '01.1.1.1' WHEN 3 THEN 'a.b.c.d' ELSE '255.255.255.255' END",
    "ipv6": "CASE c_custkey % 2 WHEN 0 THEN '2001:db8:0:0:0:0:0:' || (c_custkey % 10) ELSE '2001:db8::1' END",
    "uuid": "CASE c_custkey % 3 WHEN 0 THEN '123e4567-e89b-12d3-a456-426614174000' WHEN 1 THEN '123e4567-e89b-12d3-a456-426614174000-x' ELSE '123e4567' END",
    "iban": "CASE c_custkey % 4 WHEN 0 THEN 'de89 3704 0044 0532 0130 00' WHEN 1 THEN 'DE8937040044' WHEN 2 THEN '89DE370400440532' ELSE 'GB82WEST12345698765432' END",
    "postal_code": "CASE c_custkey % 3 WHEN 0 THEN '12345' WHEN 1 THEN '1234' ELSE '12345-6789' END",
    "social_security": "CASE c_custkey % 2 WHEN 0 THEN '123-45-6789' ELSE '123456789' END",
    "passport": "CASE c_custkey % 3 WHEN 0 THEN 'a1234567' WHEN 1 THEN '12345678' ELSE 'B12' END",
    "license_plate": "CASE c_custkey % 3 WHEN 0 THEN 'b 1234 xyz' WHEN 1 THEN 'B1234XYZ' ELSE 'AB 1 C' END",
}


def _sampled(spark, sf_dir, *names):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", *(f"{SAMPLES[n]} AS {n}" for n in names))


def _formats(spark, sf_dir, *names):
    d = _sampled(spark, sf_dir, *names)
    return d.select("c_custkey", *(FORMATS[n](F.col(n)).alias(n) for n in names))


@query(f"""SELECT c_custkey, regexp_matches({SAMPLES['email']}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') AS email, regexp_matches(regexp_replace({SAMPLES['phone']}, '[\\s()-]', '', 'g'), '^\\+?[0-9]{{8,15}}$') AS phone,
  regexp_matches({SAMPLES['url']}, '^https?://[-a-zA-Z0-9_.]+') AS url FROM customer""")
def fmt_contact(spark, sf_dir):
    return _formats(spark, sf_dir, "email", "phone", "url")


@query(f"""SELECT c_custkey, coalesce(len(string_split({SAMPLES['ipv4']}, '.')) = 4 AND len(list_filter(string_split({SAMPLES['ipv4']}, '.'), lambda p: try_cast(p AS INT) BETWEEN 0 AND 255)) = 4, false) AS ipv4,
  regexp_matches({SAMPLES['ipv6']}, '^([0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}$') AS ipv6, regexp_matches({SAMPLES['uuid']}, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[1-5][0-9a-fA-F]{{3}}-[89abAB][0-9a-fA-F]{{3}}-[0-9a-fA-F]{{12}}') AS uuid FROM customer""")
def fmt_network(spark, sf_dir):
    return _formats(spark, sf_dir, "ipv4", "ipv6", "uuid")


@query("""SELECT c_custkey, c_custkey % 4 IN (0, 3) AS iban, c_custkey % 3 <> 1 AS postal_code, c_custkey % 2 = 0 AS social_security, c_custkey % 3 = 0 AS passport, c_custkey % 3 <> 1 AS license_plate FROM customer""")
def fmt_documents(spark, sf_dir):
    return _formats(spark, sf_dir, "iban", "postal_code", "social_security", "passport", "license_plate")


@query("""SELECT k AS c_custkey, length(d) BETWEEN 13 AND 19 AND coalesce(list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN x[length(d) - i]::INT ELSE (2 * x[length(d) - i]::INT) // 10 + (2 * x[length(d) - i]::INT) % 10 END)) % 10 = 0, false) AS credit_card
  FROM (SELECT *, string_split(d, '') AS x FROM (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 2 THEN '1234' ELSE '45320151128' || (10000 + c_custkey % 90000) END AS d FROM customer))""")
def fmt_credit_card(spark, sf_dir):
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 2 THEN '12 34' ELSE '4532-0151 128' || (10000 + c_custkey % 90000) END AS d")
    return d.select("c_custkey", FORMATS["credit_card"](F.col("d")).alias("credit_card"))


DATES = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN '2024-02-30' ELSE 'soon' END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderdate::DATE END AS day, CASE WHEN o_orderkey % 4 = 0 THEN date_trunc('day', o_orderdate) END AS moment FROM orders")
def fmt_dates(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 2 THEN '2024-02-30' ELSE 'soon' END AS t")
    moment = parsed_datetime(F.when(F.col("o_orderkey") % 4 == 0, F.concat("t", F.lit(" 00:00:00"))))
    return d.select("o_orderkey", parsed_date(F.col("t")).alias("day"), moment.cast("timestamp_ntz").alias("moment"))


@query("""SELECT c_custkey, regexp_matches('user_' || c_custkey, '^[a-zA-Z0-9_]{3,20}$') AS username, regexp_matches(lower(c_mktsegment) || '-' || c_custkey, '^[a-z0-9]+(-[a-z0-9]+)*$') AS slug,
  regexp_matches('#' || lpad((c_custkey % 4096)::VARCHAR, 3 + (c_custkey % 2)::INT, 'f'), '^#([0-9a-fA-F]{3}){1,2}$') AS hex_color, false AS password_strong FROM customer""")
def fmt_patterns(spark, sf_dir):
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", "'user_' || c_custkey AS username", "lower(c_mktsegment) || '-' || c_custkey AS slug", "'#' || lpad(cast(c_custkey % 4096 AS string), cast(3 + c_custkey % 2 AS int), 'f') AS hex_color", "c_name AS password_strong")
    return d.select("c_custkey", *(F.col(n).rlike(PATTERNS[n]).alias(n) for n in ("username", "slug", "hex_color", "password_strong")))


@query("""SELECT page_id, nullif(regexp_extract(url, '^([a-z]+)://', 1), '') AS protocol, nullif(regexp_extract(url, '://([^/:?#]+)', 1), '') AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path,
  CASE WHEN regexp_matches(url, '^[^#]*\\?') THEN regexp_extract(url, '\\?([^#]*)', 1) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages""")
def fmt_url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


# Addresses spread over all networks; the SQL judges them as numbers.
_FIRST = "array(0, 8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 250)"
IPS = """SELECT c_custkey, CASE c_custkey % 5 WHEN 4 THEN {six} ELSE {first} || '.' || {second} || '.' || c_custkey % 4 || '.' || c_custkey % 256 END AS ip FROM customer"""
_SECOND = "CASE c_custkey % 3 WHEN 0 THEN 168 WHEN 1 THEN c_custkey % 256 ELSE CASE c_custkey % 7 WHEN 0 THEN 254 WHEN 1 THEN 18 WHEN 2 THEN 51 WHEN 3 THEN 64 ELSE 0 END END"
_SIX = "array('fe80::', '2001:db8::', '2002::', 'fc00::1:', '2606:4700::', 'ff02::', '::ffff:0:')"
SPARK_IPS = IPS.format(first=f"element_at({_FIRST}, cast(1 + c_custkey % 12 AS int))", second=_SECOND, six=f"element_at({_SIX}, cast(1 + c_custkey % 7 AS int)) || lower(hex(c_custkey % 65536))")
DUCK_IPS = IPS.format(first=f"{_FIRST.replace('array(', '[').replace(')', ']')}[1 + c_custkey % 12]", second=_SECOND, six=f"{_SIX.replace('array(', '[').replace(')', ']')}[1 + c_custkey % 7] || lower(printf('%X', c_custkey % 65536))")


@query(f"""WITH a AS (SELECT c_custkey, ip, CASE WHEN contains(ip, '.') THEN list_reduce(list_transform(string_split(ip, '.'), lambda x: x::BIGINT), lambda x, y: x * 256 + y) END AS v FROM ({DUCK_IPS})),
  b AS (SELECT *, v < 16777216 OR v // 16777216 IN (10, 127) OR v // 65536 IN (43518, 49320) OR v // 1048576 = 2753 OR v // 256 IN (12582912, 12582914, 12989284, 13303921) OR v // 131072 = 25353 OR v >= 4026531840 AS p FROM a),
  c AS (SELECT *, CASE WHEN v IS NOT NULL THEN p AND v NOT IN (3221225481, 3221225482) ELSE NOT (starts_with(ip, '2606:') OR starts_with(ip, 'ff')) END AS q FROM b)
  SELECT c_custkey, CASE WHEN v IS NULL THEN 6 ELSE 4 END AS version, q AS is_private, NOT q AND coalesce(v // 4194304 <> 401, true) AS is_global, coalesce(v // 16777216 = 127, false) AS is_loopback,
  coalesce(v // 268435456 = 14, starts_with(ip, 'ff')) AS is_multicast, coalesce(v // 65536 = 43518, starts_with(ip, 'fe80')) AS is_link_local, coalesce(v // 268435456 = 15, starts_with(ip, '::')) AS is_reserved FROM c""")
def fmt_ip_properties(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(SPARK_IPS).select("c_custkey", ip_properties(F.col("ip")).alias("p")).select("c_custkey", "p.*").drop("exploded")


@query("""SELECT event_id, json_valid(j) AS valid_json, nullif(regexp_extract(mail, '^([^@]+)@[^@]+\\.[a-zA-Z]{2,}$', 1), '') AS local, nullif(lower(regexp_extract(mail, '^[^@]+@([^@]+\\.[a-zA-Z]{2,})$', 1)), '') AS domain
  FROM (SELECT event_id, CASE WHEN event_id % 3 = 1 THEN substr(props, 2) ELSE props END AS j, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id || '@Mail.Example.com' ELSE 'u' || user_id END AS mail FROM events)""")
def fmt_json_and_email(spark, sf_dir):
    d = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 3 = 1 THEN substr(props, 2) ELSE props END AS j", "CASE WHEN event_id % 2 = 0 THEN 'u' || user_id || '@Mail.Example.com' ELSE 'u' || user_id END AS mail")
    return d.select("event_id", is_json(F.col("j")).alias("valid_json"), email_parts(F.col("mail")).alias("m")).select("event_id", "valid_json", "m.*")


@query("SELECT 'c_balance' AS missing, 'c_acctbal, c_custkey' AS extra")
def valid_header(spark, sf_dir):
    missing, extra = v.header_check(table(spark, sf_dir, "customer").columns, ["C_NAME", "c_balance", "c_nationkey ", "c_mktsegment"])
    return spark.createDataFrame([(", ".join(missing), ", ".join(extra))], "missing string, extra string")


@query("""SELECT "row", field, rule, value FROM (SELECT o_orderkey + 2 AS row, 0 AS pos, 'o_orderstatus' AS field, 'in' AS rule, o_orderstatus AS value FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey + 2, 1, 'o_orderpriority', 'pattern', o_orderpriority FROM orders WHERE o_orderpriority > '3') ORDER BY "row", pos LIMIT 100""")
def valid_violation_rows(spark, sf_dir):
    rules = [v.Rule("o_orderstatus", "in", {"values": ["O", "F"]}), v.Rule("o_orderpriority", "pattern", {"pattern": "[12]-"})]
    d = table(spark, sf_dir, "orders").withColumn("n", F.col("o_orderkey") + 1)
    return v.violation_rows(d, rules, "n")


RULES = [
    v.Rule("c_name", "required", severity="critical"),
    v.Rule("c_acctbal", "range", {"min": 0, "max": 9000}, severity="error", fix=True),
    v.Rule("c_mktsegment", "length", {"max": 9}, severity="warning"),
    v.Rule("c_name", "pattern", {"pattern": "Customer"}, severity="warning"),
    v.Rule("c_mktsegment", "in", {"values": ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"]}),
]
BAD = """(SELECT *, NOT (c_acctbal BETWEEN 0 AND 9000) AS b1, length(c_mktsegment) > 9 AS b2 FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS c_name, c_acctbal, c_mktsegment FROM customer))"""


@query(f"""SELECT c_custkey, (c_name IS NULL)::INT + b1::INT + b2::INT + coalesce(NOT starts_with(c_name, 'Customer'), false)::INT AS n_errors,
  CASE WHEN c_name IS NULL THEN 'FAILED' WHEN b1 OR b2 OR NOT starts_with(c_name, 'Customer') THEN 'WARNING' ELSE 'SUCCESS' END AS status, greatest(0.0, least(9000.0, c_acctbal)) AS c_acctbal FROM {BAD}""")
def valid_rules(spark, sf_dir):
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS c_name", "c_acctbal", "c_mktsegment")
    return v.validate(d, RULES, "c_custkey").select("c_custkey", F.size("_errors").alias("n_errors"), F.col("_status").alias("status"), "c_acctbal")


@query(f"""SELECT c_custkey, round(least(1.0, (5 - (c_name IS NULL)::INT - b1::INT - b2::INT - coalesce(NOT starts_with(c_name, 'Customer'), false)::INT) / 5.0 * CASE WHEN c_name IS NULL THEN 0.5 ELSE 1 END * CASE WHEN b1 THEN 0.8 ELSE 1 END
  * CASE WHEN b2 OR coalesce(NOT starts_with(c_name, 'Customer'), false) THEN 0.95 ELSE 1 END + CASE WHEN b1 THEN 0.05 ELSE 0 END), 6) AS score FROM {BAD}""")
def valid_score(spark, sf_dir):
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS c_name", "c_acctbal", "c_mktsegment")
    return v.validate(d, RULES, "c_custkey").select("c_custkey", F.round("_score", 6).alias("score"))


@query("""SELECT o_orderkey, n > 1 AS repeated, r_regionkey IS NULL AS unknown FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_custkey FROM orders)
  LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN region ON r_regionkey >= 0 AND c_custkey IS NOT NULL AND r_regionkey = 0""")
def valid_unique_and_referential(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    rules = [v.Rule("o_custkey", "uniqueness"), v.Rule("o_custkey", "referential")]
    d = v.validate(table(spark, sf_dir, "orders"), rules, "o_orderkey", {"o_custkey": (known, "c_custkey")})
    has = lambda k: F.exists("_errors", lambda e: e.rule == k)
    return d.select("o_orderkey", has("uniqueness").alias("repeated"), has("referential").alias("unknown"))


_PAST = "o_orderdate < DATE '1997-01-01'"


@query(f"""SELECT o_orderkey, NOT (o_orderkey > o_first OR EXISTS (SELECT 1 FROM orders p WHERE p.{_PAST} AND p.o_custkey = b.o_custkey AND p.o_orderpriority = b.o_orderpriority)) AS is_unique
  FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS o_first FROM orders WHERE NOT {_PAST}) b""")
def valid_unique_over_loads(spark, sf_dir):
    # two loads of the past, then a batch that is held to both
    orders, columns = table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"]
    history = History(spark, shared_path(spark), buckets=8)
    for year in ("1995", "1997"):
        history.add(orders.where(f"o_orderdate < DATE '{year}-01-01'" + (" AND o_orderdate >= DATE '1995-01-01'" if year == "1997" else "")), columns)
    return history.check(orders.where(f"NOT ({_PAST})"), columns, "o_orderkey").select("o_orderkey", "is_unique")


@query(f"""SELECT count(*) AS checked, count(*) FILTER (n > 1 OR o_custkey IN (SELECT o_custkey FROM orders WHERE {_PAST} AND o_totalprice > 300000)) AS failed FROM (SELECT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE NOT {_PAST} AND o_totalprice > 300000)""")
def dq_global_uniqueness(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    history = History(spark, shared_path(spark), buckets=8)
    history.add(dear.where(_PAST), ["o_custkey"])
    rule = q.QualityRule("customer", "uniqueness", "o_custkey", {"scope": "global", "history": history})
    return q.scorecard(dear.where(f"NOT ({_PAST})"), [rule]).select("checked", "failed")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'range' WHEN NOT (l_extendedprice * (1 - l_discount) > 1000) THEN 'cross_field' ELSE '' END AS first_error FROM lineitem""")
def valid_cross_field(spark, sf_dir):
    rules = [v.Rule("l_quantity", "range", {"max": 40}), v.Rule("", "cross_field", {"expression": "$l_extendedprice * (1 - $l_discount) > 1000"})]
    d = v.validate(table(spark, sf_dir, "lineitem"), rules, "l_orderkey", stop_on_first=True)
    return d.select("l_orderkey", "l_linenumber", F.coalesce(F.get("_errors", F.lit(0))["rule"], F.lit("")).alias("first_error"))


@query("""SELECT t, try_cast(t AS BIGINT) IS NOT NULL AND NOT contains(t, '.') AS as_integer, try_cast(t AS DOUBLE) IS NOT NULL AS as_float FROM (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_brand ELSE '-' || p_size END AS t FROM part)""")
def valid_types(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("CASE p_partkey % 4 WHEN 0 THEN cast(p_size AS string) WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_brand ELSE '-' || p_size END AS t").distinct()
    d = d.select("t", (F.col("t").try_cast("bigint").isNotNull() & ~F.col("t").contains(".")).alias("as_integer"), F.col("t").try_cast("double").isNotNull().alias("as_float"))
    return d


@query("""SELECT rejection_reason, count(*) AS n FROM (SELECT concat_ws('; ', CASE WHEN o_totalprice > 300000 THEN 'o_totalprice: range' END, CASE WHEN o_orderstatus = 'P' THEN 'o_orderstatus: in' END) AS rejection_reason FROM orders) WHERE rejection_reason <> '' GROUP BY 1""")
def valid_rejected(spark, sf_dir):
    rules = [v.Rule("o_totalprice", "range", {"max": 300000}, severity="critical"), v.Rule("o_orderstatus", "in", {"values": ["O", "F"]}, severity="critical")]
    _, bad = v.accepted_and_rejected(v.validate(table(spark, sf_dir, "orders"), rules, "o_orderkey"))
    return bad.groupBy("rejection_reason").agg(F.count("*").alias("n"))


QUALITY = [
    q.QualityRule("name_present", "completeness", "c_name"),
    q.QualityRule("balance_in_range", "range", "c_acctbal", {"min": 0, "max": 9000}, severity="warning", threshold=0.5),
    q.QualityRule("name_form", "validity", "c_name", {"pattern": "^Customer#0*[1-9]"}),
    q.QualityRule("segment_unique", "uniqueness", "c_mktsegment", severity="critical"),
    q.QualityRule("building_is_solvent", "consistency", "c_mktsegment", {"equals": "BUILDING", "then_column": "solvent", "then_equals": True}),
    q.QualityRule("rounded", "accuracy", "c_acctbal", {"expression": "round($c_acctbal, 1)", "tolerance": 0.04}),
    q.QualityRule("known_nation", "referential", "c_nationkey"),
    q.QualityRule("own_rule", "custom", "", {"expression": "$c_custkey > 10"}),
]
FAILED = """SELECT count(*) AS checked, count(*) FILTER (c_name IS NULL OR trim(c_name) = '') AS name_present, count(*) FILTER (NOT (c_acctbal BETWEEN 0 AND 9000)) AS balance_in_range, count(*) FILTER (NOT regexp_matches(c_name, '^Customer#0*[1-9]')) AS name_form,
  count(*) FILTER (k > 1) AS segment_unique, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal <= 0) AS building_is_solvent, count(*) FILTER (abs(c_acctbal - round_even(c_acctbal, 1)) > 0.04) AS rounded, count(*) FILTER (c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) AS known_nation, count(*) FILTER (c_custkey <= 10) AS own_rule
  FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS k FROM customer)"""
LONG = f"""(SELECT checked, unnest([struct_pack(r := 'name_present', t := 'COMPLETENESS', s := 'error', h := 0.0, f := name_present), struct_pack(r := 'balance_in_range', t := 'RANGE', s := 'warning', h := 0.5, f := balance_in_range), struct_pack(r := 'name_form', t := 'VALIDITY', s := 'error', h := 0.0, f := name_form),
  struct_pack(r := 'segment_unique', t := 'UNIQUENESS', s := 'critical', h := 0.0, f := segment_unique), struct_pack(r := 'building_is_solvent', t := 'CONSISTENCY', s := 'error', h := 0.0, f := building_is_solvent), struct_pack(r := 'rounded', t := 'ACCURACY', s := 'error', h := 0.0, f := rounded),
  struct_pack(r := 'known_nation', t := 'REFERENTIAL', s := 'error', h := 0.0, f := known_nation), struct_pack(r := 'own_rule', t := 'CUSTOM', s := 'error', h := 0.0, f := own_rule)]) AS x FROM ({FAILED}))"""
CARD = f"(SELECT x.r AS rule_id, x.t AS rule_type, x.s AS severity, checked, checked - x.f AS passed, x.f AS failed, round(100.0 * (checked - x.f) / checked, 6) AS pass_rate, CASE WHEN x.f / checked::DOUBLE > x.h THEN 'FAIL' ELSE 'PASS' END AS result FROM {LONG})"


def _card(spark, sf_dir):
    known = table(spark, sf_dir, "supplier")
    return q.scorecard(table(spark, sf_dir, "customer").withColumn("solvent", F.col("c_acctbal") > 0), QUALITY, {"known_nation": (known, "s_nationkey")})


@query(f"SELECT * FROM {CARD}")
def dq_scorecard(spark, sf_dir):
    return _card(spark, sf_dir)


@query(f"""SELECT sum(checked)::BIGINT AS checked, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed, round(100.0 * sum(passed) / sum(checked), 6) AS score, CASE WHEN 100.0 * sum(passed) / sum(checked) >= 90 THEN 'PASS' ELSE 'FAIL' END AS status,
  count(*) FILTER (result = 'FAIL' AND severity = 'critical') AS critical_failures, count(*) FILTER (result = 'FAIL' AND severity = 'warning') AS warning_failures FROM {CARD}""")
def dq_overall(spark, sf_dir):
    return q.overall(_card(spark, sf_dir))


@query(f"SELECT rule_id, pass_rate FROM {CARD} WHERE pass_rate < 80")
def dq_gate(spark, sf_dir):
    return q.gate(_card(spark, sf_dir)).select("rule_id", "pass_rate")


@query("""SELECT o_orderkey AS record_id, r AS rule_id, v AS value FROM (SELECT o_orderkey, 'price' AS r, printf('%.2f', o_totalprice) AS v FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders WHERE o_orderstatus = 'P')""")
def dq_violations(spark, sf_dir):
    d = table(spark, sf_dir, "orders").withColumn("price", F.format_string("%.2f", "o_totalprice"))
    rules = [q.QualityRule("price", "custom", "price", {"expression": "$o_totalprice <= 250000"}), q.QualityRule("status", "validity", "o_orderstatus", {"pattern": "^[OF]$"})]
    return q.violations(d, rules, "o_orderkey")


@query("""SELECT o_orderkey AS record_id, (o_totalprice > 250000)::INT + (o_orderstatus = 'P')::INT AS errors, 1 - ((o_totalprice > 250000)::INT + (o_orderstatus = 'P')::INT) / 2.0 AS validation_score FROM orders""")
def dq_record_scores(spark, sf_dir):
    rules = [q.QualityRule("price", "range", "o_totalprice", {"max": 250000}), q.QualityRule("status", "validity", "o_orderstatus", {"pattern": "^[OF]$"})]
    return q.record_scores(table(spark, sf_dir, "orders"), rules, "o_orderkey")


CHECKS = "(SELECT event_id, ts, event_type, user_id, 100 AS checked, 100 - event_id % 7 AS passed, event_id % 7 AS failed, CASE WHEN event_id % 7 = 0 THEN 'PASS' WHEN event_id % 7 < 3 THEN 'WARNING' ELSE 'FAIL' END AS result FROM events)"


def checks(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "event_type", "user_id", "cast(100 AS bigint) AS checked", "100 - event_id % 7 AS passed", "event_id % 7 AS failed", "CASE WHEN event_id % 7 = 0 THEN 'PASS' WHEN event_id % 7 < 3 THEN 'WARNING' ELSE 'FAIL' END AS result")


@query(f"SELECT date_trunc('week', ts) AS period, sum(checked)::BIGINT AS checked, sum(passed)::BIGINT AS passed, round(100.0 * sum(passed) / sum(checked), 6) AS pass_rate FROM {CHECKS} GROUP BY 1")
def dq_trend(spark, sf_dir):
    return q.trend(checks(spark, sf_dir), "ts", "week").withColumn("period", F.col("period").cast("timestamp_ntz"))


@query(f"SELECT round(avg(CASE result WHEN 'PASS' THEN 1.0 WHEN 'WARNING' THEN 0.5 ELSE 0 END), 6) AS quality_score FROM {CHECKS}")
def dq_weighted_score(spark, sf_dir):
    return q.weighted_score(checks(spark, sf_dir))


_RULES_SQL = "(SELECT c_custkey AS rule_id, c_mktsegment AS rule_type, CASE WHEN c_acctbal > 5000 THEN 'critical' ELSE 'error' END AS severity FROM customer WHERE c_acctbal > 0)"
_CHECKED = f"(SELECT event_id AS check_id, user_id AS rule_id, ts AS checked_at, checked, passed, failed, result FROM {CHECKS})"


def _rules(spark, sf_dir):
    kept = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return kept.select(F.col("c_custkey").alias("rule_id"), F.col("c_mktsegment").alias("rule_type"), F.when(F.col("c_acctbal") > 5000, "critical").otherwise("error").alias("severity"))


def _checked(spark, sf_dir):
    return checks(spark, sf_dir).select(F.col("event_id").alias("check_id"), F.col("user_id").alias("rule_id"), F.col("ts").alias("checked_at"), "checked", "passed", "failed", "result")


@query(f"""SELECT rule_type, count(*) AS checks, sum(failed)::BIGINT AS failed, round(100.0 * sum(passed) / sum(checked), 6) AS pass_rate FROM {_CHECKED} JOIN {_RULES_SQL} USING (rule_id) WHERE checked_at >= TIMESTAMP '2024-01-10' AND checked_at < TIMESTAMP '2024-01-17' GROUP BY 1""")
def dq_report(spark, sf_dir):
    return q.report(_checked(spark, sf_dir), _rules(spark, sf_dir), "2024-01-10", "2024-01-17")


@query(f"""SELECT check_id, rule_id, rule_type, severity, round(failed / checked::DOUBLE, 6) AS failure_rate FROM {_CHECKED} JOIN {_RULES_SQL} USING (rule_id) WHERE result = 'FAIL' AND severity = 'critical' ORDER BY failed DESC, check_id LIMIT 20 OFFSET 10""")
def dq_alerts(spark, sf_dir):
    return q.alerts(_checked(spark, sf_dir), _rules(spark, sf_dir), ["critical"], 10, 20)


@query(f"""SELECT rule_id, count(*) AS checks, count(*) FILTER (result = 'PASS') AS passed_checks, count(*) FILTER (result <> 'PASS') AS failed_checks, round(100.0 * count(*) FILTER (result = 'PASS') / count(*), 6) AS pass_rate, sum(checked)::BIGINT AS records_checked, sum(passed)::BIGINT AS records_passed,
  round(100.0 * sum(passed) / nullif(sum(checked), 0), 6) AS record_pass_rate, max(checked_at) AS last_used FROM {_CHECKED} WHERE checked_at >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1""")
def dq_rule_usage(spark, sf_dir):
    newest = table(spark, sf_dir, "events").agg(F.max("ts").alias("now")).first()["now"]
    return q.rule_usage(_checked(spark, sf_dir), newest, 30).withColumn("last_used", F.col("last_used").cast("timestamp_ntz"))


@query("""SELECT rule_id, count(*) AS checked, count(*) FILTER (NOT bad) AS passed, count(*) FILTER (bad) AS failed, round(100.0 * count(*) FILTER (NOT bad) / count(*), 6) AS pass_rate
  FROM (SELECT unnest([{'rule_id': 'k', 'bad': coalesce(json_extract_string(props, '$.k')::DOUBLE > 50, false)}, {'rule_id': 'who', 'bad': user_id IS NULL}], recursive := true) FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def dq_entities(spark, sf_dir):
    rules = [q.QualityRule("k", "range", "k", {"max": 50}), q.QualityRule("who", "completeness", "user_id")]
    d = table(spark, sf_dir, "events").withColumnRenamed("event_type", "entity_type")
    return q.entity_scorecard(d, "entity_type", "purchase", "props", "k double", rules).select("rule_id", "checked", "passed", "failed", "pass_rate")


@query("""SELECT o_custkey AS key, max(o_orderkey) AS last_order FROM orders GROUP BY 1""")
def dq_latest_check(spark, sf_dir):
    return q.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("last_order"))


@query("""SELECT user_id, count(*) FILTER (ts < (SELECT max(ts) FROM events) - INTERVAL 30 DAY) AS stale, count(*) AS n FROM events GROUP BY 1""")
def dq_timeliness(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    newest = d.agg((F.max("ts") - F.expr("INTERVAL 30 DAYS")).alias("since"))  # one row
    rule = q.QualityRule("fresh", "timeliness", "ts", {"not_before": "since"})
    return d.join(F.broadcast(newest)).groupBy("user_id").agg(F.count_if(q.violation(rule)).alias("stale"), F.count("*").alias("n"))
