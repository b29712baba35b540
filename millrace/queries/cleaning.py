"""Cleaning, normalisation and mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.expressions import parse
from millrace.operators import clean as c
from millrace.operators import mapping as m
from millrace.operators import normalize as n
from millrace.operators.aggregate import bracketed_percentiles
from millrace.queries.registry import query
from millrace.session import table

# Both engines read this: customers with untidy names.
UNTIDY = """CASE WHEN c_custkey % 7 = 0 THEN '  ' || lower(c_name) || '   x ' WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN NULL
 WHEN c_custkey % 17 = 0 THEN ' ' WHEN c_custkey % 5 = 0 THEN 'o''neil mc-donald 3rd' ELSE c_name END"""
U = f"(SELECT c_custkey, {UNTIDY} AS name, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey FROM customer)"


def untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{UNTIDY} AS name", "c_mktsegment AS segment", "c_acctbal AS balance", "c_nationkey")


@query(f"""SELECT c_custkey, trim(regexp_replace(CASE WHEN coalesce(name, 'N/A') = '' THEN 'EMPTY' ELSE coalesce(name, 'N/A') END, '\\s+', ' ', 'g')) AS name FROM {U}""")
def clean_generic(spark, sf_dir):
    return c.clean(untidy(spark, sf_dir).select("c_custkey", "name"), c.CleanConfig(null_replacement="N/A", empty_replacement="EMPTY"))


@query(f"SELECT c_custkey, translate(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), '#-', '') AS name FROM {U}")
def clean_case_and_characters(spark, sf_dir):
    return c.clean(untidy(spark, sf_dir).select("c_custkey", "name"), c.CleanConfig(remove_characters="#-", case="lower"))


@query("""SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_name || '''s ' || lower(c_mktsegment) || '-' || c_custkey || c_mktsegment, '[a-zA-Z]+|[^a-zA-Z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS titled, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS segment FROM customer""")
def clean_title(spark, sf_dir):
    mixed = F.concat("c_name", F.lit("'s "), F.lower("c_mktsegment"), F.lit("-"), "c_custkey", "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", text.title(mixed).alias("titled"), text.title(F.col("c_mktsegment")).alias("segment"))


@query(f"""SELECT c_custkey, upper(replace(trim(name), 'Customer', 'Client')) AS name, lower(segment) AS segment,
  CASE WHEN balance IS NULL OR balance = 0 THEN 1.0 ELSE round_even(balance, 1) END AS balance FROM {U}""")
def clean_field_rules(spark, sf_dir):
    rules = {"name": [{"type": "trim"}, {"type": "replace", "old": "Customer", "new": "Client"}, {"type": "uppercase"}], "segment": [{"type": "lowercase"}], "balance": [{"type": "round", "digits": 1}, {"type": "default_if_empty", "value": 1.0}]}
    return c.clean(untidy(spark, sf_dir).select("c_custkey", "name", "segment", "balance"), c.CleanConfig(fields=rules))


@query(f"""SELECT c_custkey, coalesce(translate(name, 'aeiou', ''), 'none') AS name, CASE WHEN trim(segment) = '' THEN '?' ELSE regexp_replace(substr(segment, 1, 5), '[AEIOU]', '_', 'g') END AS segment FROM {U}""")
def clean_remove_and_default(spark, sf_dir):
    rules = {"name": [{"type": "remove_chars", "value": "aeiou"}, {"type": "default_if_null", "value": "none"}], "segment": [{"type": "substring", "length": 5}, {"type": "regex_replace", "pattern": "[AEIOU]", "new": "_"}, {"type": "default_if_empty", "value": "?"}]}
    return c.clean(untidy(spark, sf_dir).select("c_custkey", "name", "segment"), c.CleanConfig(fields=rules))


@query(f"""SELECT c_custkey, round((greatest(0.0, least(1.0, 1.0 - CASE WHEN name IS NULL THEN 0.05 WHEN t = '' THEN 0.02 ELSE 0.0 END
  + CASE WHEN name IS DISTINCT FROM t THEN 0.01 ELSE 0.0 END + CASE WHEN segment <> lower(segment) THEN 0.01 ELSE 0.0 END)))::DOUBLE, 6) AS score
  FROM (SELECT *, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS t FROM {U})""")
def clean_score(spark, sf_dir):
    d = untidy(spark, sf_dir)
    name = text.collapse(text.strip(F.col("name")))
    return d.select("c_custkey", F.round(c.cleaning_score([F.col("name"), F.col("segment")], [name, F.lower("segment")]), 6).alias("score"))


@query("""SELECT page_id, left(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), 500) AS clean FROM pages""")
def clean_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize(F.col("html"), 500).alias("clean"))


@query("""SELECT p_partkey, CASE WHEN p_name ~ '^[A-Za-z .''-]+$' AND contains(trim(p_name), ' ') THEN 'named' ELSE 'other' END AS kind FROM part""")
def clean_name_case(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", "p_name", c.name_case(F.col("p_name")).alias("cased"))
    return d.select("p_partkey", F.when((F.col("cased") == text.title(F.col("p_name"))) & F.col("p_name").rlike(r"^[A-Za-z .'\-]+$") & F.trim("p_name").contains(" "), "named").otherwise("other").alias("kind"))


GENDERS = "CASE c_custkey % 6 WHEN 0 THEN ' Male' WHEN 1 THEN 'perempuan' WHEN 2 THEN 'L' WHEN 3 THEN 'unknown' WHEN 4 THEN NULL ELSE 'Woman ' END"
COUNTRIES = "CASE c_custkey % 5 WHEN 0 THEN 'Indonesia' WHEN 1 THEN 'usa' WHEN 2 THEN ' SG ' WHEN 3 THEN 'France' ELSE 'th' END"


@query(f"""SELECT c_custkey,
  coalesce(MAP {{'male':'M','l':'M','woman':'F','perempuan':'F'}}[lower(trim({GENDERS}))], upper(trim({GENDERS}))) AS gender,
  coalesce(MAP {{'indonesia':'ID','usa':'US','sg':'SG','th':'TH'}}[lower(trim({COUNTRIES}))], upper(trim({COUNTRIES}))) AS country FROM customer""")
def norm_codes(spark, sf_dir):
    d = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{GENDERS} AS gender", f"{COUNTRIES} AS country")
    return d.select("c_custkey", n.code_of(F.col("gender"), "gender").alias("gender"), n.code_of(F.col("country"), "countries").alias("country"))


PHONES = "CASE s_suppkey % 4 WHEN 0 THEN '0812-' || s_suppkey WHEN 1 THEN '+62 (21) ' || s_suppkey WHEN 2 THEN '62 ' || s_suppkey ELSE '812 00 ' || s_suppkey END"


@query(f"""SELECT s_suppkey, CASE WHEN starts_with(p, '+62') OR starts_with(p, '62') OR starts_with(p, '0') THEN p ELSE '+62' || ltrim(p, '0') END AS phone
  FROM (SELECT s_suppkey, regexp_replace({PHONES}, '[ ()-]', '', 'g') AS p FROM supplier)""")
def norm_phone(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{PHONES} AS phone").select("s_suppkey", n.phone(F.col("phone")).alias("phone"))


@query("""SELECT s_suppkey, 'Jalan Main Street ' || s_suppkey AS address, CASE WHEN s_suppkey % 2 = 0 THEN 'pt' ELSE 'acme' END AS kind FROM supplier""")
def norm_address_and_business(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'jl  main ST ' || s_suppkey AS a", "CASE WHEN s_suppkey % 2 = 0 THEN 'PT Acme' ELSE ' Acme' END AS b")
    return d.select("s_suppkey", n.address(F.col("a")).alias("address"), n.business_type(F.col("b")).alias("kind"))


@query("""SELECT p_partkey, lower(trim(p_brand)) AS brand, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'medium' ELSE 'OTHER' END AS size_class,
  CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'metal' WHEN contains(lower(p_type), 'brass') THEN 'alloy' ELSE 'OTHER' END AS material FROM part""")
def norm_categories(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    return d.select("p_partkey", n.standard(F.col("p_brand")).alias("brand"), n.category_by_range(F.col("p_size"), {"small": (1, 10), "medium": (10, 30)}).alias("size_class"), n.category_by_words(F.col("p_type"), {"metal": ["STEEL", "tin"], "alloy": ["Brass"]}).alias("material"))


@query("""SELECT c_custkey, coalesce(MAP {'building':'1','machinery':'2'}[lower(c_mktsegment)], c_mktsegment) AS label, (c_mktsegment = 'BUILDING')::INT AS seg_BUILDING, (c_mktsegment = 'MACHINERY')::INT AS seg_MACHINERY FROM customer""")
def norm_encodings(spark, sf_dir):
    seg = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", n.label_encode(seg, {"BUILDING": 1, "machinery": 2}).alias("label"), *n.one_hot(seg, "seg", ["BUILDING", "MACHINERY"]))


@query("""SELECT c_custkey, round((c_acctbal + 1000) / 11000 * 100, 6) AS scaled, round_even((c_acctbal - 4500.0) / 3000.0, 2) AS z, round((c_acctbal - q2) / (q3 - q1), 6) AS robust
  FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) q1, quantile_cont(c_acctbal, 0.5) q2, quantile_cont(c_acctbal, 0.75) q3 FROM customer)""")
def norm_scales(spark, sf_dir):
    d = table(spark, sf_dir, "customer")
    q = bracketed_percentiles(d, [], "c_acctbal", [0.25, 0.5, 0.75]).withColumnRenamed("percentiles", "q")
    b = F.col("c_acctbal")
    # the bounds are one row
    return d.join(F.broadcast(q)).select("c_custkey", F.round((b + 1000) / 11000 * 100, 6).alias("scaled"), n.z_score(b, 4500.0, 3000.0).alias("z"), F.round(n.robust_scale(b, F.col("q")[1], F.col("q")[0], F.col("q")[2]), 6).alias("robust"))


@query("""SELECT c_custkey, round_even((c_acctbal + 1000.0) / 11000.0, 2) AS scaled FROM customer""")
def norm_min_max(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", n.min_max(F.col("c_acctbal"), -1000, 10000).alias("scaled"))


@query("""SELECT c_custkey, coalesce(n_name, 'nowhere') AS nation FROM customer LEFT JOIN nation ON c_nationkey + 5 = n_nationkey""")
def norm_lookup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("key", F.col("c_nationkey") + 5)  # the last five have no nation
    return n.lookup(customers, "key", table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "nation", "nowhere").select("c_custkey", "nation")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'normal' END AS tier, CASE WHEN o_totalprice > 200000 THEN round(o_totalprice * 0.9, 4) ELSE o_totalprice END AS price FROM orders""")
def norm_business_rules(spark, sf_dir):
    rules = [
        {"priority": 2, "condition": "$tier == 'large'", "field": "price", "calculate": "$price * 0.9"},
        {"priority": 1, "condition": "$o_totalprice > 200000", "field": "tier", "set": "large"},
        {"priority": 0, "condition": "$o_totalprice is not None", "field": "price", "copy": "o_totalprice"},
        {"priority": 0, "condition": "True", "field": "tier", "set": "normal"},
    ]
    d = n.business_rules(table(spark, sf_dir, "orders"), rules)
    return d.select("o_orderkey", "tier", F.when(F.col("tier") == "large", F.round("price", 4)).otherwise(F.col("price")).alias("price"))


@query(f"""SELECT c_custkey, nullif(concat_ws('-', nullif(name, ''), nullif(segment, '')), '') AS joined, round(balance / nullif(c_nationkey, 0), 6) AS ratio,
  CASE WHEN balance > 0 THEN 'credit' ELSE 'debt' END AS side, name AS _original_name FROM {U}""")
def norm_derived(spark, sf_dir):
    d = n.keep_originals(untidy(spark, sf_dir), ["name"])
    return d.select("c_custkey", n.concatenated([F.col("name"), F.col("segment")], "-").alias("joined"), F.round(n.calculated("$balance / $c_nationkey"), 6).alias("ratio"), n.conditional("$balance > 0", F.lit("credit"), F.lit("debt")).alias("side"), "_original_name")


@query(f"""SELECT c_custkey, round(0.6 * (0.6 * ((CASE WHEN trim(name) <> '' THEN 1 ELSE 0 END + 1) / 2.0) + 0.4 * (1 - CASE WHEN balance < 0 THEN 0.1 ELSE 0 END)) + 0.4 * (0.7 + 0.3 * CASE WHEN segment <> lower(segment) THEN 1 ELSE 0 END), 6) AS score FROM {U}""")
def norm_score(spark, sf_dir):
    changed = F.when(F.col("segment") != F.lower("segment"), 1).otherwise(0)
    return untidy(spark, sf_dir).select("c_custkey", F.round(n.normalization_score([F.col("name"), F.col("segment")], [F.col("balance") < 0], changed), 6).alias("score"))


@query(f"""SELECT c_custkey AS id, upper(name) || '!' AS shout, try_cast(segment AS BIGINT) AS number, 'v1' AS version, coalesce(n_name, 'none') AS nation,
  list_filter([CASE WHEN segment IS NOT NULL THEN 'number: not a integer' END, CASE WHEN name IS NULL OR upper(name) || '!' = '' THEN 'shout: required' END], lambda x: x IS NOT NULL) AS _errors
  FROM {U} LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1""")
def map_fields(spark, sf_dir):
    maps = [
        m.Mapping("id", source="c_custkey"),
        m.Mapping("shout", "calculated", expression="upper($name)", required=False),
        m.Mapping("number", source="segment", data_type="integer"),
        m.Mapping("version", "constant", expression="v1"),
        m.Mapping("nation", "lookup", source="c_nationkey", table="nation", key="n_nationkey", value="n_name", default="none"),
        m.Mapping("raw", source="name"),
    ]
    out = m.apply_mappings(untidy(spark, sf_dir), maps, {"nation": table(spark, sf_dir, "nation").where("n_regionkey = 1")})
    out = out.withColumn("shout", F.concat("shout", F.lit("!")))
    missing = F.when(F.col("shout").isNull(), F.array(F.lit("shout: required"))).otherwise(F.array().cast("array<string>"))
    return out.select("id", "shout", "number", "version", "nation", F.concat("_errors", missing).alias("_errors"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (name IS NOT NULL AND name <> '') AS successful, count(*) FILTER (name IS NULL OR name = '') AS failed, round(100.0 * count(*) FILTER (name IS NOT NULL AND name <> '') / count(*), 6) AS success_rate FROM {U}""")
def map_required_summary(spark, sf_dir):
    return m.summary(m.apply_mappings(untidy(spark, sf_dir), [m.Mapping("name", source="name", required=True)]))


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, 'batch-1' AS batch, round(l_tax * 100, 6) AS l_tax, lower(l_returnflag) AS flag,
  CASE WHEN l_quantity < 45 THEN [] ELSE ['too many'] END AS _errors FROM lineitem""")
def map_rules(spark, sf_dir):
    rules = [
        {"type": "calculation", "target": "net", "expression": "$l_extendedprice * (1 - $l_discount)"},
        {"type": "enrichment", "add": {"batch": "batch-1"}},
        {"type": "multiply", "field": "l_tax", "factor": 100},
        {"type": "lowercase", "field": "l_returnflag"},
        {"type": "mapping", "rename": {"l_returnflag": "flag"}, "priority": 5},
        {"type": "validation", "expression": "$l_quantity < 45", "message": "too many"},
    ]
    d = m.apply_rules(table(spark, sf_dir, "lineitem"), rules)
    return d.select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"), "batch", F.round("l_tax", 6).alias("l_tax"), "flag", "_errors")


@query("""SELECT p_partkey, length(p_name)::INT AS n, upper(p_brand) AS brand, round(p_retailprice / nullif(p_size, 0), 6) AS unit, p_size IN (1, 2, 3) AND NOT (p_retailprice > 1000) AS chosen,
  CASE WHEN p_size >= 25 AND p_size < 40 THEN 'mid' ELSE 'edge' END AS place FROM part""")
def map_expressions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", parse("len($p_name)").alias("n"), parse("upper($p_brand)").alias("brand"), F.round(parse("$p_retailprice / $p_size"), 6).alias("unit"), parse("$p_size in [1, 2, 3] and not ($p_retailprice > 1000)").alias("chosen"), parse("'mid' if 25 <= $p_size < 40 else 'edge'").alias("place"))


@query(f"""SELECT c_custkey, name IS NULL OR name = '' AS failed, CASE WHEN name IS NULL OR name = '' THEN 'name: required' END AS reason FROM {U}""")
def map_required_split(spark, sf_dir):
    mapped = m.apply_mappings(untidy(spark, sf_dir), [m.Mapping("c_custkey", source="c_custkey"), m.Mapping("name", source="name", required=True)])
    good, bad = m.split_failed(mapped)
    return good.select("c_custkey", F.lit(False).alias("failed"), F.lit(None).cast("string").alias("reason")).unionAll(bad.select("c_custkey", F.lit(True), F.array_join("_errors", "; ")))


@query("""SELECT p_partkey, p_name AS input_p_name, upper(p_name) AS name, p_retailprice * 2 AS double_price, CASE WHEN p_size > 10 THEN ['too large'] ELSE [] END AS _errors FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 10)""")
def map_dry_run(spark, sf_dir):
    maps = [m.Mapping("p_partkey", source="p_partkey"), m.Mapping("name", "calculated", expression="upper($p_name)"), m.Mapping("double_price", "calculated", expression="$p_retailprice * 2"), m.Mapping("p_size", source="p_size")]
    rules = [{"type": "validation", "expression": "$p_size <= 10", "message": "too large"}]
    tried = m.dry_run(table(spark, sf_dir, "part").orderBy("p_partkey"), maps, rules)
    return tried.select("output.p_partkey", F.col("input.p_name").alias("input_p_name"), "output.name", "output.double_price", "_errors")
