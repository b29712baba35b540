"""Profiles and checks of arriving records."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ingest as i
from millrace.operators import profile as p
from millrace.queries.registry import query
from millrace.session import table

# Both engines read these: texts of every type that the profile tells.
MIXED = """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'No' END AS solvent,
  CASE WHEN c_custkey % 12 = 0 THEN '' ELSE '1,' || c_custkey END AS amount, CASE WHEN c_custkey % 9 = 0 THEN 'soon' ELSE '2024-01-' || (10 + c_custkey % 20) END AS due, c_mktsegment AS segment"""
M = f"({MIXED} FROM customer)"
COLUMNS = ("name", "solvent", "amount", "due", "segment")


def mixed(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("_millrace_mixed")
    return spark.sql(f"{MIXED} FROM _millrace_mixed")


def _profiled(k: int, c: str) -> str:
    v = f"nullif({c}, '')"
    return f"""SELECT '{c}' AS column_name, {k} AS position, CASE WHEN count({v}) = 0 THEN 'STRING' WHEN count(*) FILTER (lower({v}) IN ('true', 'false', '1', '0', 'yes', 'no', 'y', 'n')) = count({v}) THEN 'BOOLEAN'
  WHEN count(*) FILTER (try_cast(replace({v}, ',', '') AS DOUBLE) IS NOT NULL) / count({v}) > 0.8 THEN 'NUMBER' WHEN count(*) FILTER (regexp_matches({v}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}})')) / count({v}) > 0.8 THEN 'DATE' ELSE 'STRING' END AS data_type,
  count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, round_even((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS null_percentage, round(count({c}) / count(*), 6) AS completeness_ratio,
  round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness_ratio, min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length FROM {M}"""


@query(" UNION ALL ".join(_profiled(k, c) for k, c in enumerate(COLUMNS)))
def prof_columns(spark, sf_dir):
    return p.profile(mixed(spark, sf_dir), list(COLUMNS))


@query(" UNION ALL ".join(_profiled(k, c) for k, c in enumerate(COLUMNS[1:]) if c != "amount"))
def prof_merged(spark, sf_dir):
    # summaries of ten parts; columns with few values, which a sketch counts exactly
    parts = p.summaries(mixed(spark, sf_dir).withColumn("part", F.expr("c_custkey % 10")), list(COLUMNS[1:]), by="part")
    return p.merged_profile(parts).where("column_name <> 'amount'")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, array_to_string(list_slice(list_sort(list(DISTINCT {c})), 1, 10), '|') AS samples FROM {M} WHERE {c} IS NOT NULL" for c in COLUMNS))
def prof_samples(spark, sf_dir):
    return p.samples(mixed(spark, sf_dir), list(COLUMNS)).select("column_name", F.array_join("sample_values", "|").alias("samples"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (name IS NULL OR amount = '') AS incomplete, count(*) FILTER (name IS NULL) AS missing_name, count(*) FILTER (amount = '') AS missing_amount, count(*) FILTER (NOT (name IS NULL OR amount = '')) AS complete,
  round(count(*) FILTER (NOT (name IS NULL OR amount = '')) * 100.0 / count(*), 6) AS completeness_rate FROM {M}""")
def prof_completeness(spark, sf_dir):
    return p.completeness(mixed(spark, sf_dir), ["name", "amount"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS total, count(DISTINCT {c}) AS unique_count, count({c}) - count(DISTINCT {c}) AS duplicate_count, round(count(DISTINCT {c}) * 100.0 / count({c}), 6) AS uniqueness_rate FROM {M}" for c in ("name", "due", "segment")))
def prof_uniqueness(spark, sf_dir):
    return p.uniqueness(mixed(spark, sf_dir), ["name", "due", "segment"])


@query(f"""SELECT due, f AS first_index, c_custkey AS "index" FROM (SELECT due, c_custkey, min(c_custkey) OVER (PARTITION BY due) AS f FROM {M}) WHERE c_custkey > f""")
def prof_duplicate_pairs(spark, sf_dir):
    return p.duplicate_pairs(mixed(spark, sf_dir), "due", "c_custkey")


@query("SELECT 'embedding' AS path, 'array' AS kind, 0 AS level UNION ALL SELECT 'label', 'primitive', 0 UNION ALL SELECT 'vec_id', 'primitive', 0")
def prof_schema(spark, sf_dir):
    return spark.createDataFrame(p.schema_fields(table(spark, sf_dir, "embeddings").schema), "path string, kind string, level int")


# Both engines read these: a JSON object for each event, not all with the same fields, and some texts that are none.
_EVENT = """CASE WHEN event_id % 13 = 0 THEN 'no json' ELSE concat('{"id": ', event_id, ', "props": ', props, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(', "user": {"id": ', user_id, ', "kind": "', event_type, '", "tags": ["a", "b"]}') END, '}') END AS doc"""


@query(f"""SELECT substr(fullkey, 3) AS path, CASE WHEN t.type = 'OBJECT' THEN 'object' WHEN t.type = 'ARRAY' THEN 'array' ELSE 'primitive' END AS kind, (length(fullkey) - length(replace(fullkey, '.', '')) - 1)::INT AS level, count(*) AS present
  FROM (SELECT {_EVENT} FROM events) e, json_tree(CASE WHEN json_valid(doc) THEN doc::JSON END) t WHERE fullkey <> '$' AND fullkey NOT LIKE '%[%' GROUP BY ALL""")
def prof_json_fields(spark, sf_dir):
    return p.json_fields(table(spark, sf_dir, "events").selectExpr(_EVENT), "doc")


_CASTS = {"name": "int", "solvent": "boolean", "amount": "double", "due": "date"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS expected, count(nullif({c}, '')) AS checked, count(*) FILTER (nullif({c}, '') IS NOT NULL AND try_cast({c} AS {k}) IS NULL) AS mismatched FROM {M}" for c, k in _CASTS.items()))
def prof_value_types(spark, sf_dir):
    return p.value_mismatches(mixed(spark, sf_dir), _CASTS)


@query("SELECT 'event_id' AS column_name, 'string' AS expected, 'bigint' AS actual UNION ALL SELECT 'none', 'int', ''")
def prof_types(spark, sf_dir):
    odd = p.type_mismatches(table(spark, sf_dir, "events"), {"event_id": "string", "value": "double", "none": "int"})
    return spark.createDataFrame(odd, "column_name string, expected string, actual string")


@query("SELECT event_id, sha256('event_id=' || event_id || '|event_type=' || event_type || '|user_id=' || user_id) AS record_hash FROM events")
def ing_record_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", i.record_hash(["user_id", "event_type", "event_id"]).alias("record_hash"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS row_number FROM events")
def ing_row_numbers(spark, sf_dir):
    return i.row_numbers(table(spark, sf_dir, "events").select("event_id"), ["event_id"])


ARRIVED = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'say \"' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '\"' END END AS note, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '#DIV/0!' WHEN o_orderkey % 17 = 0 THEN '1e16' ELSE o_orderstatus END AS status"


def arrived(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("_millrace_arrived")
    return spark.sql(f"{ARRIVED} FROM _millrace_arrived")


@query(f"""SELECT o_orderkey, coalesce(trim(note), '') = '' AND coalesce(trim(status), '') = '' AS blank, (length(note) - length(replace(note, '"', ''))) % 2 = 1 AS unbalanced, coalesce(status = '#DIV/0!', false) AS formula, coalesce(abs(try_cast(status AS DOUBLE)) > 1e15, false) AS large FROM ({ARRIVED} FROM orders)""")
def ing_record_checks(spark, sf_dir):
    d = arrived(spark, sf_dir)
    csv, sheet = i.csv_checks(d.drop("o_orderkey")), i.sheet_checks(d)
    return d.select("o_orderkey", csv["record is blank"].alias("blank"), csv["unbalanced quotes"].alias("unbalanced"), sheet["formula error"].alias("formula"), sheet["number too large"].alias("large"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (NOT bad) AS successful, count(*) FILTER (bad) AS rejected, count(*) FILTER (odd) AS warned FROM (SELECT coalesce(note, '') = '' AND status IS NULL AS bad, (length(note) - length(replace(note, '"', ''))) % 2 = 1 AS odd FROM ({ARRIVED} FROM orders))""")
def ing_stats(spark, sf_dir):
    d = arrived(spark, sf_dir)
    return i.ingest_stats(i.checked(d, i.csv_checks(d.drop("o_orderkey")), ["record is blank", "field too long"]))


@query(f"""SELECT o_orderkey, CASE WHEN status = '#DIV/0!' THEN 'formula error' ELSE 'number too large' END AS rejection_reason FROM ({ARRIVED} FROM orders) WHERE status IN ('#DIV/0!', '1e16')""")
def ing_rejected(spark, sf_dir):
    d = arrived(spark, sf_dir)
    checks = i.sheet_checks(d)
    return i.split_records(i.checked(d, checks, list(checks)))[1].select("o_orderkey", "rejection_reason")


@query("SELECT page_id, regexp_matches(html, '[<>]') OR regexp_matches(html, '&([^a-zA-Z0-9_#]|$)') OR regexp_matches(html, '&[a-zA-Z0-9_]+([^a-zA-Z0-9_;]|$)') AS unescaped, length(html) > 50000 AS too_long FROM pages")
def ing_xml_checks(spark, sf_dir):
    checks = i.xml_checks(table(spark, sf_dir, "pages").select("html"))
    return table(spark, sf_dir, "pages").select("page_id", checks["unescaped markup"].alias("unescaped"), checks["text too long"].alias("too_long"))


@query("""SELECT user_id AS "user.id", event_type AS "user.last.type", user_id || ', ' || event_id AS "ids", CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS "tags" FROM events""")
def ing_flatten(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(
        F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("type")).alias("last")).alias("user"),
        F.array("user_id", "event_id").alias("ids"),
        F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("tags"),
    )
    return i.flatten(nested)


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS embedding FROM embeddings")
def ing_separate_records(spark, sf_dir):
    return i.separate_records(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").withColumn("embedding", F.col("embedding").cast("double"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.none') IS NULL AS missing FROM events""")
def ing_dotted_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.none").isNull().alias("missing"))


@query("SELECT event_id, contains(lower(event_type), 'error') AS failed FROM events")
def ing_api_checks(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"))
    return d.select("event_id", i.api_checks(d)["response tells of an error"].alias("failed"))


@query("""SELECT page_id, false AS blank, true AS deep FROM pages""")
def ing_json_checks(spark, sf_dir):
    nested = table(spark, sf_dir, "pages").select("page_id", F.struct(F.struct(F.struct(F.col("url").alias("c")).alias("b")).alias("a")).alias("data"))
    checks = i.json_checks(nested, 3)
    return nested.select("page_id", checks["record is empty"].alias("blank"), checks["nested too deeply"].alias("deep"))


@query("SELECT event_id, 'batch-7' AS batch_id, 'orders' AS _api_source FROM events")
def ing_stamped(spark, sf_dir):
    return i.stamped(table(spark, sf_dir, "events").select("event_id"), "batch-7", _api_source="orders")
