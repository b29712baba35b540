"""Sources, sinks and pipelines: tables go out in a format and come back from it."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from millrace.operators import aggregate as a
from millrace.operators import clean as c
from millrace.operators import mapping as m
from millrace.operators import resolve as r
from millrace.operators import validate as v
from millrace.plans import pipeline as p
from millrace.queries.registry import query
from millrace.session import shared_path, table
from millrace.sources import files, sinks
from millrace.sources.excel import read_excel, sheet_metadata


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' ' || c_mktsegment || ' ' END), '') AS segment FROM customer")
def src_csv(spark, sf_dir):
    path = shared_path(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias(" segment"))
    rows.write.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path, sep=";", header=True)
    return files.read_csv(spark, path)


@query("SELECT true AS named, true AS sized, least(10, count(*) + 1) AS lines, true AS even FROM customer")
def src_csv_check(spark, sf_dir):
    path = shared_path(spark) + ".csv"
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").coalesce(1).write.csv(path, header=True)
    return files.check_csv(spark, path, 1000)


@query("SELECT event_id, event_type, value FROM events")
def src_jsonl(spark, sf_dir):
    path = shared_path(spark)
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    rows.write.text(path)
    spark.createDataFrame([("not json",), ("",), ("{\"event_id\":",)], "value string").write.mode("append").text(path)
    return files.read_json(spark, path, "jsonl").select("event_id", "event_type", "value")


def _nations(spark, sf_dir):
    """The nations as one JSON array: 25 of them at any size."""
    return table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def src_json_array(spark, sf_dir):
    path = shared_path(spark)
    _nations(spark, sf_dir).write.text(path)
    return files.read_json(spark, path)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def src_json_object(spark, sf_dir):
    path = shared_path(spark)
    _nations(spark, sf_dir).select(F.concat(F.lit('{"took": 3, "reply": {"rows": '), "value", F.lit("}}")).alias("value")).write.text(path)
    return files.read_json(spark, path, json_path="reply.rows")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def src_json_records(spark, sf_dir):
    body = _nations(spark, sf_dir).select(F.concat(F.lit('{"items": '), "value", F.lit("}")).alias("value"))
    return body.select(F.inline(files.records_in(F.col("value"), "struct<n_nationkey: bigint, n_name: string>")))


@query("SELECT c_custkey AS \"@id\", c_name AS name, c_mktsegment AS segment FROM customer")
def src_xml(spark, sf_dir):
    path = shared_path(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("@id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    rows.write.format("xml").options(rootTag="customers", rowTag="customer", attributePrefix="@").save(path)
    return files.read_xml(spark, path)


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _workbook(spark, sf_dir) -> str:
    """The nations and, hidden, the regions - a few rows at any size - as a workbook."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        names = ("nation", "region")
        sheets = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"{" state='hidden'" if k else ""}/>' for k, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/{n}.xml"/>' for k, n in enumerate(names)) + "</Relationships>")
        for n in names:
            df = table(spark, sf_dir, n)
            rows = [df.columns, *(map(str, r) for r in df.orderBy(df.columns[0]).collect())]
            cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in r) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/{n}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{cells}</sheetData></worksheet>')
    path = shared_path(spark)
    # the text sink passes bytes through, to any store that Spark writes to
    spark.createDataFrame([(bytearray(data.getvalue()),)], "value binary").select(F.col("value").cast("string")).write.text(path)
    return f"{path}/part-*"


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, 'nation' AS _sheet_name, n_nationkey + 2::BIGINT AS _row_number FROM nation")
def src_excel(spark, sf_dir):
    return read_excel(spark, _workbook(spark, sf_dir))


@query("SELECT 'nation' AS sheet_name, false AS hidden, count(*) + 1 AS rows, 3 AS columns FROM nation UNION ALL SELECT 'region', true, count(*) + 1, 2 FROM region")
def src_excel_sheets(spark, sf_dir):
    return sheet_metadata(spark, _workbook(spark, sf_dir)).select("sheet_name", "hidden", "rows", "columns")


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def src_sql(spark, sf_dir):
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "nation")}
    return files.read_sql(spark, "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", tables)


@query("SELECT o_orderkey AS row_number FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 1000")
def src_valid_rows(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_number"), F.when(F.col("o_orderstatus") == "F", "VALID").otherwise("INVALID").alias("validation_status"))
    return files.valid_rows(raw, 1000).select("row_number")


@query("SELECT p_partkey, p_name FROM part")
def src_orc(spark, sf_dir):
    path = shared_path(spark)
    table(spark, sf_dir, "part").select("p_partkey", "p_name").write.orc(path)
    return files.read(spark, "orc", path)


@query("SELECT count(*) AS total, 3::BIGINT AS columns FROM region, (SELECT 1)".replace("3::BIGINT", "2::BIGINT"))
def src_preview(spark, sf_dir):
    seen = files.preview(table(spark, sf_dir, "region"), 3)
    return seen.rows.agg(F.lit(seen.total).cast("long").alias("total"), F.lit(len(seen.columns)).cast("long").alias("columns"))


@query("SELECT event_id, event_type, user_id FROM events")
def sink_partitioned(spark, sf_dir):
    path = shared_path(spark)
    sinks.write_records(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), path, ["event_type"])
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def sink_backup(spark, sf_dir):
    path = shared_path(spark)
    sinks.backup(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").json(path)


@query("SELECT o_orderkey::VARCHAR AS source_record_id, 'o_totalprice: range' AS rejection_reason FROM orders WHERE o_totalprice > 400000")
def sink_rejected(spark, sf_dir):
    path = shared_path(spark)
    rules = [v.Rule("o_totalprice", "range", {"max": 400000}, severity="critical")]
    _, bad = v.accepted_and_rejected(v.validate(table(spark, sf_dir, "orders"), rules, "o_orderkey"))
    sinks.write_rejected(bad.withColumnRenamed("o_orderkey", "source_record_id"), path)
    return spark.read.csv(path, header=True).select("source_record_id", "rejection_reason")


@query("""SELECT 'orders_by_month' AS aggregation_name, '{"o_orderpriority":"' || o_orderpriority || '"}' AS dimension_keys, '{"n":' || count(*) || ',"customers":' || count(DISTINCT o_custkey) || '}' AS measure_values, date_trunc('month', o_orderdate)::DATE::VARCHAR AS time_period FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate)""")
def sink_aggregated(spark, sf_dir):
    rows = a.aggregate(table(spark, sf_dir, "orders"), [a.Key("o_orderpriority"), a.Key("o_orderdate", "month", granularity="month")], [a.Measure("o_orderkey", "count", "n"), a.Measure("o_custkey", "unique_count", "customers")])
    return sinks.aggregated_rows(rows, "orders_by_month", ["o_orderpriority"], ["n", "customers"], "month")


@query("SELECT c_custkey, lower(c_name) AS c_name, c_acctbal, CASE WHEN c_acctbal > 5000 THEN 'gold' ELSE 'plain' END AS tier FROM customer WHERE c_acctbal >= 0")
def plan_pipeline(spark, sf_dir):
    spec = p.PipelineSpec(
        "customers",
        [
            p.clean_stage(c.CleanConfig(case="lower")),
            p.validate_stage([v.Rule("c_acctbal", "range", {"min": 0}, severity="critical"), v.Rule("c_name", "pattern", {"pattern": "x"}, severity="warning")], "c_custkey"),
            p.normalize_stage({"tier": F.lit("plain")}, [{"field": "tier", "condition": "$c_acctbal > 5000", "set": "gold"}]),
        ],
    )
    good = shared_path(spark)
    p.run(spec, table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), good, shared_path(spark))
    return spark.read.parquet(good).select("c_custkey", "c_name", "c_acctbal", "tier")


@query("""SELECT segment, count(*) AS n FROM (SELECT DISTINCT lower(c_mktsegment) AS segment, c_nationkey FROM customer) GROUP BY 1""")
def plan_match_and_aggregate(spark, sf_dir):
    rules = [r.MatchRule("name", "exact", 1.0, blocking=True)]
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("name"), "c_mktsegment")
    spec = p.PipelineSpec("segments", [p.clean_stage(c.CleanConfig(case="lower")), p.match_stage("id", rules, 0.9, "first"), p.aggregate_stage([a.Key("c_mktsegment", "segment")], [a.Measure("id", "count", "n")])])
    return p.folded(spec, d)


@query("SELECT 'INSERT INTO nation (n_nationkey, n_name) VALUES (' || n_nationkey || ', ' || chr(39) || n_name || chr(39) || chr(39) || 's' || chr(39) || ');' AS value FROM nation")
def sink_sql_backup(spark, sf_dir):
    path = shared_path(spark)
    sinks.backup(table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit("'s")).alias("n_name")), path, "sql", "nation")
    return spark.read.text(path)


@query("SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def sink_archive(spark, sf_dir):
    path, old = shared_path(spark), table(spark, sf_dir, "events").select("event_id", "event_type", "ts").where("ts < TIMESTAMP_NTZ '2024-01-10'")
    sinks.archive(old.where("event_id % 2 = 0"), path)
    sinks.archive(old.where("event_id % 2 = 1"), path)
    return spark.read.schema("event_id long, event_type string").json(path)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def sink_export(spark, sf_dir):
    report = a.aggregate(table(spark, sf_dir, "orders"), [a.Key("o_orderpriority")], [a.Measure("o_orderkey", "count", "n")])
    path = sinks.export(report, shared_path(spark), "orders_by_priority", "csv")
    return spark.read.schema("o_orderpriority string, n long").csv(path, header=True)


@query("SELECT c_custkey AS key, upper(c_name) AS name, 'v1' AS version FROM customer WHERE c_acctbal >= 0")
def plan_map(spark, sf_dir):
    maps = [m.Mapping("key", source="c_custkey", required=True), m.Mapping("name", "calculated", expression="upper($c_name)"), m.Mapping("version", "constant", expression="v1")]
    spec = p.PipelineSpec("customers", [p.Stage("solvent", lambda df: df.where("c_acctbal >= 0"), ["c_acctbal"]), p.map_stage(maps)])
    return p.folded(spec, table(spark, sf_dir, "customer")).drop("_errors")
