"""Dashboards, health, dependencies, lineage and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import control as k
from millrace.operators import graphs as g
from millrace.queries.quality import CHECKS, checks
from millrace.queries.registry import query
from millrace.session import table

# Orders as job runs: a customer is a job.
_COMMON = """CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'PENDING' ELSE 'RUNNING' END END AS status, o_orderkey % 1000 AS records_processed, o_orderkey % 1000 - o_orderkey % 10 AS records_successful, o_orderkey % 10 AS records_failed"""
X = f"""(SELECT o_custkey AS job_id, o_orderkey AS execution_id, {_COMMON}, o_orderdate + to_hours((o_orderkey % 24)::INT) AS start_time, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_hours((o_orderkey % 24)::INT) + to_seconds((o_orderkey % 7200)::INT) END AS end_time FROM orders)"""
NOW = f"(SELECT max(start_time) FROM {X})"
_SECONDS = "epoch(end_time - start_time)"


def executions(spark, sf_dir):
    start = "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int))"
    ends = f"CASE WHEN o_orderstatus <> 'P' THEN {start} + make_dt_interval(0, 0, 0, o_orderkey % 7200) END AS end_time"
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS job_id", "o_orderkey AS execution_id", *_split(_COMMON), f"{start} AS start_time", ends)


def _split(sql: str) -> list[str]:
    """The columns of a select list, none of which holds a comma."""
    return [c.strip() for c in sql.split(",")]


def jobs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("job_name"))


# Customers in a row: each job waits for the one with the next larger key, in one of three ways.
DEPENDENCIES = "(SELECT c_custkey AS child_job_id, c_custkey + 1 AS parent_job_id, CASE c_custkey % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'COMPLETION' ELSE 'DATA_AVAILABILITY' END AS dependency_type, c_acctbal > 0 AS is_active FROM customer)"


def dependencies(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS child_job_id", "c_custkey + 1 AS parent_job_id", "CASE c_custkey % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'COMPLETION' ELSE 'DATA_AVAILABILITY' END AS dependency_type", "c_acctbal > 0 AS is_active")


ERRORS = "(SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'LOW' ELSE NULL END AS severity, event_id % 2 = 0 AS is_resolved, event_id % 3 = 0 AS can_retry FROM events)"


def errors(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'LOW' ELSE NULL END AS severity", "event_id % 2 = 0 AS is_resolved", "event_id % 3 = 0 AS can_retry")


@query(f"""SELECT count(*) AS total_jobs, count(*) FILTER (status = 'SUCCESS') AS successful_jobs, count(*) FILTER (status = 'FAILED') AS failed_jobs, round_even(count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*), 2)::DOUBLE AS success_rate,
  sum(records_processed)::BIGINT AS total_records, sum(records_failed)::BIGINT AS failed_records, round(avg({_SECONDS}), 4) AS avg_duration_seconds FROM {X} WHERE status <> 'PENDING' AND start_time >= {NOW} - INTERVAL 365 DAY""")
def ctl_dashboard(spark, sf_dir):
    x = executions(spark, sf_dir)
    return k.dashboard(x, k.newest(x, "start_time"), "365d")


@query(f"SELECT start_time::DATE AS day, count(*) AS jobs, count(*) FILTER (status = 'SUCCESS') AS successful, sum(records_processed)::BIGINT AS records, round(avg({_SECONDS}), 4) AS avg_seconds FROM {X} GROUP BY 1")
def ctl_by_day(spark, sf_dir):
    return k.processing_by_day(executions(spark, sf_dir))


@query(f"""SELECT count(*) AS total_checks, count(*) FILTER (passed >= failed) AS passed_checks, count(*) FILTER (passed < failed) AS failed_checks, round_even(count(*) FILTER (passed >= failed) * 100.0 / count(*), 2)::DOUBLE AS pass_rate,
  round(avg(passed * 100.0 / checked), 4) AS avg_pass_rate FROM (SELECT event_id AS execution_id, checked, passed, failed FROM {CHECKS}) JOIN {X} USING (execution_id) WHERE status <> 'PENDING'""")
def ctl_quality(spark, sf_dir):
    return k.quality_analytics(checks(spark, sf_dir).withColumnRenamed("event_id", "execution_id"), executions(spark, sf_dir))


@query("SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1")
def ctl_growth(spark, sf_dir):
    return k.growth_by_day(table(spark, sf_dir, "orders"), "o_orderdate")


@query(f"""SELECT 'records_processed' AS metric, round(avg(nullif(records_processed, 0)), 4) AS average, min(nullif(records_processed, 0))::DOUBLE AS least, max(nullif(records_processed, 0))::DOUBLE AS greatest FROM {X}
  UNION ALL SELECT 'records_failed', round(avg(nullif(records_failed, 0)), 4), min(nullif(records_failed, 0))::DOUBLE, max(nullif(records_failed, 0))::DOUBLE FROM {X}""")
def ctl_metric_summary(spark, sf_dir):
    return k.metric_summary(executions(spark, sf_dir), ["records_processed", "records_failed"])


@query("SELECT date_trunc('hour', ts) AS period, round(avg(value), 4) AS average, min(value) AS least, max(value) AS greatest, count(*) AS n FROM events GROUP BY 1")
def ctl_metric_trend(spark, sf_dir):
    return k.metric_trend(table(spark, sf_dir, "events"), "ts", "value", "hour").withColumn("period", F.col("period").cast("timestamp_ntz"))


# Halves of the last digit are common among these means, so they are rounded as whole numbers: of cents and rows.
@query("""SELECT day, ((200 * quantity + n) // (2 * n)) / 10000.0::DOUBLE AS throughput, ((200 * price + n) // (2 * n)) / 10000.0::DOUBLE AS memory
  FROM (SELECT l_shipdate::DATE AS day, count(*) AS n, sum(round(l_quantity * 100)::BIGINT)::BIGINT AS quantity, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS price FROM lineitem GROUP BY 1)""")
def ctl_performance_by_day(spark, sf_dir):
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    days = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"), cents("l_quantity").alias("throughput"), cents("l_extendedprice").alias("memory"))
    return days.select("day", *(F.expr(f"((200 * {c} + n) div (2 * n)) / 10000.0D").alias(c) for c in ("throughput", "memory")))


@query(f"""SELECT job_id, count(*) AS runs, round_even(count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*), 2)::DOUBLE AS success_rate, round_even(count(*) FILTER (status = 'FAILED') * 100.0 / count(*), 2)::DOUBLE AS failure_rate, round(avg({_SECONDS}), 4) AS avg_seconds,
  min({_SECONDS})::DOUBLE AS min_seconds, max({_SECONDS})::DOUBLE AS max_seconds, round(sum(records_processed) FILTER (end_time IS NOT NULL) / nullif(sum({_SECONDS}), 0), 4) AS records_per_second FROM {X} GROUP BY 1""")
def ctl_job_performance(spark, sf_dir):
    return k.job_performance(executions(spark, sf_dir))


@query(f"""SELECT s.day, coalesce(runs, 0) AS runs, coalesce(failures, 0) AS failures FROM (SELECT unnest(generate_series(min(start_time::DATE), max(start_time::DATE), INTERVAL 1 DAY))::DATE AS day FROM {X}) s
  LEFT JOIN (SELECT start_time::DATE AS day, count(*) AS runs, count(*) FILTER (status = 'FAILED') AS failures FROM {X} GROUP BY 1) d ON s.day = d.day""")
def ctl_daily_trend(spark, sf_dir):
    return k.daily_trend(executions(spark, sf_dir))


@query(f"SELECT job_id, count(*) AS runs, count(*) FILTER (status = 'SUCCESS') AS successful, sum(records_processed)::BIGINT AS records FROM {X} GROUP BY ROLLUP (job_id)")
def ctl_jobs_and_total(spark, sf_dir):
    return k.jobs_and_total(executions(spark, sf_dir))


def _horizon(p: str, interval: str) -> str:
    return f"SELECT '{p}' AS horizon, count(*) AS runs, count(*) FILTER (status = 'SUCCESS') AS successful, coalesce(sum(records_processed), 0)::BIGINT AS records FROM {X} WHERE start_time >= {NOW} - INTERVAL {interval}"


@query(" UNION ALL ".join(_horizon(*x) for x in (("1h", "1 HOUR"), ("24h", "24 HOUR"), ("7d", "7 DAY"))))
def ctl_horizons(spark, sf_dir):
    x = executions(spark, sf_dir)
    return k.horizons(x, k.newest(x, "start_time"))


@query(f"SELECT event_type, count(*) AS checks, count(*) FILTER (result = 'PASS') AS passed, count(*) FILTER (result = 'FAIL') AS failed, round_even(sum(passed) * 100.0 / sum(checked), 2)::DOUBLE AS pass_rate FROM {CHECKS} GROUP BY 1")
def ctl_quality_by_type(spark, sf_dir):
    return k.quality_by_type(checks(spark, sf_dir), "event_type")


@query(f"SELECT user_id, count(*) AS failures, sum(failed)::BIGINT AS failed_records FROM {CHECKS} WHERE result = 'FAIL' GROUP BY 1 ORDER BY failures DESC, user_id LIMIT 10")
def ctl_failing_rules(spark, sf_dir):
    return k.failing_rules(checks(spark, sf_dir), "user_id")


@query("SELECT split_part(split_part(url, '//', 1), ':', 1) AS file_type, CASE WHEN html IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS status, count(*) AS files, sum(strlen(html))::BIGINT AS bytes, round(avg(strlen(html)), 4) AS avg_bytes FROM pages GROUP BY 1, 2")
def ctl_files(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.split_part(F.split_part("url", F.lit("//"), F.lit(1)), F.lit(":"), F.lit(1)).alias("file_type"), F.when(F.col("html").isNull(), "FAILED").otherwise("COMPLETED").alias("status"), F.octet_length("html").cast("long").alias("file_size"))
    return k.file_metrics(files)


@query(f"SELECT job_id, CASE WHEN s >= 90 THEN 'HEALTHY' WHEN s >= 70 THEN 'WARNING' ELSE 'CRITICAL' END AS health FROM (SELECT job_id, 100.0 * count(*) FILTER (status <> 'FAILED') / count(*) AS s FROM {X} GROUP BY 1)")
def ctl_health(spark, sf_dir):
    share = executions(spark, sf_dir).groupBy("job_id").agg((100.0 * F.count_if(F.col("status") != "FAILED") / F.count("*")).alias("s"))
    return share.select("job_id", k.health(F.col("s")).alias("health"))


@query(f"""SELECT *, CASE WHEN success_rate < 50 THEN 'critical' WHEN success_rate < 80 THEN 'warning' ELSE 'healthy' END AS status FROM (SELECT count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed,
  count(*) FILTER (status = 'RUNNING') AS running, round(100.0 * count(*) FILTER (status = 'SUCCESS') / count(*), 6) AS success_rate FROM {X} WHERE start_time >= {NOW} - INTERVAL 24 HOUR)""")
def ctl_job_health(spark, sf_dir):
    x = executions(spark, sf_dir)
    return k.job_health(x, k.newest(x, "start_time"))


LAST = f"(SELECT * FROM {X} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC, execution_id DESC) = 1)"


@query(f"SELECT c_custkey AS job_id, c_name AS job_name, execution_id, status, start_time FROM customer LEFT JOIN {LAST} ON c_custkey = job_id")
def join_latest_execution(spark, sf_dir):
    return k.latest_execution(jobs(spark, sf_dir), executions(spark, sf_dir)).select("job_id", "job_name", "execution_id", "status", "start_time")


@query(f"""SELECT c_custkey AS job_id, status, issue FROM (SELECT c_custkey, status, unnest([CASE WHEN status IS NULL THEN 'never_run' END, CASE WHEN status = 'RUNNING' AND start_time < {NOW} - INTERVAL 4 HOUR THEN 'stuck_job' END, CASE WHEN status = 'FAILED' THEN 'failed_execution' END,
  CASE WHEN start_time < {NOW} - INTERVAL 7 DAY THEN 'stale_job' END]) AS issue FROM customer LEFT JOIN {LAST} ON c_custkey = job_id) WHERE issue IS NOT NULL""")
def ctl_job_issues(spark, sf_dir):
    x = executions(spark, sf_dir)
    return k.job_issues(jobs(spark, sf_dir), x, k.newest(x, "start_time"))


@query(f"""SELECT job_id, array_to_string(CASE WHEN len(r) = 0 THEN ['keep going'] ELSE r END, '; ') AS advice, CASE WHEN s < 80 THEN 'needs_attention' WHEN s < 90 THEN 'fair' ELSE 'good' END AS health FROM (SELECT job_id, s, list_filter([CASE WHEN s < 95 THEN 'review failed runs' END, CASE WHEN f > 5 THEN 'add monitoring of failures' END, CASE WHEN q > 0 THEN 'review failed checks' END], lambda x: x IS NOT NULL) AS r
  FROM (SELECT job_id, 100.0 * count(*) FILTER (status = 'SUCCESS') / count(*) AS s, count(*) FILTER (status = 'FAILED') AS f, sum(records_failed) AS q FROM {X} GROUP BY 1))""")
def ctl_recommendations(spark, sf_dir):
    rates = executions(spark, sf_dir).groupBy("job_id").agg((100.0 * F.count_if(F.col("status") == "SUCCESS") / F.count("*")).alias("s"), F.count_if(F.col("status") == "FAILED").alias("f"), F.sum("records_failed").alias("q"))
    return rates.select("job_id", F.array_join(k.recommendations(F.col("s"), F.col("f"), F.lit(100), F.col("q")), "; ").alias("advice"), k.report_health(F.col("s"), F.lit(100)).alias("health"))


@query(f"SELECT s.severity, coalesce(errors, 0) AS errors, coalesce(open, 0) AS open FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS severity) s LEFT JOIN (SELECT severity, count(*) AS errors, count(*) FILTER (NOT is_resolved) AS open FROM {ERRORS} GROUP BY 1) e ON s.severity = e.severity")
def ctl_error_summary(spark, sf_dir):
    return k.error_summary(errors(spark, sf_dir))


@query(f"SELECT ts::DATE AS day, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM {ERRORS} GROUP BY 1")
def ctl_error_trend(spark, sf_dir):
    return k.error_trend(errors(spark, sf_dir), "ts")


@query(f"SELECT count(*) AS total_rejected, count(*) FILTER (can_retry) AS can_retry, count(*) FILTER (is_resolved) AS resolved, count(*) FILTER (NOT is_resolved) AS unresolved, round_even(count(*) FILTER (is_resolved) * 100.0 / count(*), 2)::DOUBLE AS resolution_rate FROM {ERRORS}")
def ctl_rejections(spark, sf_dir):
    return k.rejection_summary(errors(spark, sf_dir))


STATUS = f"""(SELECT d.parent_job_id, child_job_id, dependency_type, status AS parent_status, CASE WHEN status IS NULL THEN false WHEN dependency_type = 'SUCCESS' THEN status = 'SUCCESS' WHEN dependency_type = 'COMPLETION' THEN status IN ('SUCCESS', 'FAILED') ELSE status = 'SUCCESS' AND records_successful > 0 END AS is_met
  FROM {DEPENDENCIES} d LEFT JOIN {LAST} ON d.parent_job_id = job_id WHERE is_active)"""


@query(f"SELECT * FROM {STATUS}")
def ctl_dependencies(spark, sf_dir):
    return k.dependency_status(dependencies(spark, sf_dir), executions(spark, sf_dir))


@query(f"SELECT c_custkey AS job_id, coalesce(n, 0) AS dependencies FROM customer LEFT JOIN (SELECT child_job_id, count(*) AS n, bool_and(is_met) AS ready FROM {STATUS} GROUP BY 1) ON c_custkey = child_job_id WHERE coalesce(ready, true)")
def ctl_executable_jobs(spark, sf_dir):
    return k.executable_jobs(jobs(spark, sf_dir), dependencies(spark, sf_dir), executions(spark, sf_dir))


@query(f"SELECT child_job_id AS job_id, n AS dependencies FROM (SELECT child_job_id, count(*) AS n, bool_and(is_met) AS ready FROM {STATUS} GROUP BY 1) WHERE ready AND child_job_id IN (SELECT child_job_id FROM {DEPENDENCIES} WHERE is_active AND parent_job_id IN (SELECT job_id FROM {X} WHERE status = 'SUCCESS'))")
def ctl_triggered(spark, sf_dir):
    x = executions(spark, sf_dir)
    return k.triggered(x.where("status = 'SUCCESS'").select("job_id"), dependencies(spark, sf_dir), x)


# Nations and regions as a graph of jobs, three levels deep.
EDGES = "(SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES}), t AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM e UNION ALL SELECT ancestor, child, depth + 1 FROM t JOIN e ON descendant = parent) SELECT ancestor, descendant, min(depth)::INT AS depth FROM t GROUP BY 1, 2""")
def join_dependency_tree(spark, sf_dir):
    a = table(spark, sf_dir, "nation").selectExpr("'r' || n_regionkey AS parent", "'n' || n_nationkey AS child")
    b = table(spark, sf_dir, "supplier").selectExpr("'n' || s_nationkey AS parent", "'s' || s_suppkey AS child")
    return g.closure(a.unionAll(b), "parent", "child")


# Customers in blocks of 50 lead to the next one, those in debt also back by up to five.
FOLLOWED = "(SELECT c_custkey AS parent, c_custkey + 1 AS child FROM customer WHERE c_custkey % 50 <> 49 UNION ALL SELECT c_custkey, c_custkey - 1 - c_custkey % 5 FROM customer WHERE c_acctbal < 0 AND c_custkey % 50 > 5)"


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {FOLLOWED}), t AS (SELECT parent AS start, child AS node, 1 AS length FROM e UNION SELECT start, child, length + 1 FROM t JOIN e ON node = parent WHERE length < 6)
  SELECT node, min(length)::INT AS length FROM t WHERE node = start GROUP BY 1""")
def join_cycles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    on = c.where("c_custkey % 50 <> 49").selectExpr("c_custkey AS parent", "c_custkey + 1 AS child")
    back = c.where("c_acctbal < 0 AND c_custkey % 50 > 5").selectExpr("c_custkey AS parent", "c_custkey - 1 - c_custkey % 5 AS child")
    return g.cycles(on.unionAll(back), "parent", "child")


LINEAGE = "(SELECT 'orders' AS source_entity, o_orderpriority AS source_field, 'report' AS target_entity, o_orderstatus AS target_field FROM orders UNION ALL SELECT 'report', o_orderstatus, 'board', 'all' FROM orders)"


@query(f"SELECT node, sum(leaving)::BIGINT AS leaving, sum(entering)::BIGINT AS entering FROM (SELECT source_entity || '.' || source_field AS node, 1 AS leaving, 0 AS entering FROM {LINEAGE} UNION ALL SELECT target_entity || '.' || target_field, 0, 1 FROM {LINEAGE}) GROUP BY 1")
def ctl_lineage(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    edges = d.selectExpr("'orders' AS source_entity", "o_orderpriority AS source_field", "'report' AS target_entity", "o_orderstatus AS target_field")
    return k.lineage_graph(edges.unionAll(d.selectExpr("'report'", "o_orderstatus", "'board'", "'all'")))


@query(f"""SELECT execution_id, CASE WHEN start_time < {NOW} - INTERVAL 365 DAY THEN 'purge' WHEN status = 'FAILED' AND start_time < {NOW} - INTERVAL 7 DAY THEN 'drop' WHEN status = 'RUNNING' AND start_time < {NOW} - INTERVAL 24 HOUR THEN 'reset'
  WHEN start_time < {NOW} - INTERVAL 90 DAY THEN 'archive' ELSE 'keep' END AS action FROM {X}""")
def ctl_retention(spark, sf_dir):
    x = executions(spark, sf_dir)
    return k.retention(x, k.newest(x, "start_time")).select("execution_id", "action")


NAMED = "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'ValidationError' WHEN 1 THEN 'DatabaseTimeout' WHEN 2 THEN 'ConnectionRefused' WHEN 3 THEN 'TimeoutError' WHEN 4 THEN 'ConfigError' WHEN 5 THEN 'ETLError' WHEN 6 THEN 'SystemExit' ELSE 'KeyError' END AS name"


@query(f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'VALIDATION_ERROR' WHEN 1 THEN 'DATABASE_ERROR' WHEN 2 THEN 'NETWORK_ERROR' WHEN 3 THEN 'TIMEOUT_ERROR' WHEN 4 THEN 'CONFIGURATION_ERROR' WHEN 5 THEN 'PROCESSING_ERROR' ELSE 'UNKNOWN_ERROR' END AS error_type,
  CASE event_id % 8 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'HIGH' WHEN 3 THEN 'HIGH' WHEN 5 THEN 'MEDIUM' WHEN 6 THEN 'CRITICAL' ELSE 'LOW' END AS severity FROM events""")
def ctl_error_types(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("_millrace_named")
    d = spark.sql(f"{NAMED} FROM _millrace_named")
    return d.select("event_id", k.error_type(F.col("name")).alias("error_type"), k.error_severity(F.col("name")).alias("severity"))


@query(f"SELECT execution_id, round(records_processed / nullif({_SECONDS}, 0), 4) AS records_per_second, coalesce(round_even(records_failed * 100.0 / nullif(records_processed, 0), 2), 0)::DOUBLE AS error_rate FROM {X} WHERE end_time IS NOT NULL")
def ctl_execution_metrics(spark, sf_dir):
    return k.execution_metrics(executions(spark, sf_dir))


@query(f"SELECT count(*) AS runs, round(avg({_SECONDS} / 60), 4) AS avg_minutes, sum(records_processed)::BIGINT AS records, round_even(count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*), 2)::DOUBLE AS success_rate, round(sum(records_processed) / 168.0, 4) AS records_per_hour FROM {X} WHERE start_time >= {NOW} - INTERVAL 7 DAY")
def ctl_period_metrics(spark, sf_dir):
    x = executions(spark, sf_dir)
    return k.period_metrics(x, k.newest(x, "start_time"), "7d")


@query("SELECT 'events' AS table_name, count(*) AS total, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS recent FROM events UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_orderdate >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) FROM orders")
def ctl_table_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return k.table_counts({"events": (e, "ts"), "orders": (table(spark, sf_dir, "orders"), "o_orderdate")}, k.newest(e, "ts"))
