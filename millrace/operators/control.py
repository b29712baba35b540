"""Analytics over job runs, checks, errors and entities.

Executions have job_id, execution_id, status (PENDING, RUNNING, SUCCESS, FAILED), start_time,
end_time and the counts records_processed, records_successful, records_failed. Nothing reads
the clock: `now` is a parameter, so that a report can be made again.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import period_days
from millrace.operators.aggregate import fill_periods
from millrace.operators.windows import latest, latest_by_key

HEALTHY, WARNING = 90, 70
JOB_CRITICAL, JOB_WARNING = 50, 80
STUCK_HOURS, STALE_DAYS = 4, 7
ARCHIVE_DAYS, PURGE_DAYS, FAILED_DAYS, RESET_HOURS = 90, 365, 7, 24
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
# Words in names of exceptions and what they tell.
ERROR_TYPES = (
    (("Validation", "Invalid"), "VALIDATION_ERROR"),
    (("Database", "SQL"), "DATABASE_ERROR"),
    (("Network", "Connection"), "NETWORK_ERROR"),
    (("Timeout",), "TIMEOUT_ERROR"),
    (("Config", "Setting"), "CONFIGURATION_ERROR"),
    (("Processing", "ETL"), "PROCESSING_ERROR"),
)
ERROR_SEVERITIES = ((("Critical", "Fatal", "System"), "CRITICAL"), (("Database", "Network", "Timeout"), "HIGH"), (("Processing", "ETL", "Validation"), "MEDIUM"))


def newest(df: DataFrame, column: str) -> datetime:
    """The latest time in a table: one value."""
    return df.agg(F.max(column)).first()[0]


def since(df: DataFrame, column: str, now: datetime, period: str) -> DataFrame:
    """Rows of the last period, such as 24h or 30d; the bound is a literal that the scan gets."""
    return df.where(F.col(column) >= F.lit(now - timedelta(days=period_days(period))).cast(dict(df.dtypes)[column]))


def seconds() -> Column:
    return F.unix_micros(F.col("end_time").cast("timestamp")) / 1e6 - F.unix_micros(F.col("start_time").cast("timestamp")) / 1e6


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.coalesce(F.bround(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


def _is(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def dashboard(executions: DataFrame, now: datetime, period: str) -> DataFrame:
    """Runs by status, records and mean duration of a period, those that wait left out."""
    rows = since(executions, "start_time", now, period).where("status <> 'PENDING'")
    total = F.coalesce(F.sum("records_processed"), F.lit(0))
    return rows.agg(
        F.count("*").alias("total_jobs"),
        _is("SUCCESS").alias("successful_jobs"),
        _is("FAILED").alias("failed_jobs"),
        rate(_is("SUCCESS"), F.count("*")).alias("success_rate"),
        total.alias("total_records"),
        F.coalesce(F.sum("records_failed"), F.lit(0)).alias("failed_records"),
        F.coalesce(F.round(F.avg(seconds()), 4), F.lit(0.0)).alias("avg_duration_seconds"),
    )


def processing_by_day(executions: DataFrame) -> DataFrame:
    return executions.groupBy(F.to_date("start_time").alias("day")).agg(F.count("*").alias("jobs"), _is("SUCCESS").alias("successful"), F.sum("records_processed").alias("records"), F.round(F.avg(seconds()), 4).alias("avg_seconds"))


def quality_analytics(checks: DataFrame, executions: DataFrame) -> DataFrame:
    """Checks of runs that didn't wait: passed if at least as many records passed as failed."""
    rows = checks.join(executions.where("status <> 'PENDING'").select("execution_id"), "execution_id")
    passed = F.count_if(F.col("passed") >= F.col("failed"))
    return rows.agg(
        F.count("*").alias("total_checks"),
        passed.alias("passed_checks"),
        (F.count("*") - passed).alias("failed_checks"),
        rate(passed, F.count("*")).alias("pass_rate"),
        F.round(F.avg(F.try_divide(F.col("passed") * 100.0, F.col("checked"))), 4).alias("avg_pass_rate"),
    )


def growth_by_day(df: DataFrame, at: str) -> DataFrame:
    return df.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, least and greatest of each metric, without zeros and nulls: one aggregate, a row for each."""
    given = lambda m: F.nullif(F.col(m), F.lit(0))
    one = df.agg(*(F.struct(F.round(F.avg(given(m)), 4).alias("average"), F.min(given(m)).alias("least"), F.max(given(m)).alias("greatest")).alias(m) for m in metrics))
    return one.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"{m}.{x}").cast("double").alias(x) for x in ("average", "least", "greatest"))) for m in metrics))))


def metric_trend(df: DataFrame, at: str, metric: str, period: str) -> DataFrame:
    return df.groupBy(F.date_trunc(period, F.col(at)).alias("period")).agg(F.round(F.avg(metric), 4).alias("average"), F.min(metric).alias("least"), F.max(metric).alias("greatest"), F.count("*").alias("n"))


def job_performance(executions: DataFrame) -> DataFrame:
    """Rates, durations and throughput of each job."""
    n, ended = F.count("*"), F.col("end_time").isNotNull()
    return executions.groupBy("job_id").agg(
        n.alias("runs"),
        rate(_is("SUCCESS"), n).alias("success_rate"),
        rate(_is("FAILED"), n).alias("failure_rate"),
        F.round(F.avg(seconds()), 4).alias("avg_seconds"),
        F.min(seconds()).alias("min_seconds"),
        F.max(seconds()).alias("max_seconds"),
        F.round(F.try_divide(F.sum(F.when(ended, F.col("records_processed"))).cast("double"), F.sum(seconds())), 4).alias("records_per_second"),
    )


def daily_trend(executions: DataFrame) -> DataFrame:
    """Runs and failures of each day, days without any included."""
    days = executions.groupBy(F.to_date("start_time").alias("day")).agg(F.count("*").alias("runs"), _is("FAILED").alias("failures"))
    return fill_periods(days, "day", "day", [], {"runs": 0, "failures": 0})


def jobs_and_total(executions: DataFrame) -> DataFrame:
    """Runs, successes and records of each job, and of all as the row with a null job, from one rollup."""
    return executions.rollup("job_id").agg(F.count("*").alias("runs"), _is("SUCCESS").alias("successful"), F.sum("records_processed").alias("records"))


def horizons(executions: DataFrame, now: datetime, periods: tuple[str, ...] = ("1h", "24h", "7d")) -> DataFrame:
    """A row for each horizon: all of them from one pass over the longest."""
    longest = max(periods, key=period_days)
    rows = since(executions, "start_time", now, longest)
    kind = dict(executions.dtypes)["start_time"]
    cuts = {p: F.col("start_time") >= F.lit(now - timedelta(days=period_days(p))).cast(kind) for p in periods}
    one = rows.agg(*(F.struct(F.count_if(c).alias("runs"), F.count_if(c & (F.col("status") == "SUCCESS")).alias("successful"), F.coalesce(F.sum(F.when(c, F.col("records_processed"))), F.lit(0)).alias("records")).alias(f"_{p}") for p, c in cuts.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(p).alias("horizon"), *(F.col(f"_{p}.{x}").alias(x) for x in ("runs", "successful", "records"))) for p in periods))))


def quality_by_type(checks: DataFrame, kind: str) -> DataFrame:
    return checks.groupBy(kind).agg(F.count("*").alias("checks"), F.count_if(F.col("result") == "PASS").alias("passed"), F.count_if(F.col("result") == "FAIL").alias("failed"), rate(F.sum("passed"), F.sum("checked")).alias("pass_rate"))


def failing_rules(checks: DataFrame, rule: str, most: int = 10) -> DataFrame:
    """The rules that failed most often; ties by rule."""
    return checks.where("result = 'FAIL'").groupBy(rule).agg(F.count("*").alias("failures"), F.sum("failed").alias("failed_records")).orderBy(F.desc("failures"), rule).limit(most)


def file_metrics(files: DataFrame) -> DataFrame:
    """Files and bytes by type and status."""
    return files.groupBy("file_type", "status").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.round(F.avg("file_size"), 4).alias("avg_bytes"))


def health(score: Column) -> Column:
    return F.when(score >= HEALTHY, "HEALTHY").when(score >= WARNING, "WARNING").otherwise("CRITICAL")


def job_health(executions: DataFrame, now: datetime, period: str = "24h") -> DataFrame:
    """Success rate of a period and what it says; 100 without runs."""
    rows = since(executions, "start_time", now, period)
    share = F.coalesce(F.try_divide(_is("SUCCESS") * 100.0, F.count("*")), F.lit(100.0))
    return rows.agg(F.count("*").alias("total"), _is("SUCCESS").alias("success"), _is("FAILED").alias("failed"), _is("RUNNING").alias("running"), F.round(share, 6).alias("success_rate")).withColumn("status", F.when(F.col("success_rate") < JOB_CRITICAL, "critical").when(F.col("success_rate") < JOB_WARNING, "warning").otherwise("healthy"))


def latest_execution(jobs: DataFrame, executions: DataFrame) -> DataFrame:
    """Every job with its latest run, if there is one."""
    last = latest(executions, ["job_id"], [F.desc("start_time"), F.desc("execution_id")])
    return jobs.join(last, "job_id", "left")


def job_issues(jobs: DataFrame, executions: DataFrame, now: datetime) -> DataFrame:
    """A row for each issue of a job's latest run: never_run, stuck_job, failed_execution, stale_job."""
    last = latest_by_key(executions.select("job_id", "start_time", "execution_id", "status"), ["job_id"], ["start_time", "execution_id"])
    rows = jobs.select("job_id").join(last, "job_id", "left")
    kind = dict(executions.dtypes)["start_time"]
    older = lambda **x: F.col("start_time") < F.lit(now - timedelta(**x)).cast(kind)
    found = F.array(
        F.when(F.col("status").isNull(), "never_run"),
        F.when((F.col("status") == "RUNNING") & older(hours=STUCK_HOURS), "stuck_job"),
        F.when(F.col("status") == "FAILED", "failed_execution"),
        F.when(older(days=STALE_DAYS), "stale_job"),
    )
    return rows.select("job_id", "status", F.explode(F.array_compact(found)).alias("issue"))


def recommendations(success_rate: Column, failed_runs: Column, quality_score: Column, failed_checks: Column) -> Column:
    """What to look into, as an array; one that says so if there is nothing."""
    found = F.array_compact(
        F.array(
            F.when(success_rate < 95, "review failed runs"),
            F.when(failed_runs > 5, "add monitoring of failures"),
            F.when(quality_score < 90, "add validation rules"),
            F.when(failed_checks > 0, "review failed checks"),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("keep going")))


def report_health(success_rate: Column, quality_score: Column) -> Column:
    worst = F.least(success_rate, quality_score)
    return F.when(worst < 80, "needs_attention").when(worst < 90, "fair").otherwise("good")


def error_summary(errors: DataFrame) -> DataFrame:
    """Errors of each severity, those that don't occur included, and how many are open."""
    spine = errors.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = errors.groupBy("severity").agg(F.count("*").alias("errors"), F.count_if(~F.col("is_resolved")).alias("open"))
    return spine.join(counts, "severity", "left").fillna(0, ["errors", "open"])


def error_trend(errors: DataFrame, at: str) -> DataFrame:
    """Errors of each day, a column for each severity."""
    days = errors.groupBy(F.to_date(at).alias("day")).pivot("severity", list(SEVERITIES)).agg(F.count(F.lit(1)))
    return days.select("day", *(F.coalesce(s, F.lit(0)).alias(s.lower()) for s in SEVERITIES))


def rejection_summary(rejected: DataFrame) -> DataFrame:
    n = F.count("*")
    return rejected.agg(n.alias("total_rejected"), F.count_if("can_retry").alias("can_retry"), F.count_if("is_resolved").alias("resolved"), (n - F.count_if("is_resolved")).alias("unresolved"), rate(F.count_if("is_resolved"), n).alias("resolution_rate"))


def dependency_status(dependencies: DataFrame, executions: DataFrame) -> DataFrame:
    """Each active dependency with the parent's latest status and whether it is met."""
    cols = ["job_id", "start_time", "execution_id", "status", "records_successful"]
    last = latest_by_key(executions.select(*cols), ["job_id"], ["start_time", "execution_id"]).withColumnRenamed("job_id", "parent_job_id")
    rows = dependencies.where("is_active").join(last, "parent_job_id", "left")
    met = (
        F.when(F.col("status").isNull(), False)
        .when(F.col("dependency_type") == "SUCCESS", F.col("status") == "SUCCESS")
        .when(F.col("dependency_type") == "COMPLETION", F.col("status").isin("SUCCESS", "FAILED"))
        .otherwise((F.col("status") == "SUCCESS") & (F.col("records_successful") > 0))
    )
    return rows.select("parent_job_id", "child_job_id", "dependency_type", F.col("status").alias("parent_status"), met.alias("is_met"))


def executable_jobs(jobs: DataFrame, dependencies: DataFrame, executions: DataFrame) -> DataFrame:
    """Jobs all of whose dependencies are met, those without any included."""
    state = dependency_status(dependencies, executions).groupBy(F.col("child_job_id").alias("job_id")).agg(F.count("*").alias("dependencies"), F.bool_and("is_met").alias("ready"))
    rows = jobs.select("job_id").join(state, "job_id", "left")
    return rows.where("coalesce(ready, true)").select("job_id", F.coalesce("dependencies", F.lit(0)).alias("dependencies"))


def triggered(parents: DataFrame, dependencies: DataFrame, executions: DataFrame) -> DataFrame:
    """Children of the given parents (job_id) that can run now."""
    children = dependencies.where("is_active").join(parents.select(F.col("job_id").alias("parent_job_id")).distinct(), "parent_job_id", "left_semi")
    return executable_jobs(children.select(F.col("child_job_id").alias("job_id")).distinct(), dependencies, executions)


def lineage_graph(edges: DataFrame) -> DataFrame:
    """Nodes of a lineage (entity.field) with the edges that enter and leave them."""
    name = lambda side: F.concat_ws(".", f"{side}_entity", f"{side}_field")
    ends = edges.select(name("source").alias("node"), F.lit(1).alias("leaving"), F.lit(0).alias("entering")).unionAll(edges.select(name("target"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("leaving").alias("leaving"), F.sum("entering").alias("entering"))


def retention(executions: DataFrame, now: datetime) -> DataFrame:
    """executions with `action`: purge, archive, drop (old failures), reset (stuck runs) or keep."""
    kind = dict(executions.dtypes)["start_time"]
    older = lambda **x: F.col("start_time") < F.lit(now - timedelta(**x)).cast(kind)
    action = (
        F.when(older(days=PURGE_DAYS), "purge")
        .when((F.col("status") == "FAILED") & older(days=FAILED_DAYS), "drop")
        .when((F.col("status") == "RUNNING") & older(hours=RESET_HOURS), "reset")
        .when(older(days=ARCHIVE_DAYS), "archive")
        .otherwise("keep")
    )
    return executions.withColumn("action", action)


def _told(name: Column, table: tuple, miss: str) -> Column:
    out = F.when(F.lit(False), "")
    for words, what in table:
        out = out.when(reduce(lambda a, b: a | b, (name.contains(w) for w in words)), what)
    return out.otherwise(miss)


def error_type(name: Column) -> Column:
    """The kind of error that an exception's name tells."""
    return _told(name, ERROR_TYPES, "UNKNOWN_ERROR")


def error_severity(name: Column) -> Column:
    return _told(name, ERROR_SEVERITIES, "LOW")


def execution_metrics(executions: DataFrame) -> DataFrame:
    """Records a second and error rate of each run that ended."""
    return executions.where("end_time IS NOT NULL").select(
        "execution_id",
        F.round(F.try_divide(F.col("records_processed").cast("double"), seconds()), 4).alias("records_per_second"),
        rate(F.col("records_failed"), F.col("records_processed")).alias("error_rate"),
    )


def period_metrics(executions: DataFrame, now: datetime, period: str = "24h") -> DataFrame:
    """Mean minutes, records, success rate and records an hour of a period."""
    rows = since(executions, "start_time", now, period)
    hours = period_days(period) * 24
    records = F.coalesce(F.sum("records_processed"), F.lit(0))
    return rows.agg(F.count("*").alias("runs"), F.round(F.avg(seconds() / 60), 4).alias("avg_minutes"), records.alias("records"), rate(_is("SUCCESS"), F.count("*")).alias("success_rate"), F.round(records / hours, 4).alias("records_per_hour"))


def table_counts(tables: dict[str, tuple[DataFrame, str]], now: datetime, period: str = "24h") -> DataFrame:
    """Rows of each table (by name: table and time column), all and of the last period."""
    cut = now - timedelta(days=period_days(period))
    each = [df.agg(F.count("*").alias("total"), F.count_if(F.col(at).cast("timestamp") >= F.lit(cut).cast("timestamp")).alias("recent")).select(F.lit(name).alias("table_name"), "total", "recent") for name, (df, at) in tables.items()]
    return reduce(lambda a, b: a.unionAll(b), each)
