"""Streams over the event feed, each run until it has taken all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.queries.registry import query
from millrace.session import shared_path
from millrace.streaming import events as s


def _naive(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = s.run(s.windowed_counts(s.event_stream(spark, sf_dir), "1 day"), "complete")
    return _naive(out, "start", "end").withColumn("total", F.round("total", 2))


@query("""SELECT start, start + INTERVAL 1 DAY AS end, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 12 HOUR]) AS start, event_type, value FROM events) GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    out = s.run(s.windowed_counts(s.event_stream(spark, sf_dir), "1 day", "12 hours"), "complete")
    return _naive(out, "start", "end").withColumn("total", F.round("total", 2))


@query("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    return _naive(s.run(s.sessions(s.event_stream(spark, sf_dir), "2 hours"), "complete"), "start", "end")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_closed_windows(spark, sf_dir):
    """Appended for good: only windows that the watermark has passed."""
    return _naive(s.run(s.windowed_counts(s.event_stream(spark, sf_dir), "1 hour")).select("start", "event_type", "n"), "start")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_without_repeats(spark, sf_dir):
    return s.run(s.without_repeats(s.event_stream(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'purchase') AND value > 50")
def stream_subscribed(spark, sf_dir):
    return s.run(s.subscribed(s.event_stream(spark, sf_dir), ["error", "purchase"], F.col("value") > 50).select("event_id", "user_id"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 3 DAY")
def stream_unexpired(spark, sf_dir):
    return s.run(s.unexpired(s.event_stream(spark, sf_dir), "2024-01-20", "3 DAYS").select("event_id"))


def _checks():
    return {"value": F.col("value") <= 200, "user": F.col("user_id") > 5}


@query("SELECT event_id, concat_ws('; ', CASE WHEN value > 200 THEN 'value' END, CASE WHEN user_id <= 5 THEN 'user' END) AS rejection_reason FROM events")
def stream_split(spark, sf_dir):
    good, bad = shared_path(spark), shared_path(spark)
    s.split_to(s.with_errors(s.event_stream(spark, sf_dir), _checks()), good, bad)
    return spark.read.parquet(good).select("event_id", F.lit("").alias("rejection_reason")).unionAll(spark.read.parquet(bad).select("event_id", "rejection_reason"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_routed(spark, sf_dir):
    path = shared_path(spark)
    s.routed_to(s.event_stream(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS checked, count(*) FILTER (value > 200) AS value, count(*) FILTER (user_id <= 5) AS user FROM events".replace("AS user ", 'AS "user" '))
def stream_quality(spark, sf_dir):
    return s.run(s.quality_counts(s.event_stream(spark, sf_dir), _checks()), "complete")


@query("SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, epoch_us(max(ts)) AS last_micros FROM events GROUP BY 1")
def stream_user_totals(spark, sf_dir):
    return s.run(s.user_totals(s.event_stream(spark, sf_dir)), "update")


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN 'delivered' WHEN event_id % 5 < 3 THEN 'retry' ELSE 'dead_letter' END AS outcome FROM events")
def stream_delivered(spark, sf_dir):
    rows = s.event_stream(spark, sf_dir).select("event_id", s.delivered(F.col("event_id") % 5, F.col("event_type") != "error").alias("outcome"))
    return s.run(rows)


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN 'delivered' WHEN event_id % 5 < 3 THEN 'retry' ELSE 'dead_letter' END AS outcome, event_id % 5 + (event_type = 'error' AND event_id % 5 < 3)::INT AS attempts FROM events""")
def stream_retries(spark, sf_dir):
    paths = {outcome: shared_path(spark) for outcome in ("delivered", "dead_letter", "retry")}
    rows = s.event_stream(spark, sf_dir).select("event_id", "event_type", (F.col("event_id") % 5).alias("attempts"))
    s.deliver(rows, F.col("event_type") != "error", *paths.values())
    read = [spark.read.parquet(p).select("event_id", F.lit(outcome).alias("outcome"), "attempts") for outcome, p in paths.items()]
    return read[0].unionAll(read[1]).unionAll(read[2])


@query("SELECT event_type AS handler, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1")
def stream_handlers(spark, sf_dir):
    path = shared_path(spark)
    note = lambda kind: lambda rows, k: rows.agg(F.lit(kind).alias("handler"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/{kind}-{k}")
    s.handled_by_type(s.event_stream(spark, sf_dir), {kind: note(kind) for kind in ("error", "purchase")})
    return spark.read.parquet(f"{path}/*").groupBy("handler").agg(F.sum("n").alias("n"))


@query("SELECT channel, count(*) AS n FROM (SELECT unnest(['type:' || event_type, 'priority:' || CASE WHEN value > 100 THEN 'high' ELSE 'normal' END]) AS channel FROM events) GROUP BY 1")
def stream_published(spark, sf_dir):
    path = shared_path(spark)
    s.published_to(s.event_stream(spark, sf_dir), path, F.when(F.col("value") > 100, "high").otherwise("normal"))
    return spark.read.parquet(path).groupBy("channel").agg(F.count("*").alias("n"))
