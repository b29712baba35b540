"""The event feed as a stream: windows, sessions, duplicates, quality, dead letters and routes.

A run takes what has arrived and stops (`available now`), which is how a schedule calls it;
with another trigger the same plans run on. Checkpoints go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_path

LATE = "1 hour"
MOST_RETRIES = 3


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The files of that name in a folder as a stream; ts as a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Take what has arrived and read back what came of it: all rows, or in complete mode the last state."""
    spark, out, state = stream.sparkSession, shared_path(stream.sparkSession), shared_path(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    writer.outputMode(mode).foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{out}/batch={k:09d}")).start().awaitTermination()
    rows = spark.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/batch=*")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch") if mode == "complete" else rows.drop("batch")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    """Hand every batch to write(rows, number); a batch that was handed over before a failure comes again with its number."""
    stream.writeStream.option("checkpointLocation", shared_path(stream.sparkSession)).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def windowed_counts(stream: DataFrame, length: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events and their values by window and type; tumbling, or sliding with `slide`."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Runs of a user's events with less than `gap` between neighbours."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(stream: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first event of each key; keys are forgotten when the watermark passes them."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def subscribed(stream: DataFrame, kinds: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Events of some types that meet a predicate."""
    rows = stream.where(F.col("event_type").isin(*kinds)) if kinds else stream
    return rows.where(predicate) if predicate is not None else rows


def unexpired(stream: DataFrame, now: Any, ttl: str) -> DataFrame:
    """Messages whose time to live isn't over."""
    return stream.where(F.col("ts") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {ttl}"))


def with_errors(stream: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """`_errors`: the names of the checks that an event fails."""
    return stream.withColumn("_errors", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()))))


def split_to(stream: DataFrame, accepted: str, rejected: str) -> None:
    """Events without errors to one table, the others with their reason to a second; a batch is read once for both."""

    def write(rows: DataFrame, k: int) -> None:
        rows = rows.persist()
        good = F.size("_errors") == 0
        rows.where(good).drop("_errors").write.mode("overwrite").parquet(f"{accepted}/batch={k:09d}")
        rows.where(~good).withColumn("rejection_reason", F.array_join(F.slice("_errors", 1, 3), "; ")).drop("_errors").write.mode("overwrite").parquet(f"{rejected}/batch={k:09d}")
        rows.unpersist()

    each_batch(stream, write)


def routed_to(stream: DataFrame, path: str, key: str = "event_type") -> None:
    """A channel for each type: a folder of its own."""
    each_batch(stream, lambda rows, k: rows.withColumn("batch", F.lit(k)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, "batch").parquet(path))


def delivered(attempts: Column, ok: Column, most: int = MOST_RETRIES) -> Column:
    """What becomes of a message: delivered, retry, or dead_letter after the last retry."""
    return F.when(ok, "delivered").when(attempts < most, "retry").otherwise("dead_letter")


def deliver(stream: DataFrame, ok: Column, delivered_to: str, dead: str, waiting: str, attempts: str = "attempts", most: int = MOST_RETRIES) -> None:
    """One attempt for every message: those that go through are written to one table, the others wait with one more attempt, and after the last they are dead letters.

    A batch that comes again writes the same folders, so each message has one outcome.
    """

    def write(rows: DataFrame, k: int) -> None:
        told = rows.withColumn("_outcome", delivered(F.col(attempts), F.coalesce(ok, F.lit(False)), most)).persist()
        for outcome, path in (("delivered", delivered_to), ("dead_letter", dead), ("retry", waiting)):
            part = told.where(F.col("_outcome") == outcome).drop("_outcome")
            part = part.withColumn(attempts, F.col(attempts) + 1) if outcome == "retry" else part
            part.write.mode("overwrite").parquet(f"{path}/batch={k:09d}")
        told.unpersist()

    each_batch(stream, write)


def handled_by_type(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], column: str = "event_type") -> None:
    """Each handler gets the events of its type; types without one are left alone. A batch is read once for all."""

    def write(rows: DataFrame, k: int) -> None:
        rows = rows.where(F.col(column).isin(*handlers)).persist()
        for kind, handle in handlers.items():
            handle(rows.where(F.col(column) == kind), k)
        rows.unpersist()

    each_batch(stream, write)


def published_to(stream: DataFrame, path: str, priority: Column, key: str = "event_type") -> None:
    """A channel for each type, and beside these one for each priority: `channel` is type:... or priority:..."""
    channels = F.array(F.concat(F.lit("type:"), F.col(key)), F.concat(F.lit("priority:"), priority))
    each_batch(stream, lambda rows, k: rows.withColumn("channel", F.explode(channels)).withColumn("batch", F.lit(k)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("channel", "batch").parquet(path))


def quality_counts(stream: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A running count of events and of failures of each check."""
    return stream.groupBy().agg(F.count("*").alias("checked"), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in checks.items()))


def user_totals(stream: DataFrame) -> DataFrame:
    """Events, errors and last time of each user so far; what is kept as state are these numbers."""
    last = F.max(F.unix_micros("ts")).alias("last_micros")
    return stream.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), last)
