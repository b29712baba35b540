"""Order over whole tables: row numbers, rolling aggregates and latest rows without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle

#: Rows of a block that one window looks at; the rows that its first windows need are copied to it.
BLOCK = 50_000
_IN_PARTITION = (1 << 33) - 1

ROLLING = {"avg": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}


def numbered(df: DataFrame, order: list[str | Column], name: str = "row_number", unique: list[str] | None = None) -> DataFrame:
    """df with the place of each row, from 1, in a total order.

    Rows are sorted by range and numbered inside their partition; a partition's first number
    is the sum of the counts before it - one row for each partition. The sorted rows are settled:
    all columns of df, or, where `unique` names columns that tell rows apart, only these, and
    the numbers are then joined to df.
    """
    rows = df.orderBy(*order)
    at = settle((rows.select(*unique) if unique else rows).withColumn("_at", F.monotonically_increasing_id()))
    counts = at.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()
    first, rows = 1, []
    for c in counts:
        rows.append((c["_part"], first))
        first += c["_n"]
    starts = df.sparkSession.createDataFrame(rows, "_part long, _first long")
    placed = at.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    told = placed.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))).drop("_at", "_part", "_first")
    return df.join(told, unique) if unique else told


def _rolled(df: DataFrame, w: Window, value: str, window: int, kinds: list[str]) -> DataFrame:
    full = F.count(value).over(w) == window
    return df.withColumns({f"rolling_{k}": F.when(full, ROLLING[k](value).over(w)) for k in kinds})


def rolling(df: DataFrame, order: list[str], value: str, window: int, kinds: list[str], keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Aggregates of the last `window` rows, null until there are as many.

    By keys, each key's rows are a series; without, the whole table is one. Where a series is longer
    than a block, rows are numbered by keys and order, dealt out in blocks, and each block
    gets the few rows before it as well, so that no series is one task's.
    """
    block = max(block, window)
    if keys and df.groupBy(*keys).count().where(F.col("count") > block).isEmpty():
        return _rolled(df, Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - window, 0), value, window, kinds)
    keys = keys or []
    placed = numbered(df, [*keys, *order], "_n").withColumn("_own", F.floor((F.col("_n") - 1) / block))
    also = F.when(F.pmod(F.col("_n") - 1, F.lit(block)) >= block - window + 1, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    dealt = placed.withColumn("_block", F.explode(also))
    out = _rolled(dealt, Window.partitionBy("_block", *keys).orderBy("_n").rowsBetween(1 - window, 0), value, window, kinds)
    return out.where("_block = _own").drop("_n", "_own", "_block")


def buckets(df: DataFrame, keys: list[str], at: str, length: str, measures: list[Column]) -> DataFrame:
    """Measures by keys and `bucket`, the day, hour, week, ... that a time lies in; a partial aggregate."""
    return df.groupBy(*keys, F.date_trunc(length, at).alias("bucket")).agg(*measures)


def latest(df: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each key in order; ranks are cut off before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", place).where(F.col("_rn") <= most).drop("_rn")


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key as a partial aggregate, which no hot key slows down."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
