"""Grouping and aggregation from declared keys and measures.

Whatever a partial aggregate can hold goes through one groupBy. Measures that need the
values of a group together (mode, entropy) are counted by value first, so that a hot group
never meets in one task as rows; exact percentiles of very large groups have a form of
their own that looks at the few values near the wanted rank only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from millrace.functions.expressions import parse

GRANULARITIES = ("minute", "hour", "day", "week", "month", "quarter", "year")
STEPS = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTHS", "year": "1"}
OUTLIER_REACH = 1.5


@dataclass
class Key:
    """A grouping key: a column, and at most one of the things that may be made of it."""

    column: str
    alias: str | None = None
    granularity: str | None = None
    ranges: list[float] | None = None
    labels: list[str] | None = None
    quantiles: int | None = None
    mapping: dict[str, str] | None = None
    transform: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.column


@dataclass
class Measure:
    """An aggregate of a column, of all rows of a group or of those that meet a condition."""

    source: str
    kind: str
    target: str | None = None
    condition: str | None = None
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.target or f"{self.source}_{self.kind}"


def time_bucket(c: Column, granularity: str) -> Column:
    """Start of the minute or hour, date of the day, Monday, or start of the month or quarter; the year as a number."""
    if granularity in ("minute", "hour"):
        return F.date_trunc(granularity, c)
    if granularity == "year":
        return F.year(c)
    if granularity not in GRANULARITIES:
        raise ValueError(f"no granularity {granularity}")
    return F.to_date(F.date_trunc(granularity, c))


def range_bucket(c: Column, bounds: list[float], labels: list[str]) -> Column:
    """Right-closed ranges up to each bound, and one beyond the last; null stays null."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("ranges take one label more than they have bounds")
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels, strict=False):
        out = out.when(c <= bound, label)
    return out.otherwise(labels[-1])


def quantile_bounds(df: DataFrame, column: str, n: int) -> list[float]:
    """The n - 1 inner bounds of n equally full buckets: a few numbers, exact."""
    found = bracketed_percentiles(df, [], column, [k / n for k in range(1, n)]).first()
    return found["percentiles"] if found else [0.0] * (n - 1)


def mapped_bucket(c: Column, mapping: dict[str, str], miss: str = "Other") -> Column:
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c.cast("string")), F.lit(miss))


#: What a key's values may be turned into.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "upper": lambda c: F.upper(c.cast("string")),
    "lower": lambda c: F.lower(c.cast("string")),
    "length": lambda c: F.length(c.cast("string")),
    "round": lambda c: F.bround(c, 0),
    "abs": F.abs,
    "log": lambda c: F.ln(F.nullif(c, F.lit(0))),
}


def key_column(df: DataFrame, key: Key) -> Column:
    c = F.col(key.column)
    if key.granularity:
        return time_bucket(c, key.granularity)
    if key.ranges is not None:
        return range_bucket(c, key.ranges, key.labels or [f"R{i + 1}" for i in range(len(key.ranges) + 1)])
    if key.quantiles:
        return range_bucket(c, quantile_bounds(df, key.column, key.quantiles), [f"Q{i + 1}" for i in range(key.quantiles)])
    if key.mapping is not None:
        return mapped_bucket(c, key.mapping)
    return TRANSFORMS[key.transform](c) if key.transform else c


def _listed(c: Column, condition: Column | None, keep_null: bool) -> Column:
    """All values in order; a struct around each keeps nulls."""
    item = F.struct(c.alias("v"))
    kept = condition if keep_null else c.isNotNull() if condition is None else condition & c.isNotNull()
    rows = F.collect_list(item if kept is None else F.when(kept, item))
    return F.transform(F.sort_array(rows), lambda x: x.v)


#: Measures that one partial aggregate holds: (value, parameters) to an aggregate. Nulls don't count.
MEASURES: dict[str, Callable[[Column, dict[str, Any]], Column]] = {
    "sum": lambda c, p: F.coalesce(F.sum(c), F.lit(0)),
    "count": lambda c, p: F.count(c),
    "avg": lambda c, p: F.avg(c),
    "mean": lambda c, p: F.avg(c),
    "min": lambda c, p: F.min(c),
    "max": lambda c, p: F.max(c),
    "median": lambda c, p: F.median(c),
    "stddev": lambda c, p: F.stddev_samp(c),
    "variance": lambda c, p: F.var_samp(c),
    "std": lambda c, p: F.stddev_pop(c),
    "var": lambda c, p: F.var_pop(c),
    "percentile": lambda c, p: F.percentile(c, F.lit(p.get("p", 50) / 100)),
    "percentile_25": lambda c, p: F.percentile(c, F.lit(0.25)),
    "percentile_75": lambda c, p: F.percentile(c, F.lit(0.75)),
    "iqr": lambda c, p: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25)),
    "quartiles": lambda c, p: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))),
    "first": lambda c, p: F.min_by(c, F.when(c.isNotNull(), F.struct(*p["order"]))),
    "last": lambda c, p: F.max_by(c, F.when(c.isNotNull(), F.struct(*p["order"]))),
    "unique_count": lambda c, p: F.approx_count_distinct(c) if p.get("approximate") else F.count_distinct(c),
    "concat": lambda c, p: F.listagg(c.cast("string"), F.lit(p.get("separator", ", "))) if p.get("any_order") else F.array_join(_listed(c.cast("string"), None, False), p.get("separator", ", ")),
    "weighted_avg": lambda c, p: F.try_divide(F.sum(c * F.col(p["weight"])), F.sum(F.when(c.isNotNull(), F.col(p["weight"])))),
    "harmonic_mean": lambda c, p: F.coalesce(F.try_divide(F.count_if(c > 0).cast("double"), F.sum(F.when(c > 0, 1 / F.nullif(c.cast("double"), F.lit(0.0))))), F.lit(0.0)),
    "geometric_mean": lambda c, p: F.exp(F.avg(F.when(c > 0, F.ln(c)))),
    "correlation": lambda c, p: F.corr(c, F.col(p["with"])),
    "skew": lambda c, p: F.skewness(c),
    "kurtosis": lambda c, p: F.kurtosis(c),
}
MEASURES["group_concat"] = MEASURES["concat"]
#: Measures by rank, and the shares of a group below the values that they need.
RANKED: dict[str, Callable[[dict[str, Any]], list[float]]] = {
    "median": lambda p: [0.5],
    "percentile": lambda p: [p.get("p", 50) / 100],
    "percentile_25": lambda p: [0.25],
    "percentile_75": lambda p: [0.75],
    "iqr": lambda p: [0.25, 0.75],
    "quartiles": lambda p: [0.25, 0.5, 0.75],
    "outlier_count": lambda p: [0.25, 0.75],
}
#: Rows of a group beyond which its ranks are bracketed first, as its counts by value may not fit a task.
LARGE = 1_000_000
#: Bytes that a row has at the least, by which small tables are known to have no large group.
LEAST_ROW = 8
#: Measures over the counts of a group's values, made by a second aggregate.
BY_VALUE = ("mode", "entropy")
#: Measures that compare values with something of their whole group.
TWO_PASS = ("outlier_count",)


def _value(df: DataFrame, m: Measure, nulls: str) -> Column:
    c = F.col(m.source)
    if nulls == "zero" and isinstance(df.schema[m.source].dataType, NumericType):
        c = F.coalesce(c, F.lit(0))
    elif nulls == "error":
        c = F.when(c.isNull(), F.raise_error(F.lit(f"{m.source} is null")).cast(df.schema[m.source].dataType)).otherwise(c)
    return c


def measure(m: Measure, c: Column) -> Column:
    """The aggregate of one measure; null for a group in which no row meets its condition."""
    met = parse(m.condition) if m.condition else None
    if m.kind == "list":
        out = _listed(c, met, True)
    elif m.kind in MEASURES:
        out = MEASURES[m.kind](c if met is None else F.when(met, c), m.params)
    else:
        raise ValueError(f"no measure {m.kind}")
    return (out if met is None else F.when(F.count_if(met) > 0, out)).alias(m.name)


def _by_value(rows: DataFrame, keys: list[str], m: Measure, c: Column) -> DataFrame:
    met = parse(m.condition) if m.condition else F.lit(True)
    counts = rows.where(met & c.isNotNull()).groupBy(*keys, c.alias("_v")).agg(F.count("*").alias("_n"))
    if m.kind == "mode":
        return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))["v"].alias(m.name))
    bits = F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")
    return counts.groupBy(*keys).agg(bits.alias(m.name))


def _ranks(rows: DataFrame, keys: list[str], m: Measure, c: Column) -> DataFrame:
    """keys and the values at the measure's ranks, as an array `p`, of groups of any size."""
    met = parse(m.condition) if m.condition else F.lit(True)
    return bracketed_percentiles(rows.where(met).select(*keys, c.cast("double").alias("_value")), keys, "_value", RANKED[m.kind](m.params)).withColumnRenamed("percentiles", "p")


def _ranked(rows: DataFrame, keys: list[str], m: Measure, c: Column) -> DataFrame:
    p = F.col("p")
    shown = p if m.kind == "quartiles" else p[1] - p[0] if m.kind == "iqr" else p[0]
    return _ranks(rows, keys, m, c).select(*keys, shown.alias(m.name))


def _outliers(rows: DataFrame, keys: list[str], m: Measure, c: Column, large: bool = False) -> DataFrame:
    """Values more than 1.5 quartile distances outside the quartiles."""
    met = parse(m.condition) if m.condition else F.lit(True)
    values = rows.where(met).withColumn("_v", c)
    if large:
        fences = _ranks(rows, keys, m, c).select(*keys, F.col("p")[0].alias("_a"), F.col("p")[1].alias("_b"))
    else:
        fences = values.groupBy(*keys).agg(F.percentile("_v", F.lit(0.25)).alias("_a"), F.percentile("_v", F.lit(0.75)).alias("_b"))
    counts = values.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    reach = OUTLIER_REACH * (F.col("_b") - F.col("_a"))
    out = (F.col("_v") < F.col("_a") - reach) | (F.col("_v") > F.col("_b") + reach)
    return counts.join(fences, keys).groupBy(*keys).agg(F.sum(F.when(out, F.col("_n")).otherwise(0)).alias(m.name))


def _has_large_group(rows: DataFrame, keys: list[str], large: int) -> bool:
    """Whether a group has more rows than that: counted, unless the table is known to be too small for it."""
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < large * LEAST_ROW:
        return False
    return (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > large


def aggregate(df: DataFrame, keys: list[Key], measures: list[Measure], nulls: str = "ignore", large: int = LARGE) -> DataFrame:
    """One row for each group: its keys and measures. Without keys, one row for all.

    Groups with a null key are left out, and so are keys whose column the table lacks.
    nulls: 'ignore' them, count them as 'zero', or end with an 'error'. Without measures the
    distinct keys come back. Measures by rank keep a group's counts by value in one task, unless a group has more than
    `large` rows: then they come from bracketed_percentiles(), for which rows are counted first.
    """
    keys = [k for k in keys if k.column in df.columns]
    names = [k.name for k in keys]
    rows = df.withColumns({f"_key{i}": key_column(df, k) for i, k in enumerate(keys)}) if keys else df.withColumn("_key0", F.lit(0))
    own = [f"_key{i}" for i in range(max(1, len(keys)))]
    if keys:
        rows = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in own)))
    named = lambda out: out.select(*(F.col(k).alias(n) for k, n in zip(own, names, strict=False)), *out.columns[len(own) :])
    if not measures:
        return named(rows.select(*own).distinct())
    big = any(m.kind in RANKED for m in measures) and _has_large_group(rows, own, large)
    plain = [m for m in measures if m.kind not in BY_VALUE and m.kind not in TWO_PASS and not (big and m.kind in RANKED)]
    if keys:
        out = rows.groupBy(*own).agg(F.count("*").alias("_rows"), *(measure(m, _value(df, m, nulls)) for m in plain))
    else:  # of no rows, too, there is one result
        out = rows.agg(F.count("*").alias("_rows"), *(measure(m, _value(df, m, nulls)) for m in plain)).select(F.lit(0).alias("_key0"), "*")
    for m in measures:
        if m not in plain:
            c = _value(df, m, nulls)
            more = _by_value(rows, own, m, c) if m.kind in BY_VALUE else _outliers(rows, own, m, c, big) if m.kind in TWO_PASS else _ranked(rows, own, m, c)
            out = out.join(more, own, "left")
    out = out.select(*own, *(m.name for m in measures))
    return named(out) if keys else out.drop("_key0")


def bracketed_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """The exact interpolated percentiles of groups of any size, as an array `percentiles` in order of shares.

    A first pass brackets the wanted ranks by approximate percentiles; of the second only the
    counts below the brackets and the values within them - some ten-thousandths of a group -
    are gathered. Groups too small for that to be worth it count whole.
    """
    v, reach, m = F.col(value), 2 / accuracy, len(shares)
    rows = df.where(v.isNotNull() & reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True))).select(*keys, value).withColumn("_one", F.lit(1))
    own = [*keys, "_one"]
    ends = F.percentile_approx(value, [x for p in shares for x in (max(0.0, p - reach), min(1.0, p + reach))], accuracy)
    bounds = rows.groupBy(*own).agg(F.count("*").alias("_n"), ends.alias("_b"))
    bounds = bounds.select(*own, "_n", F.when(F.col("_n") > 2 * accuracy, F.col("_b")).alias("_b"))
    near = rows.join(bounds, own)
    below = near.groupBy(*own).agg(F.first("_n").alias("_n"), F.array(*(F.count_if(v < F.col("_b")[2 * i]) for i in range(m))).alias("_below"))
    within = F.filter(F.array(*(F.lit(i) for i in range(m))), lambda i: F.col("_b").isNull() | ((v >= F.col("_b")[2 * i]) & (v <= F.col("_b")[2 * i + 1])))
    inside = near.select(*own, v.alias("_v"), F.explode(within).alias("_i")).groupBy(*own, "_i", "_v").agg(F.count("*").alias("_c"))
    up_to = Window.partitionBy(*own, "_i").orderBy("_v")
    ranked = inside.join(below, own).withColumn("_to", F.col("_below")[F.col("_i")] + F.sum("_c").over(up_to)).withColumn("_from", F.col("_to") - F.col("_c"))
    wanted = F.array(*(F.lit(float(p)) for p in shares))[F.col("_i")] * (F.col("_n") - 1)
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("_v")))
    found = ranked.groupBy(*own, "_i").agg(F.max(wanted).alias("_r"), at(F.floor(wanted)).alias("_x"), at(F.ceil(wanted)).alias("_y"))
    told = F.struct("_i", (F.col("_x") + (F.col("_r") - F.floor("_r")) * (F.col("_y") - F.col("_x"))).alias("p"))
    return found.groupBy(*own).agg(F.transform(F.sort_array(F.collect_list(told)), lambda x: x.p).alias("percentiles")).drop("_one")


def hierarchy(df: DataFrame, levels: list[str], measures: list[Measure]) -> DataFrame:
    """Every prefix of levels as groups of its own, from the rows themselves; `hierarchy_level` counts the keys in use."""
    rows = df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in levels)))
    out = rows.rollup(*levels).agg(F.grouping_id().alias("_g"), *(measure(m, F.col(m.source)) for m in measures))
    depth = len(levels) - F.bit_count("_g")
    return out.where(depth > 0).select(*levels, depth.cast("int").alias("hierarchy_level"), *(m.name for m in measures))


def cube(df: DataFrame, keys: list[str], measures: list[Measure], sets: str = "cube") -> DataFrame:
    """All combinations of keys (`cube`) or all prefixes with the grand total (`rollup`); `grouping` tells rows of aggregated keys from those of null ones."""
    grouped = df.cube(*keys) if sets == "cube" else df.rollup(*keys)
    return grouped.agg(F.grouping_id().alias("grouping"), *(measure(m, F.col(m.source)) for m in measures))


def pivot(df: DataFrame, rows: str, columns: str, value: str, values: list[Any], order: list[str], fill: Any = 0) -> DataFrame:
    """The first value of each row and column, by order; `values` are the columns, so that no pass looks for them."""
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    out = df.groupBy(rows).pivot(columns, values).agg(first)
    return out.select(rows, *(F.coalesce(F.col(f"`{v}`"), F.lit(fill)).alias(str(v)) for v in values))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[Any]) -> DataFrame:
    """How often each pair of values occurs."""
    out = df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1)))
    return out.select(rows, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in values))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count, mean, std, min, max and sum, from one aggregate."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    one = df.agg(*(F.struct(*(f(c).cast("double").alias(n) for n, f in stats.items())).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{c}.{n}").alias(n) for n in stats)) for c in columns))
    return one.select(F.inline(rows))


def top_values(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """The most frequent values of each column, and how many it has; ties by value."""
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = df.select(F.inline(each)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    unique = counts.groupBy("column_name").agg(F.count("*").alias("unique_values"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= most).join(unique, "column_name")


def compression(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in, rows out and their ratio."""
    one, none = F.lit(1), F.lit(0)
    rows = before.select(one.alias("i"), none.alias("o")).unionAll(after.select(none, one))
    counts = rows.agg(F.coalesce(F.sum("i"), none).cast("long").alias("input_rows"), F.coalesce(F.sum("o"), none).cast("long").alias("output_rows"))
    return counts.withColumn("ratio", F.try_divide(F.col("input_rows").cast("double"), F.col("output_rows").cast("double")))


def fill_periods(df: DataFrame, period: str, granularity: str, keys: list[str], fills: dict[str, Any]) -> DataFrame:
    """df with a row for each period between the first and the last of its group."""
    own = [*keys, "_all"] if not keys else keys
    rows = df if keys else df.withColumn("_all", F.lit(0))
    spans = rows.groupBy(*own).agg(F.min(period).alias("_a"), F.max(period).alias("_b"))
    spine = spans.select(*own, F.explode(F.expr(f"sequence(_a, _b, {STEPS[granularity]})")).alias(period))
    return spine.join(rows, [*own, period], "left").fillna(fills).select(*df.columns)
