"""Profiles of tables: counts, lengths, types and samples of every column.

Counts, lengths and types come from one aggregate over any number of columns; what needs distinct
values gets them as digests or below a bound, so that long texts are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, _parse_datatype_string

SAMPLES = 10
#: Rows that give a first bound of the samples.
HEAD = 10_000
LEAST_SHARE = 0.8
#: Logarithm of the number of registers of a sketch: 2^14 give a standard error of about 0.8 percent.
SKETCH_BITS = 14
# Texts of truth values and patterns of dates.
TRUTH = ("true", "false", "1", "0", "yes", "no", "y", "n")
DATE_PATTERNS = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}/\d{2}/\d{2}")


def looks_like_date(c: Column) -> Column:
    return F.trim(c).rlike("^(?:" + "|".join(DATE_PATTERNS) + ")")


def _counts(df: DataFrame, columns: list[str]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    return df.select(F.inline(each)).groupBy("position", "column_name", "value").agg(F.count("*").alias("n"))


def _distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and unique_count. Values of more than 16 bytes travel as their 128-bit digest, and a task hands on each once."""
    value = lambda c: F.col(c).cast("string").cast("binary")
    short = lambda c: F.octet_length(value(c)) <= 16
    each = F.array(*(F.struct(F.lit(i).alias("position"), short(c).alias("short"), F.when(short(c), value(c)).otherwise(F.unhex(F.md5(value(c)))).alias("mark")) for i, c in enumerate(columns)))
    marks = df.select(F.inline(each)).where("mark IS NOT NULL").distinct()
    return marks.groupBy("position").agg(F.count("*").alias("unique_count"))


def _measures(columns: list[str], sketched: bool) -> list[Column]:
    """A struct for each column: position, name, counts and lengths, and with `sketched` a sketch of its distinct values."""
    measures = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("string")
        filled = v.isNotNull() & (v != "")
        number = F.replace(v, F.lit(","), F.lit("")).try_cast("double").isNotNull()
        tests = {"given": v.isNotNull(), "filled": filled, "truth": filled & F.lower(v).isin(*TRUTH), "number": filled & number, "date": filled & looks_like_date(v)}
        lengths = {"min_length": F.min(F.length(v)), "max_length": F.max(F.length(v))}
        parts = {k: F.count_if(F.coalesce(t, F.lit(False))) for k, t in tests.items()} | lengths
        if sketched:
            parts["sketch"] = F.hll_sketch_agg(v, F.lit(SKETCH_BITS))
        measures.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), *(m.alias(k) for k, m in parts.items())).alias(f"c{i}"))
    return measures


def _shown(told: DataFrame) -> DataFrame:
    """The profile from counts: shares and the type that texts look like."""
    most = lambda c: F.col(c) / F.col("filled") > LEAST_SHARE
    kind = F.when(F.col("filled") == 0, "STRING").when(F.col("truth") == F.col("filled"), "BOOLEAN").when(most("number"), "NUMBER").when(most("date"), "DATE").otherwise("STRING")
    total = F.col("total_count")
    return told.select(
        "column_name",
        "position",
        kind.alias("data_type"),
        "total_count",
        (total - F.col("given")).alias("null_count"),
        "unique_count",
        F.bround(F.try_divide((total - F.col("given")) * 100.0, total), 2).alias("null_percentage"),
        F.round(F.try_divide(F.col("given").cast("double"), total.cast("double")), 6).alias("completeness_ratio"),
        F.round(F.try_divide(F.col("unique_count").cast("double"), F.col("given")), 6).alias("uniqueness_ratio"),
        "min_length",
        "max_length",
    )


def profile(df: DataFrame, columns: list[str] | None = None, exact: list[str] | None = None) -> DataFrame:
    """A row for each column: position, counts, shares, lengths and the type its texts look like.

    One aggregate of one row gives all but the distinct values. These are counted exactly for the columns in `exact`
    (all, if None), from short values and digests of longer ones; for others by a sketch in the same aggregate, within some
    two percent.
    """
    columns = columns or df.columns
    exact = columns if exact is None else exact
    sketched = len(exact) < len(columns)
    one = df.agg(F.count("*").alias("total_count"), *_measures(columns, sketched))
    told = one.select("total_count", F.inline(F.array(*(f"c{i}" for i in range(len(columns))))))
    about = F.hll_sketch_estimate("sketch") if sketched else F.lit(0).cast("long")
    if exact:
        at = _distinct(df, exact).withColumn("column_name", F.element_at(F.array(*map(F.lit, exact)), F.col("position") + 1)).drop("position")
        told = told.join(at, "column_name", "left")
        about = F.when(F.col("column_name").isin(*exact), F.coalesce("unique_count", F.lit(0))).otherwise(about)
    return _shown(told.withColumn("unique_count", about))


def summaries(df: DataFrame, columns: list[str] | None = None, by: str | None = None) -> DataFrame:
    """What profiles are merged from: for each part of df, by a column, a row for each column with counts, lengths and a sketch of a few KB."""
    columns = columns or [c for c in df.columns if c != by]
    parts = df.groupBy(*([by] if by else [])).agg(F.count("*").alias("total_count"), *_measures(columns, True))
    return parts.select(*([by] if by else []), "total_count", F.inline(F.array(*(f"c{i}" for i in range(len(columns))))))


def merged_profile(parts: DataFrame) -> DataFrame:
    """The profile of all parts together, without reading their rows again; distinct values within some two percent."""
    sums = {c: F.sum(c) for c in ("total_count", "given", "filled", "truth", "number", "date")}
    rest = {"min_length": F.min("min_length"), "max_length": F.max("max_length"), "unique_count": F.hll_sketch_estimate(F.hll_union_agg("sketch"))}
    return _shown(parts.groupBy("position", "column_name").agg(*(m.alias(k) for k, m in (sums | rest).items())))


def profile_of_files(spark: SparkSession, files: list[str], kept: str, columns: list[str]) -> DataFrame:
    """The profile of Parquet files, of which only those are read that `kept`, a table of summaries, doesn't know yet; theirs are added to it.

    A file is known by its path as given, and summarised by itself, so that what a failed run has read stays known.
    """
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    there = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(home)
    schema = "part string, " + ", ".join(f"{c} long" for c in ("total_count", "given", "filled", "truth", "number", "date")) + ", position int, column_name string, min_length int, max_length int, sketch binary"
    old = spark.read.schema(schema).parquet(kept) if there else None
    known = {r.part for r in old.select("part").distinct().collect()} if there else set()
    for file in sorted(set(files) - known):
        fresh = summaries(spark.read.parquet(file), columns).withColumn("part", F.lit(file))
        fresh.coalesce(1).write.mode("append").parquet(kept)
    now = spark.read.schema(schema).parquet(kept)
    return merged_profile(now.where(F.col("part").isin(*files)))


def samples(df: DataFrame, columns: list[str] | None = None, most: int = SAMPLES) -> DataFrame:
    """The first distinct values of each column in order.

    A few rows give, for each column, a value that at least so many distinct ones don't exceed;
    only values up to it, a small part of all, are counted and ranked.
    """
    columns = columns or df.columns
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("value"))
    head = _counts(df.limit(HEAD), columns).where("value IS NOT NULL")
    bounds = {r["column_name"]: r["value"] for r in head.withColumn("_rn", place).where(F.col("_rn") == most).collect()}  # a row for each column
    near = df.select(*(F.when(F.col(c).cast("string") <= F.lit(bounds[c]), F.col(c).cast("string")).alias(c) if c in bounds else F.col(c) for c in columns))
    top = _counts(near, columns).where("value IS NOT NULL").withColumn("_rn", place).where(F.col("_rn") <= most)
    return top.groupBy("column_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "value"))), lambda x: x.value).alias("sample_values"))


def schema_fields(schema: StructType, prefix: str = "", level: int = 0) -> list[tuple[str, str, int]]:
    """Dotted path, kind (primitive, object, array) and nesting level of each field."""
    out = []
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        inner: DataType = kind.elementType if isinstance(kind, ArrayType) else kind
        out.append((path, "array" if isinstance(kind, ArrayType) else "object" if isinstance(kind, StructType | MapType) else "primitive", level))
        if isinstance(inner, StructType):
            out += schema_fields(inner, path + ".", level + 1)
    return out


def json_schema(df: DataFrame, column: str) -> StructType:
    """The structure that the JSON objects of a column have together, from one aggregate; texts that are no object are left out."""
    value = F.try_parse_json(F.col(column))
    told = df.where(F.schema_of_variant(value).startswith("OBJECT")).agg(F.schema_of_variant_agg(value)).first()[0]
    kind = _parse_datatype_string((told or "OBJECT<>").replace("OBJECT<", "STRUCT<"))
    return kind if isinstance(kind, StructType) else StructType()


def json_fields(df: DataFrame, column: str) -> DataFrame:
    """path, kind, level and present (records that have it) of each field of the JSON objects in a column; fields within arrays aren't counted.

    The structure is merged from all records; a second aggregate counts its fields.
    """
    fields = schema_fields(json_schema(df, column))
    arrays = [path for path, kind, _ in fields if kind == "array"]
    steps = lambda path: "".join(f'["{x}"]' for x in path.split("."))
    value = F.try_parse_json(F.col(column))
    there = lambda path: F.count(F.try_variant_get(value, F.lit("$" + steps(path)), "variant")) if not any(path.startswith(a + ".") for a in arrays) else F.lit(None).cast("long")
    rows = [F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), F.col(f"n{i}").alias("present")) for i, (path, kind, level) in enumerate(fields)]
    if not rows:
        return df.sparkSession.createDataFrame([], "path string, kind string, level int, present long")
    return df.agg(*(there(path).alias(f"n{i}") for i, (path, _, _) in enumerate(fields))).select(F.inline(F.array(*rows)))


def value_mismatches(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """column_name, expected, checked and mismatched: values, neither null nor empty, that the expected type doesn't take. One aggregate for all columns."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    one = df.agg(*(F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("expected"), F.count_if(given(c)).alias("checked"), F.count_if(given(c) & F.col(c).cast("string").try_cast(kind).isNull()).alias("mismatched")).alias(f"c{i}") for i, (c, kind) in enumerate(expected.items())))
    return one.select(F.inline(F.array(*(f"c{i}" for i in range(len(expected))))))


def depth(schema: StructType) -> int:
    return 1 + max((level for _, _, level in schema_fields(schema)), default=0)


def completeness(df: DataFrame, required: list[str]) -> DataFrame:
    """Records with all required fields, and how often each is missing, in one aggregate."""
    missing = {c: F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required}
    some = reduce(lambda a, b: a | b, missing.values())
    one = df.agg(F.count("*").alias("total"), F.count_if(some).alias("incomplete"), *(F.count_if(m).alias(f"missing_{c}") for c, m in missing.items()))
    return one.withColumn("complete", F.col("total") - F.col("incomplete")).withColumn("completeness_rate", F.round(F.try_divide(F.col("complete") * 100.0, F.col("total")), 6))


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct and repeated values of each column, nulls aside."""
    counts = _counts(df, columns).where("value IS NOT NULL")
    told = counts.groupBy("column_name").agg(F.sum("n").alias("total"), F.count("*").alias("unique_count"))
    return told.withColumn("duplicate_count", F.col("total") - F.col("unique_count")).withColumn("uniqueness_rate", F.round(F.col("unique_count") * 100.0 / F.col("total"), 6))


def duplicate_pairs(df: DataFrame, column: str, order: str) -> DataFrame:
    """Each repeated row and the first one with its value; the first is found by a partial aggregate."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first_index"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(firsts, column).where(F.col(order) > F.col("first_index")).select(column, "first_index", F.col(order).alias("index"))


def type_mismatches(df: DataFrame, expected: dict[str, str]) -> list[tuple[str, str, str]]:
    """(column, expected, actual) of columns whose type isn't the expected one; missing ones have none."""
    actual = dict(df.dtypes)
    return [(c, want, actual.get(c, "")) for c, want in expected.items() if actual.get(c) != want]
