"""What happens to records between a source and the first transform."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from millrace.operators.windows import numbered

LONGEST_FIELD, LONGEST_XML, LARGEST_NUMBER = 10_000, 50_000, 1e15
# What spreadsheets show for failed formulas.
FORMULA_ERRORS = ("#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!")


def record_hash(columns: list[str]) -> Column:
    """SHA-256 over all fields in order of name, whatever their order in the table."""
    shown = (F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns))
    return F.sha2(F.concat_ws("|", *shown), 256)


def row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `row_number` from 1 in a total order; no task sees more than its range."""
    return numbered(df, order)


def is_empty(columns: list[str]) -> Column:
    """Whether every field is null or blank."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in columns))


def _texts(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind == "string"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(False))


def csv_checks(df: DataFrame) -> dict[str, Column]:
    """Messages and tests of CSV records; the first two reject."""
    texts = _texts(df)
    return {
        "record is blank": is_empty(df.columns),
        "field too long": _any([F.length(c) > LONGEST_FIELD for c in texts]),
        "unbalanced quotes": _any([F.regexp_count(c, F.lit('"')) % 2 == 1 for c in texts]),
    }


def sheet_checks(df: DataFrame) -> dict[str, Column]:
    texts = _texts(df)
    return {
        "formula error": _any([F.col(c).isin(*FORMULA_ERRORS) for c in texts]),
        "number too large": _any([F.abs(F.col(c).try_cast("double")) > LARGEST_NUMBER for c in texts]),
    }


def json_checks(df: DataFrame, deepest: int = 10) -> dict[str, Column]:
    from millrace.operators.profile import depth

    return {"record is empty": is_empty([c for c, kind in df.dtypes if not kind.startswith(("array", "struct", "map"))] or df.columns), "nested too deeply": F.lit(depth(df.schema) > deepest)}


def xml_checks(df: DataFrame) -> dict[str, Column]:
    texts = _texts(df)
    both = {c for c in df.columns if c.startswith("@") and c[1:] in df.columns}
    return {
        "unescaped markup": _any([F.col(f"`{c}`").rlike(r"[<>]|&(?!\w+;|#)") for c in texts]),
        "text too long": _any([F.length(F.col(f"`{c}`")) > LONGEST_XML for c in texts]),
        "attribute and element share a name": F.lit(bool(both)),
    }


def api_checks(df: DataFrame) -> dict[str, Column]:
    told = [c for c in ("error", "status", "message") if c in df.columns]
    return {"record is empty": is_empty(df.columns), "response tells of an error": _any([F.lower(F.col(c).cast("string")).contains("error") for c in told])}


def checked(df: DataFrame, checks: dict[str, Column], rejecting: list[str]) -> DataFrame:
    """df with `_errors` (of rejecting checks) and `_warnings` (of the others), from one projection."""
    told = lambda names: F.array_compact(F.array(*(F.when(checks[n], F.lit(n)) for n in names))) if names else F.array().cast("array<string>")
    return df.withColumns({"_errors": told([n for n in checks if n in rejecting]), "_warnings": told([n for n in checks if n not in rejecting])})


def split_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without errors, and rejected ones with their first three errors as the reason."""
    bad = F.size("_errors") > 0
    return df.where(~bad), df.where(bad).withColumn("rejection_reason", F.array_join(F.slice("_errors", 1, 3), "; "))


def ingest_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.size("_errors") == 0).alias("successful"), F.count_if(F.size("_errors") > 0).alias("rejected"), F.count_if(F.size("_warnings") > 0).alias("warned"))


def _leaves(schema: StructType, at: str, name: str, sep: str) -> list[tuple[Column, str]]:
    out = []
    for f in schema.fields:
        path, label, c = f"{at}`{f.name}`", f"{name}{f.name}", F.col(f"{at}`{f.name}`")
        if isinstance(f.dataType, StructType):
            out += _leaves(f.dataType, path + ".", label + sep, sep)
        elif isinstance(f.dataType, ArrayType):
            plain = not isinstance(f.dataType.elementType, StructType | ArrayType)
            shown = F.array_join(c.cast("array<string>"), ", ") if plain else F.to_json(c)
            out.append((F.when(F.size(c) > 0, shown), label))
        else:
            out.append((c, label))
    return out


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested fields as columns `a.b.c`; arrays of plain values joined, of records as JSON, empty ones null."""
    return df.select(*(c.alias(n) for c, n in _leaves(df.schema, "", "", sep)))


def separate_records(df: DataFrame, column: str) -> DataFrame:
    """A row for each element of an array column; rows without any stay."""
    return df.withColumn(column, F.explode_outer(column))


def unwrapped(df: DataFrame) -> DataFrame:
    """Arrays of one element become that element where all of a column's have at most one; told by one aggregate."""
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    if not lists:
        return df
    most = df.agg(*(F.max(F.size(c)).alias(c) for c in lists)).first()
    return df.withColumns({c: F.get(c, F.lit(0)) for c in lists if (most[c] or 0) <= 1})


def stamped(df: DataFrame, batch_id: str, **fixed: str) -> DataFrame:
    """df with a batch id and other constant columns."""
    return df.withColumns({"batch_id": F.lit(batch_id)} | {k: F.lit(v) for k, v in fixed.items()})
