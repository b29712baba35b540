"""Field mappings and rule transforms."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import parse
from millrace.operators.normalize import lookup

#: Samples of a dry run.
SAMPLES = 10
TYPES = {"string": "string", "str": "string", "integer": "bigint", "int": "bigint", "float": "double", "number": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}


@dataclass
class Mapping:
    """How a target field is made: direct, calculated, constant or lookup."""

    target: str
    kind: str = "direct"
    source: str | None = None
    expression: str | None = None
    data_type: str | None = None
    required: bool = False
    default: Any = None
    table: str | None = None
    key: str = "id"
    value: str = "code"


def typed(c: Column, data_type: str | None) -> Column:
    return c.try_cast(TYPES[data_type]) if data_type else c


def apply_mappings(df: DataFrame, mappings: list[Mapping], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The mapped fields and `_errors`: required fields that are missing and casts that failed.

    Lookups are left joins; everything else is one projection.
    """
    for m in mappings:
        if m.kind == "lookup":
            df = lookup(df, m.source, tables[m.table], m.key, m.value, f"_lookup_{m.target}")
    out, errors = [], []
    for m in mappings:
        if m.kind == "direct":
            raw = F.col(m.source) if m.source in df.columns else F.lit(None).cast("string")
        elif m.kind == "calculated":
            raw = parse(m.expression)
        elif m.kind == "constant":
            raw = F.lit(m.expression if m.expression is not None else m.default)
        elif m.kind == "lookup":
            raw = F.col(f"_lookup_{m.target}")
        else:
            raise ValueError(f"no mapping {m.kind}")
        value = typed(raw, m.data_type)
        if m.data_type:
            errors.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"{m.target}: not a {m.data_type}")))
        if m.default is not None:
            value = F.coalesce(value, typed(F.lit(m.default), m.data_type))
        if m.required:
            errors.append(F.when(value.isNull() | (value.cast("string") == ""), F.lit(f"{m.target}: required")))
        out.append(value.alias(m.target))
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return df.select(*out, found.alias("_errors"))


def apply_rules(df: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Rule transforms by priority: calculation, enrichment, validation (adds to `_errors`), mapping (rename), custom."""
    if "_errors" not in df.columns:
        df = df.withColumn("_errors", F.array().cast("array<string>"))
    for rule in sorted(rules, key=lambda r: r.get("priority", 0)):
        match rule["type"]:
            case "calculation":
                df = df.withColumn(rule["target"], parse(rule["expression"]))
            case "enrichment":
                df = df.withColumns({k: F.lit(v) for k, v in rule["add"].items()})
            case "validation":
                bad = ~F.coalesce(parse(rule["expression"]), F.lit(False))
                df = df.withColumn("_errors", F.when(bad, F.array_append("_errors", F.lit(rule.get("message", rule["expression"])))).otherwise(F.col("_errors")))
            case "mapping":
                df = df.withColumnsRenamed(rule.get("rename", {}))
            case "uppercase":
                df = df.withColumn(rule["field"], F.upper(rule["field"]))
            case "lowercase":
                df = df.withColumn(rule["field"], F.lower(rule["field"]))
            case "multiply":
                df = df.withColumn(rule["field"], F.col(rule["field"]) * F.lit(rule["factor"]))
            case other:
                raise ValueError(f"no rule {other}")
    return df


def dry_run(df: DataFrame, mappings: list[Mapping], rules: list[dict[str, Any]] | None = None, tables: dict[str, DataFrame] | None = None, most: int = SAMPLES) -> DataFrame:
    """What mappings and rules would do to a few samples: `input`, `output` and `_errors`; nothing is loaded."""
    rows = df.limit(most).withColumn("_input", F.struct(*df.columns))
    out = apply_rules(apply_mappings(rows, [*mappings, Mapping("_input", source="_input")], tables), rules or [])
    return out.select(F.col("_input").alias("input"), F.struct(*(c for c in out.columns if c not in ("_input", "_errors"))).alias("output"), "_errors")


def split_failed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with errors."""
    return df.where("size(_errors) = 0"), df.where("size(_errors) > 0")


def summary(df: DataFrame) -> DataFrame:
    """Totals of a mapped batch."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.size("_errors") == 0).alias("successful"), F.count_if(F.size("_errors") > 0).alias("failed")).withColumn("success_rate", F.round(F.try_divide(F.col("successful") * 100.0, F.col("total")), 6))
