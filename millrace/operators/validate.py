"""Validation: rules become an array of error structs, a status and a score in one projection."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import parse
from millrace.functions.formats import FORMATS, matches

SEVERITIES = ("info", "warning", "error", "critical")
MOST_ERRORS = 50


@dataclass
class Rule:
    """One check of a field, or of a whole record where `field` is empty."""

    field: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"
    priority: int = 0
    enabled: bool = True
    fix: bool = False


TYPES = {"string": "string", "integer": "bigint", "float": "double", "number": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp", "list": "array<string>"}


def _size(c: Column, kind: str) -> Column:
    return F.size(c) if kind.startswith("array") else F.length(c.cast("string"))


def passes(rule: Rule, kinds: dict[str, str]) -> Column:
    """Whether a record passes; never null."""
    p = rule.params
    c = F.col(rule.field) if rule.field else None
    match rule.kind:
        case "required":
            ok = (F.size(c) > 0) if kinds.get(rule.field, "").startswith("array") else (c.isNotNull() & (c.cast("string") != ""))
        case "type":
            ok = c.isNull() | c.cast("string").try_cast(TYPES[p["type"]]).isNotNull()
        case "range":
            number = c.cast("string").try_cast("double")
            ok = c.isNull() | (number.isNotNull() & (number >= p.get("min", float("-inf"))) & (number <= p.get("max", float("inf"))))
        case "length":
            n = _size(c, kinds.get(rule.field, ""))
            ok = c.isNull() | ((n >= p.get("min", 0)) & (n <= p.get("max", 1 << 30)))
        case "pattern":
            ok = c.isNull() | (c == "") | matches(c, p["pattern"])
        case "format":
            extra = {k: v for k, v in p.items() if k == "country"}
            ok = c.isNull() | (c == "") | FORMATS[p["format"]](c, **extra)
        case "custom":
            ok = p["build"](c)
        case "in":
            ok = c.isNull() | c.isin(*p["values"])
        case "referential":
            ok = c.isNull() | F.col(f"_known_{rule.field}").isNotNull()
        case "uniqueness":
            ok = c.isNull() | (F.col(f"_nth_{rule.field}") == 1)
        case "condition" | "business_rule" | "cross_field":
            ok = parse(p["expression"])
        case other:
            raise ValueError(f"no validation {other}")
    return F.coalesce(ok, F.lit(False))


def fixed(rule: Rule) -> Column | None:
    """What a fix puts in place: a default, a clamped number, a cut text."""
    c, p = F.col(rule.field), rule.params
    match rule.kind:
        case "required" if "default" in p:
            return F.when(c.isNull() | (c.cast("string") == ""), F.lit(p["default"])).otherwise(c)
        case "range":
            return F.when(c.isNotNull(), F.greatest(F.lit(p.get("min", float("-inf"))), F.least(F.lit(p.get("max", float("inf"))), c.cast("double"))))
        case "length" if "max" in p:
            return F.left(c, F.lit(p["max"]))
    return None


def validate(df: DataFrame, rules: list[Rule], order: str, references: dict[str, tuple[DataFrame, str]] | None = None, stop_on_first: bool = False) -> DataFrame:
    """df with `_errors` (field, rule, severity), `_status` and `_score`; fixed fields carry their new values.

    order: the column, without repeats, that tells which of equal values came first. references: for
    referential rules, by field, the table and its key column. Cross-field conditions count
    only for records without errors before them.
    """
    kinds = dict(df.dtypes)
    active = sorted((r for r in rules if r.enabled), key=lambda r: r.priority)
    for r in active:
        if r.kind == "referential":
            known, key = references[r.field]
            df = df.join(known.select(F.col(key).alias(f"_known_{r.field}")).distinct(), F.col(r.field) == F.col(f"_known_{r.field}"), "left")
        if r.kind == "uniqueness":
            # the first of each value by a partial aggregate and a join, which a frequent value doesn't bring into one task
            text = F.col(r.field).cast("string")
            firsts = df.where(text.isNotNull()).groupBy(text.alias(f"_text_{r.field}")).agg(F.min(order).alias(f"_first_{r.field}"))
            df = df.join(firsts, text == F.col(f"_text_{r.field}"), "left").withColumn(f"_nth_{r.field}", F.when(F.col(order) == F.col(f"_first_{r.field}"), 1).otherwise(2)).drop(f"_text_{r.field}", f"_first_{r.field}")
    plain = [r for r in active if r.kind != "cross_field"]
    crossed = [r for r in active if r.kind == "cross_field"]
    told = lambda r: F.struct(F.lit(r.field).alias("field"), F.lit(r.kind).alias("rule"), F.lit(r.severity).alias("severity"))
    errors = F.array_compact(F.array(*(F.when(~passes(r, kinds), told(r)) for r in plain)))
    df = df.withColumn("_errors", errors)
    if crossed:
        more = F.array_compact(F.array(*(F.when(~passes(r, kinds), told(r)) for r in crossed)))
        df = df.withColumn("_errors", F.when(F.size("_errors") == 0, more).otherwise(F.col("_errors")))
    most = 1 if stop_on_first else MOST_ERRORS
    df = df.withColumn("_errors", F.slice("_errors", 1, most))
    fixes = [(r, c) for r in active if r.fix and (c := fixed(r)) is not None]
    count = lambda s: F.size(F.filter("_errors", lambda e: e.severity == s))
    made = reduce(lambda a, b: a + b, (F.when(~F.col(r.field).cast("string").eqNullSafe(c.cast("string")), 1).otherwise(0) for r, c in fixes), F.lit(0))
    total = max(1, len(active))
    score = F.lit(total) - F.size("_errors")
    score = score / total * F.pow(F.lit(0.5), F.least(count("critical"), F.lit(1))) * F.pow(F.lit(0.8), F.least(count("error"), F.lit(1))) * F.pow(F.lit(0.95), F.least(count("warning"), F.lit(1)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + 0.05 * F.least(made, F.lit(3))))
    status = F.when(count("critical") > 0, "FAILED").when(F.size("_errors") > 0, "WARNING").otherwise("SUCCESS")
    df = df.withColumns({"_status": status, "_score": score})
    df = df.withColumns({r.field: c for r, c in fixes}) if fixes else df
    return df.drop(*(f"_known_{r.field}" for r in active), *(f"_nth_{r.field}" for r in active))


def accepted_and_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that go on, and failed rows with a reason: their first three errors."""
    reason = F.array_join(F.transform(F.slice("_errors", 1, 3), lambda e: F.concat_ws(": ", e.field, e.rule)), "; ")
    return df.where("_status <> 'FAILED'"), df.where("_status = 'FAILED'").withColumn("rejection_reason", reason)


def violation_rows(df: DataFrame, rules: list[Rule], order: str, most: int = 100) -> DataFrame:
    """The first `most` violations of a file's rows: row (the header is the first one), field, rule and value.

    order: the column that numbers the records from 1. The limit is that of an error report.
    """
    marked = validate(df, rules, order)
    values = F.create_map(*(x for r in dict.fromkeys(r.field for r in rules if r.field) for x in (F.lit(r), F.col(r).cast("string"))))
    rows = marked.select((F.col(order) + 1).alias("row"), F.posexplode("_errors").alias("at", "e"), values.alias("_v"))
    return rows.orderBy("row", "at").limit(most).select("row", "e.field", "e.rule", F.try_element_at("_v", F.col("e.field")).alias("value"))


def header_check(actual: list[str], expected: list[str]) -> tuple[list[str], list[str]]:
    """Expected columns that are missing and columns that aren't expected, whatever their case."""
    have, want = {c.strip().lower() for c in actual}, {c.strip().lower() for c in expected}
    return sorted(want - have), sorted(have - want)
