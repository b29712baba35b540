"""Cleaning: declared rules become one projection."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text

CASES = {"lower": F.lower, "upper": F.upper, "title": text.title}


@dataclass
class CleanConfig:
    """Generic cleaning of every text column, and rules that replace it for a field."""

    null_replacement: str | None = None
    empty_replacement: str | None = None
    strip: bool = True
    collapse: bool = True
    remove_characters: str = ""
    case: str | None = None
    fields: dict[str, list[dict[str, Any]]] = field(default_factory=dict)


def clean_text(c: Column, config: CleanConfig) -> Column:
    """The generic steps, in order; emptiness is judged before anything is trimmed."""
    out = c
    if config.null_replacement is not None:
        out = F.coalesce(out, F.lit(config.null_replacement))
    if config.empty_replacement is not None:
        out = F.when(out == "", F.lit(config.empty_replacement)).otherwise(out)
    if config.strip:
        out = text.strip(out)
    if config.collapse:
        out = text.collapse(out)
    if config.remove_characters:
        out = F.translate(out, config.remove_characters, "")
    return CASES[config.case](out) if config.case else out


def apply_rule(c: Column, rule: dict[str, Any]) -> Column:
    kind, value = rule["type"], rule.get("value")
    match kind:
        case "trim":
            return text.strip(c)
        case "lowercase":
            return F.lower(c)
        case "uppercase":
            return F.upper(c)
        case "titlecase":
            return text.title(c)
        case "collapse":
            return text.collapse(c)
        case "remove_chars":
            return F.translate(c, value, "")
        case "replace":
            return F.replace(c, F.lit(rule["old"]), F.lit(rule["new"]))
        case "regex_replace":
            return F.regexp_replace(c, rule["pattern"], rule["new"])
        case "substring":
            return F.substr(c, F.lit(rule.get("start", 1)), F.lit(rule["length"]))
        case "round":
            return F.bround(c.try_cast("double"), rule.get("digits", 0))
        case "date_format":
            return F.date_format(c, rule["format"])
        case "default_if_empty":
            return F.when(c.isNull() | (F.trim(c.cast("string")) == "") | F.coalesce(c.try_cast("double") == 0, F.lit(False)), F.lit(value)).otherwise(c)
        case "default_if_null" | "null_to_default":
            return F.coalesce(c, F.lit(value))
    raise ValueError(f"no cleaning rule {kind}")


def clean(df: DataFrame, config: CleanConfig) -> DataFrame:
    """Clean the text columns and those with rules; the others pass."""
    kinds = dict(df.dtypes)
    out = []
    for name in df.columns:
        c = F.col(name)
        if name in config.fields:
            c = reduce(apply_rule, config.fields[name], c)
        elif kinds[name] == "string":
            c = clean_text(c, config)
        out.append(c.alias(name))
    return df.select(*out)


def cleaning_score(before: list[Column], after: list[Column]) -> Column:
    """1, less 0.05 for each null and 0.02 for each empty value left, plus 0.01 for each changed one; within 0 and 1."""
    score: Column = F.lit(1.0)
    for b, a in zip(before, after, strict=True):
        score = score - F.when(a.isNull(), 0.05).when(a.cast("string") == "", 0.02).otherwise(0.0) + F.when(~b.eqNullSafe(a), 0.01).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def name_case(c: Column) -> Column:
    """Title case for what looks like a name: letters and name signs only, two words at least."""
    plain = text.collapse(c)
    return F.when(plain.rlike(r"^[\p{L} .'\-]+$") & (F.size(F.split(plain, " ")) >= 2), text.title(plain)).otherwise(plain)
