"""Listings: JSON criteria, sorting and pages."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import parse

_NEGATED = {"not_like": "like", "not_in": "in"}


def _like(value: Any) -> str:
    shown = str(value).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{shown}%"


def condition(kinds: dict[str, str], name: str, operator: str, value: Any = None) -> Column:
    """One comparison; values are cast to the column's type."""
    if name not in kinds:
        raise ValueError(f"no column {name}")
    c = F.col(f"`{name}`")
    typed = lambda v: F.lit(v).cast(kinds[name])
    if operator in _NEGATED:
        return ~condition(kinds, name, _NEGATED[operator], value)
    match operator:
        case "=" | "==":
            return c == typed(value)
        case "!=" | "<>":
            return c != typed(value)
        case ">":
            return c > typed(value)
        case ">=":
            return c >= typed(value)
        case "<":
            return c < typed(value)
        case "<=":
            return c <= typed(value)
        case "like":
            return c.cast("string").ilike(_like(value))
        case "in":
            values = value if isinstance(value, list | tuple | set) else [value]
            return c.isin(*(typed(v) for v in values))
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
    raise ValueError(f"no operator {operator}")


def criteria(kinds: dict[str, str], tree: Any) -> Column:
    """A tree of `and` and `or` lists as one predicate, which the scan gets pushed down.

    Leaves are (field, operator, value) lists, dictionaries with these names, or
    {field: value} equalities; `and` and `or` side by side are both required.
    """
    if isinstance(tree, dict):
        if "field" in tree:
            return condition(kinds, tree["field"], tree.get("operator", "="), tree.get("value"))
        parts = []
        for name, below in tree.items():
            if name in ("and", "or"):
                each = [criteria(kinds, x) for x in below]
                both = (lambda a, b: a & b) if name == "and" else (lambda a, b: a | b)
                parts.append(reduce(both, each) if each else F.lit(name == "and"))
            else:
                parts.append(condition(kinds, name, "=", below))
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    if isinstance(tree, list | tuple) and tree and isinstance(tree[0], str):
        return condition(kinds, *tree)
    if isinstance(tree, list | tuple):
        return reduce(lambda a, b: a & b, (criteria(kinds, x) for x in tree), F.lit(True))
    raise ValueError("criteria are lists and dictionaries")


def listed(df: DataFrame, tree: Any) -> DataFrame:
    return df.where(criteria(dict(df.dtypes), tree))


def equal_to(df: DataFrame, **values: Any) -> DataFrame:
    """Rows with all these values; None skips a field."""
    return listed(df, {k: v for k, v in values.items() if v is not None})


def search_any(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows that hold a term in any column, whatever its case."""
    return df.where(reduce(lambda a, b: a | b, (F.col(c).cast("string").ilike(_like(term)) for c in columns)))


def where_expression(df: DataFrame, expression: str) -> DataFrame:
    return df.where(parse(expression))


def ordering(keys: list[tuple[str, str]]) -> list[Column]:
    """asc puts nulls last, desc first."""
    return [F.col(c).desc_nulls_first() if way.lower() == "desc" else F.col(c).asc_nulls_last() for c, way in keys]


def top(df: DataFrame, keys: list[tuple[str, str]], most: int) -> DataFrame:
    return df.orderBy(*ordering(keys)).limit(most)


def top_counts(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The most frequent values; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def page(df: DataFrame, keys: list[tuple[str, str]], number: int, size: int) -> DataFrame:
    """The rows of one page, from 1."""
    return df.orderBy(*ordering(keys)).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """total, pages, has_next and has_previous of a listing."""
    total = F.col("total")
    pages = F.ceil(total / float(size)).cast("long")
    return df.agg(F.count("*").alias("total")).select("total", pages.alias("pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def after_cursor(df: DataFrame, column: str, cursor: Any, size: int) -> DataFrame:
    """The page behind a cursor on a unique column, and whether rows follow (`has_more`): one row more than the page is read."""
    rows = df if cursor is None else df.where(F.col(column) > F.lit(cursor))
    ahead = rows.orderBy(column).limit(size + 1)
    more = ahead.count() > size
    return ahead.orderBy(column).limit(size).withColumn("has_more", F.lit(more))
