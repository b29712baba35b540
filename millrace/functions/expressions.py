"""Expressions over `$field` names, parsed into Columns. Nothing is ever evaluated as code."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text


class ExpressionError(ValueError):
    """An expression uses something that isn't allowed."""


_FIELD = re.compile(r"\$([A-Za-z_]\w*)")

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "len": F.length,
    "str": lambda c: c.cast("string"),
    "int": lambda c: c.try_cast("double").try_cast("bigint"),
    "float": lambda c: c.try_cast("double"),
    "bool": lambda c: c.try_cast("boolean"),
    "upper": F.upper,
    "lower": F.lower,
    "title": text.title,
    "strip": text.strip,
    "concat": lambda *c: F.concat_ws("", *(F.nullif(x.cast("string"), F.lit("")) for x in c)),
    "replace": lambda c, a, b: F.replace(c, a, b),
    "abs": F.abs,
    "round": lambda c, n=None: F.bround(c, 0 if n is None else n),
    "min": F.least,
    "max": F.greatest,
    "coalesce": F.coalesce,
}

_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))),
    ast.Mod: lambda a, b: F.when(b != 0, F.pmod(a, F.nullif(b, F.lit(0)))),
    ast.Pow: lambda a, b: F.pow(a, b),
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


def _literal(node: ast.AST):
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        return -node.operand.value
    raise ExpressionError("a list holds constants only")


def _build(node: ast.AST) -> Column:
    if isinstance(node, ast.Expression):
        return _build(node.body)
    if isinstance(node, ast.Constant):
        return F.lit(node.value)
    if isinstance(node, ast.Name):
        if node.id.startswith("_field_"):
            return F.col(f"`{node.id[7:]}`")
        raise ExpressionError(f"unknown name {node.id}")
    if isinstance(node, ast.BoolOp):
        parts = [_build(v) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.UnaryOp):
        if isinstance(node.op, ast.Not):
            return ~_build(node.operand)
        if isinstance(node.op, ast.USub):
            return -_build(node.operand)
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return _BINARY[type(node.op)](_build(node.left), _build(node.right))
    if isinstance(node, ast.Compare):
        out, left = None, _build(node.left)
        for op, right in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                if not isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                    raise ExpressionError("`in` takes a list of constants")
                here = left.isin(*(_literal(x) for x in right.elts))
                here = ~here if isinstance(op, ast.NotIn) else here
            elif isinstance(op, (ast.Is, ast.IsNot)) and isinstance(right, ast.Constant) and right.value is None:
                here = left.isNull() if isinstance(op, ast.Is) else left.isNotNull()
            elif type(op) in _COMPARE:
                there = _build(right)
                here = _COMPARE[type(op)](left, there)
                left = there
            else:
                raise ExpressionError(f"{type(op).__name__} isn't allowed")
            out = here if out is None else out & here
        return out
    if isinstance(node, ast.IfExp):
        return F.when(_build(node.test), _build(node.body)).otherwise(_build(node.orelse))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        if node.func.id not in FUNCTIONS:
            raise ExpressionError(f"unknown function {node.func.id}")
        if node.func.id == "round" and len(node.args) == 2:
            return F.bround(_build(node.args[0]), _literal(node.args[1]))
        return FUNCTIONS[node.func.id](*map(_build, node.args))
    raise ExpressionError(f"{type(node).__name__} isn't allowed")


def fields(expression: str) -> list[str]:
    """The `$field` names an expression reads, in order."""
    return list(dict.fromkeys(_FIELD.findall(expression)))


def parse(expression: str) -> Column:
    """An expression such as `$qty * $price > 10 and len($name) < 5` as a Column.

    Division by zero and failed casts give null instead of ending the query.
    """
    try:
        tree = ast.parse(_FIELD.sub(r"_field_\1", expression).strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"can't parse {expression!r}") from e
    return _build(tree)
