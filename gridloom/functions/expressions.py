"""Arithmetic expression texts as Columns, from a short list of allowed syntax."""

from __future__ import annotations

import ast
import operator
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    pass


def missing(c: Column) -> Column:
    """NaN as null: all missing values are nulls inside the engine."""
    return F.nanvl(c, F.lit(None).cast("double"))


def present(c: Column) -> Column:
    """Neither null nor NaN. Spark sorts NaN above all numbers, so comparisons need this guard."""
    return c.isNotNull() & ~F.isnan(c)


def divide(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_half_even(c: Column, decimals: int) -> Column:
    scale = float(10**decimals)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: divide, ast.Mod: lambda a, b: F.try_mod(a, b), ast.Pow: lambda a, b: F.pow(a, b)}
COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
CALLS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "floor": F.floor, "ceil": F.ceil, "rint": F.rint, "sin": F.sin, "cos": F.cos, "tan": F.tan, "min": F.least, "max": F.greatest, "where": lambda c, a, b: F.when(c, a).otherwise(b), "coalesce": F.coalesce}


def names_in(text: str) -> set[str]:
    """The columns that an expression reads."""
    tree = _parsed(text)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


def _parsed(text: str) -> ast.expr:
    try:
        return ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e


def to_column(text: str, columns: Mapping[str, Column] | None = None) -> Column:
    """The Column of an expression text; names are looked up in ``columns`` first."""

    def of(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() | str() as v):
                return F.lit(v)
            case ast.Name(id=name):
                return columns[name] if columns and name in columns else F.col(f"`{name}`")
            case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
                return BINARY[type(op)](of(a), of(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -of(a)
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return of(a)
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return ~of(a)
            case ast.BoolOp(op=op, values=vs):
                found = of(vs[0])
                for v in vs[1:]:
                    found = found & of(v) if isinstance(op, ast.And) else found | of(v)
                return found
            case ast.Compare(left=a, ops=ops, comparators=bs):
                found, left = None, of(a)
                for op, b in zip(ops, bs):
                    if type(op) not in COMPARE:
                        raise ExpressionError(f"not allowed: {ast.unparse(node)}")
                    right = of(b)
                    step = COMPARE[type(op)](left, right)
                    found, left = step if found is None else found & step, right
                return found
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in CALLS:
                return CALLS[name](*(of(a) for a in args))
        raise ExpressionError(f"not allowed: {ast.unparse(node)}")

    return of(_parsed(text))
