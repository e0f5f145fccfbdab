"""Predicates with two-valued logic.

A leaf that can't be decided (missing field, other type) is false, so its negation is true. A bare
null does the same where rows are only kept or dropped, and lets the scan take the predicate; the
null is replaced by false only under NOT.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import Field, Resolver
from ..lang import ast

#: Severity names by rank.
SEVERITIES = (("TRACE",), ("DEBUG",), ("INFO", "NOTICE"), ("WARN", "WARNING"), ("ERROR", "ERR"), ("FATAL", "CRITICAL", "CRIT", "ALERT", "EMERG"))
_RANK = {name: i for i, names in enumerate(SEVERITIES) for name in names}


def java_regex(pattern: str) -> str:
    """Named groups in the spelling that Java takes."""
    return re.sub(r"\(\?P<", "(?<", pattern)


def _rank(text: Column) -> Column:
    upper = F.upper(text)
    return reduce(lambda out, x: F.when(upper == x[0], x[1]).otherwise(out), _RANK.items(), F.lit(None).cast("int"))


def _ordered(left: Column, op: str, right) -> Column:
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _equal(f: Field, value) -> Column:
    """Whether the field equals a literal of the same type; null or false if not."""
    if isinstance(value, bool):
        return f.bool() == F.lit(value) if f.kind in ("bool", "variant") else F.lit(False)
    if isinstance(value, (int, float)):
        return f.number() == F.lit(value) if f.kind in ("number", "variant") else F.lit(False)
    text = value.text if isinstance(value, ast.Word) else value
    if f.kind == "time":
        return f.column == F.lit(text).try_cast("timestamp")
    return f.string() == F.lit(text) if f.kind in ("string", "variant") else F.lit(False)


def _compare(f: Field, op: str, value) -> Column:
    if op == "==":
        return _equal(f, value)
    if op == "!=":
        # another type is different; a missing field is not
        same = _equal(f, value)
        kinds = {"string": (str, ast.Word), "number": (int, float), "bool": (bool,), "time": (str, ast.Word)}.get(f.kind, ())
        if isinstance(value, kinds) and not (isinstance(value, bool) and f.kind == "number"):
            return ~same
        return f.present() & ~F.coalesce(same, F.lit(False))
    if isinstance(value, bool):
        return F.lit(False)
    if isinstance(value, (int, float)):
        return _ordered(f.number(), op, F.lit(value)) if f.kind in ("number", "variant") else F.lit(False)
    text = value.text if isinstance(value, ast.Word) else value
    if f.kind == "time":
        return _ordered(f.column, op, F.lit(text).try_cast("timestamp"))
    if isinstance(value, ast.Word) and text.upper() in _RANK and f.kind in ("string", "variant"):
        return _ordered(_rank(f.string()), op, F.lit(_RANK[text.upper()]))
    return F.lit(False)


def _in(f: Field, values: tuple) -> Column:
    texts = [v.text if isinstance(v, ast.Word) else v for v in values if isinstance(v, (str, ast.Word))]
    bools = [v for v in values if isinstance(v, bool)]
    numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    parts = []
    if texts and f.kind in ("string", "variant"):
        parts.append(f.string().isin(*texts))
    if numbers and f.kind in ("number", "variant"):
        parts.append(f.number().isin(*numbers))
    if bools and f.kind in ("bool", "variant"):
        parts.append(f.bool().isin(*bools))
    if f.kind == "variant" and len(parts) > 1:
        parts = [F.coalesce(p, F.lit(False)) for p in parts]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def predicate(expr: ast.Expr, resolve: Resolver, exact: bool = False) -> Column:
    """The condition of an expression; with ``exact`` it is never null."""
    if isinstance(expr, ast.And):
        return predicate(expr.left, resolve, exact) & predicate(expr.right, resolve, exact)
    if isinstance(expr, ast.Or):
        return predicate(expr.left, resolve, exact) | predicate(expr.right, resolve, exact)
    if isinstance(expr, ast.Not):
        return ~predicate(expr.term, resolve, True)
    f = resolve(expr.field)
    if isinstance(expr, ast.Exists):
        return f.exists()
    if isinstance(expr, ast.Compare):
        out = _compare(f, expr.op, expr.value)
    elif isinstance(expr, ast.In):
        out = _in(f, expr.values)
    elif isinstance(expr, ast.Contains):
        out = f.string().contains(expr.text)
    elif isinstance(expr, ast.Match):
        matched = f.string().rlike(java_regex(expr.pattern))
        out = ~matched if expr.negated else matched
    else:
        raise TypeError(f"not a predicate: {expr!r}")
    return F.coalesce(out, F.lit(False)) if exact else out


def keep(df: DataFrame, expr: ast.Expr) -> DataFrame:
    """The rows of ``df`` for which ``expr`` holds."""
    return df.filter(predicate(expr, Resolver(df)))


def show(df: DataFrame, fields: tuple[str, ...] | None, where: ast.Expr | None = None) -> DataFrame:
    """Fields of the matching rows, under the names they were asked by; None for all fields."""
    if where is not None:
        df = keep(df, where)
    if fields is None:
        return df
    resolve = Resolver(df)
    return df.select(*[resolve(f).value().alias(f) for f in dict.fromkeys(fields)])
