"""Parameterised SQL predicates: validation, dialect, binding."""

from __future__ import annotations

import datetime
import decimal
import math
import re
from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|--[^\n]*|\?|//|[A-Za-z_][A-Za-z_0-9]*|\s+|.""", re.S)
#: Names that another dialect spells differently: as a type, and as a function (before a parenthesis).
TYPES = {"varchar": "STRING", "text": "STRING", "hugeint": "DECIMAL(38,0)"}
FUNCTIONS = {"starts_with": "startswith", "ends_with": "endswith", "regexp_matches": "regexp_like", "list_contains": "array_contains", "json_extract_string": "get_json_object"}


def check(where: str, params: Sequence[Any] = ()) -> tuple[str, tuple[Any, ...]]:
    """A predicate and its parameters, or an error: text without semicolons, a sequence that isn't a string."""
    if not isinstance(where, str) or not where.strip():
        raise ValueError("where must be a non-empty SQL predicate")
    if ";" in where:
        raise ValueError("where must be a single predicate without semicolons")
    if isinstance(params, (str, bytes)):
        raise TypeError("params must be a sequence of values, not a string")
    try:
        return where, tuple(params)
    except TypeError:
        raise TypeError("params must be a sequence of values") from None


def as_literal(value: Any) -> str:
    """A value as one typed SQL literal token; quotes and backslashes can't end it."""
    if isinstance(value, np.generic):
        value = value.item()
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"{value}L" if -(1 << 63) <= value < 1 << 63 else f"CAST('{value}' AS DECIMAL(38,0))"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"DOUBLE('{value}')"
    if isinstance(value, decimal.Decimal):
        return f"{value:f}BD"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'" if value.tzinfo is None else f"TIMESTAMP'{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"a parameter of type {type(value).__name__} can't be bound")


def to_spark(where: str, params: Sequence[Any] = ()) -> str:
    """The predicate in Spark's dialect, each ? bound to its parameter.

    Double quotes name columns; the names in TYPES and FUNCTIONS, // and
    strftime with a literal format are respelled.  Inside strings nothing changes.
    """
    where, params = check(where, params)
    values = iter(params)
    tokens = TOKEN.findall(where)
    out, used = [], 0
    for i, t in enumerate(tokens):
        low = t.lower()
        if t == "?":
            used += 1
            try:
                out.append(as_literal(next(values)))
            except StopIteration:
                raise ValueError(f"the predicate has more placeholders than its {len(params)} parameters") from None
        elif t[0] == '"':
            out.append("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif t[0] == "'":
            out.append(as_literal(t[1:-1].replace("''", "'")))
        elif t.startswith("--"):
            out.append(" ")
        elif t == "//":
            out.append(" div ")
        elif low in TYPES and "".join(tokens[i + 1 : i + 2]) != "(":
            out.append(TYPES[low])
        elif low in FUNCTIONS and "".join(tokens[i + 1 :]).lstrip().startswith("("):
            out.append(FUNCTIONS[low])
        else:
            out.append(t)
    if used != len(params):
        raise ValueError(f"the predicate has {used} placeholders and {len(params)} parameters")
    return "".join(out)


def condition(where: str, params: Sequence[Any] = ()) -> Column:
    return F.expr(f"({to_spark(where, params)})")


def matching(rows: DataFrame, where: str, params: Sequence[Any] = ()) -> DataFrame:
    """The rows for which the predicate is true."""
    return rows.where(condition(where, params))


def both(first: tuple[str, tuple], second: tuple[str, tuple]) -> tuple[str, tuple]:
    """The conjunction of two predicates with their parameters."""
    return f"({first[0]}) AND ({second[0]})", (*first[1], *second[1])
