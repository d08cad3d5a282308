"""Selectors: ways to say which columns.

===================================  ==========================================================
selector                             meaning
===================================  ==========================================================
``3``                                the third column (positions count from 1)
``"x"``                              the column x
``re.compile("^de")``                columns whose name contains a match
``int``, ``float``, ``str``, ...     columns whose type belongs to the family
``Between("a", "c")``                columns from a to c, both included
``Not(sel, ...)``                    all other columns
``Keys()``                           the key columns
``All(sel, ...)``                    the union of selectors in order; all columns if empty
``lambda name: ...``                 columns whose name satisfies the predicate
``Via(sel, f)`` or ``(sel, f)``      f of the selection
``Named(name, sel[, f])``            the same under a name; also ``(name, sel, f)``
a Spark ``Column``                   an expression
``(sel, sel, ...)`` or a list        several columns
===================================  ==========================================================

A function receives a Spark Column for a single column and a row of Columns (``r.x``, ``r["x"]``)
for several, so ``lambda r: r.x / r.t`` stays an expression that Catalyst sees.  A function that
tests a Column with ``if``, ``and`` or ``or`` fails loudly.
"""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Keys:
    """The key columns."""


class Not:
    def __init__(self, *selectors: Any):
        self.selectors = selectors


class All:
    def __init__(self, *selectors: Any):
        self.selectors = selectors


@dataclass(frozen=True)
class Between:
    first: Any
    last: Any


@dataclass(frozen=True)
class Via:
    selector: Any
    function: Callable


class Named:
    def __init__(self, name: str, selector: Any, function: Callable | None = None):
        self.name, self.selector, self.function = name, selector, function


class Row:
    """The columns of a selection, by attribute, name or position (from 1)."""

    def __init__(self, columns: list[tuple[str, Column]]):
        object.__setattr__(self, "_columns", columns)

    def __getattr__(self, name: str) -> Column:
        return self[name]

    def __getitem__(self, name: str | int) -> Column:
        if isinstance(name, int):
            return self._columns[name - 1][1]
        for n, c in self._columns:
            if n == name:
                return c
        raise KeyError(f"no column {name!r}; there are {[n for n, _ in self._columns]}")

    def __iter__(self):
        return iter(c for _, c in self._columns)

    def __len__(self) -> int:
        return len(self._columns)


FAMILIES: dict[Any, tuple[type, ...]] = {
    int: (T.IntegralType,),
    float: (T.FractionalType,),
    complex: (T.NumericType,),
    str: (T.StringType,),
    bool: (T.BooleanType,),
    bytes: (T.BinaryType,),
    datetime.date: (T.DateType, T.TimestampType, T.TimestampNTZType),
    datetime.datetime: (T.TimestampType, T.TimestampNTZType),
    decimal.Decimal: (T.DecimalType,),
    list: (T.ArrayType,),
    dict: (T.MapType, T.StructType),
}


def is_expression(sel: Any) -> bool:
    return isinstance(sel, Column)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _is_pair(sel: Any) -> bool:
    return isinstance(sel, tuple) and len(sel) == 2 and callable(sel[1]) and not isinstance(sel[1], type) and not callable(sel[0])


def _is_named(sel: Any) -> bool:
    return isinstance(sel, tuple) and len(sel) == 3 and isinstance(sel[0], str) and callable(sel[2]) and not isinstance(sel[2], type)


def names(schema: T.StructType, keys: Iterable[str], sel: Any) -> list[str]:
    """The column names a selector stands for; KeyError if there is none."""
    columns = schema.names
    if sel is None:
        return list(columns)
    if isinstance(sel, bool):
        raise TypeError("a selector cannot be a bool")
    if isinstance(sel, int):
        if not 1 <= sel <= len(columns):
            raise KeyError(f"no column at position {sel}; there are {len(columns)}")
        return [columns[sel - 1]]
    if isinstance(sel, str):
        if sel not in columns:
            raise KeyError(f"no column {sel!r}; there are {columns}")
        return [sel]
    if isinstance(sel, re.Pattern):
        return [c for c in columns if sel.search(c)]
    if isinstance(sel, Keys) or sel is Keys:
        return list(keys)
    if isinstance(sel, Not):
        out = {c for s in sel.selectors for c in names(schema, keys, s)}
        return [c for c in columns if c not in out]
    if isinstance(sel, All):
        return names(schema, keys, list(sel.selectors)) if sel.selectors else list(columns)
    if isinstance(sel, Between):
        a, b = (columns.index(names(schema, keys, s)[0]) for s in (sel.first, sel.last))
        return columns[a : b + 1]
    if isinstance(sel, type):
        family = FAMILIES.get(sel, (sel,) if issubclass(sel, T.DataType) else None)
        if family is None:
            raise TypeError(f"no columns are of type {sel!r}")
        return [f.name for f in schema.fields if isinstance(f.dataType, family)]
    if isinstance(sel, T.DataType):
        return [f.name for f in schema.fields if f.dataType == sel]
    if isinstance(sel, (list, tuple, set, frozenset)):
        return list(dict.fromkeys(c for s in sel for c in names(schema, keys, s)))
    if callable(sel):
        return [c for c in columns if sel(c)]
    raise TypeError(f"{sel!r} is no selector")


def apply(function: Callable, columns: list[tuple[str, Column]], single: bool) -> Any:
    """``function`` of a Column or a row; its result must be an expression."""
    out = function(columns[0][1]) if single else function(Row(columns))
    if isinstance(out, (Column, dict, tuple)):
        return out
    if isinstance(out, (int, float, str, bool, datetime.date)) or out is None:
        return F.lit(out)
    raise TypeError(f"{function!r} returned {type(out).__name__}, not a Column; use a pandas function with a schema instead")


def function_name(function: Any) -> str:
    return getattr(function, "__name__", type(function).__name__).strip("<>")


def columns_of(schema: T.StructType, keys: Iterable[str], sel: Any) -> list[tuple[str, Column]]:
    """Named expressions for a selector."""
    if isinstance(sel, Column):
        return [(sel._jc.toString() if hasattr(sel, "_jc") else str(sel), sel)]
    if isinstance(sel, dict):
        return [(n, columns_of(schema, keys, s)[0][1]) for n, s in sel.items()]
    if _is_named(sel):
        sel = Named(*sel)
    elif _is_pair(sel):
        sel = Via(*sel)
    if isinstance(sel, Named):
        inner = sel.selector if sel.function is None else Via(sel.selector, sel.function)
        got = columns_of(schema, keys, inner)
        if len(got) == 1:
            return [(sel.name, got[0][1])]
        return [(sel.name, F.struct(*[c.alias(n) for n, c in got]))]
    if isinstance(sel, Via):
        single = isinstance(sel.selector, (int, str, Column))
        base = columns_of(schema, keys, sel.selector)
        out = apply(sel.function, base, single)
        if isinstance(out, dict):
            return [(n, c if isinstance(c, Column) else F.lit(c)) for n, c in out.items()]
        if isinstance(out, tuple):
            return [(f"_{i}", c if isinstance(c, Column) else F.lit(c)) for i, c in enumerate(out, 1)]
        return [(base[0][0] if single else function_name(sel.function), out)]
    if isinstance(sel, (list, tuple)):
        out_: list[tuple[str, Column]] = []
        for s in sel:
            for n, c in columns_of(schema, keys, s):
                if n not in [m for m, _ in out_]:
                    out_.append((n, c))
        return out_
    return [(n, _quoted(n)) for n in names(schema, keys, sel)]
