"""Filters, lookups and slices by key."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom import selectors as S
from keyloom.frame import KeyedFrame, quoted


def filter(t: KeyedFrame, condition: Any, sel: Any = None) -> KeyedFrame:  # noqa: A001
    """Rows that satisfy the condition; a missing condition drops the row.

    ``condition``: a Column, SQL text, a function of the row (of the selected column, if ``sel``
    names one), or several ``(selector, function)`` pairs that must all hold.
    """
    if isinstance(condition, Column) or isinstance(condition, str):
        return t.like(t.df.where(condition))
    if isinstance(condition, dict):
        condition = tuple(condition.items())
    if isinstance(condition, (tuple, list)):
        found = [S.apply(f, t.exprs(s), isinstance(s, (int, str))) for s, f in condition]
        return t.like(t.df.where(reduce(lambda a, b: a & b, found)) if found else t.df)
    single = isinstance(sel, (int, str))
    return t.like(t.df.where(S.apply(condition, t.exprs(sel if sel is not None else list(t.columns)), single)))


def mask(t: KeyedFrame, condition: Column) -> KeyedFrame:
    return filter(t, condition)


def at(t: KeyedFrame, *index: Any) -> Any:
    """Index by key, one entry a dimension.

    A scalar picks one value, a ``slice`` a stretch with both ends (without ends everything), a
    ``range`` its numbers (without its end, as always in Python), a list several values.  With scalars only the cell is returned, and KeyError is
    raised if there is none; otherwise the result is a frame without the dimensions given as scalars.
    """
    if len(index) != len(t.keys):
        raise IndexError(f"{len(index)} indices for {len(t.keys)} dimensions")
    conditions, dropped = [], []
    for key, i in zip(t.keys, index):
        c = quoted(key)
        if isinstance(i, slice):
            if i.step is not None:
                raise IndexError("slices have no step")
            if i.start is not None:
                conditions.append(c >= F.lit(i.start))
            if i.stop is not None:
                conditions.append(c <= F.lit(i.stop))
        elif isinstance(i, range):
            conditions.append(_within(c, i))
        elif isinstance(i, (list, tuple, set)):
            if isinstance(i, list) and any(a > b for a, b in zip(i, i[1:])):
                raise IndexError("a list of keys must be sorted")
            conditions.append(c.isin(list(i)))
        else:
            conditions.append(c.eqNullSafe(F.lit(i)))
            dropped.append(key)
    found = t.df.where(reduce(lambda a, b: a & b, conditions)) if conditions else t.df
    if len(dropped) == len(t.keys):
        rows = found.select(*[quoted(v) for v in t.values]).limit(2).collect()
        if not rows:
            raise KeyError(index)
        return rows[0][0] if len(t.values) == 1 else rows[0]
    rest = [k for k in t.keys if k not in dropped]
    return KeyedFrame(found.select(*[quoted(c) for c in [*rest, *t.values]]), rest, t.kind)


def _within(c: Column, numbers: range) -> Column:
    """Whether a whole number is one of a range."""
    if not len(numbers):
        return F.lit(False)
    inside = c.between(min(numbers), max(numbers))
    return inside if abs(numbers.step) == 1 else inside & (F.pmod(c - F.lit(numbers.start), F.lit(abs(numbers.step))) == 0)


def subtable(t: KeyedFrame, first: int, last: int) -> KeyedFrame:
    """Rows first to last (from 1, both included) in key order."""
    if first < 1 or last < first - 1:
        raise IndexError(f"no rows {first} to {last}")
    row = "__row"
    numbered = t.with_row_number(row)
    return t.like(numbered.where(F.col(row).between(first, last)).drop(row))


def row_at(t: KeyedFrame, i: int) -> Any:
    """Row i in key order, from 1; -1 is the last."""
    if i < 0:
        back = t.df.orderBy(*t.order(reverse=True)).limit(-i).collect() if t.keys else t.df.tail(-i)
        rows = back if not t.keys else back[::-1]
        if len(rows) < -i:
            raise IndexError(i)
        return rows[0]
    rows = subtable(t, i, i).df.collect() if i else []
    if not rows:
        raise IndexError(i)
    return rows[0]


def upsert(t: KeyedFrame, rows: Any) -> KeyedFrame:
    """Set cells: keys that exist are replaced, others are added.

    ``rows``: a frame with the same columns, or a dict from key (tuple) to value (tuple).  Of a key given twice the last counts.
    """
    if isinstance(rows, dict):
        one = lambda x: x if isinstance(x, tuple) else (x,)
        flat = [(*one(k), *one(v)) for k, v in rows.items()]
        fields = [t.schema[c] for c in [*t.keys, *t.values]]
        from pyspark.sql import types as T

        new = t.df.sparkSession.createDataFrame(flat, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    else:
        new = rows.df if isinstance(rows, KeyedFrame) else rows
        new = new.select(*[quoted(c) for c in [*t.keys, *t.values]])
    n = new.select(*[quoted(k).alias(f"__n{i}") for i, k in enumerate(t.keys)])
    same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"__n{i}")) for i, k in enumerate(t.keys)])
    kept = t.df.join(n, same, "left_anti").select(*[quoted(c) for c in [*t.keys, *t.values]])
    return KeyedFrame(kept.unionByName(new), t.keys, t.kind)
