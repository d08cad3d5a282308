"""Reshaping: long and wide forms, nested columns, slices."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.frame import KeyedFrame, quoted


def stack(t: KeyedFrame, by: Any = None, sel: Any = None, variable: str = "variable", value: str = "value") -> KeyedFrame:
    """Wide to long: one row for each selected column of each row.

    Numbers are widened to one type; with any other mixture the values become text.
    """
    ids = t.names(by) if by is not None else list(t.keys)
    wanted = t.names(sel) if sel is not None else [c for c in t.columns if c not in ids]
    if not wanted:
        raise ValueError("there is no column to stack")
    types = {t.schema[c].dataType for c in wanted}
    if len(types) == 1:
        kind = types.pop()
    elif all(isinstance(x, T.NumericType) for x in types):
        kind = T.LongType() if all(isinstance(x, T.IntegralType) for x in types) else T.DoubleType()
    else:
        kind = T.StringType()
    df = t.df.select(*[quoted(i) for i in ids], *[quoted(c).cast(kind).alias(c) for c in wanted if c not in ids])
    long = df.unpivot([quoted(i) for i in ids], [quoted(c) for c in wanted], variable, value)
    return KeyedFrame(long, ids, "table")


def unstack(t: KeyedFrame, by: Any = None, variable: Any = "variable", value: Any = "value", names: list | None = None, max_columns: int = 10_000) -> KeyedFrame:
    """Long to wide: one column for each value of ``variable``.

    Columns come in the order of ``names``, or else in order of first appearance: that of the smallest
    key with the variable, and within a key that of the rows; more than ``max_columns`` are an error.  ValueError if a key has a variable twice; keys without
    a variable have a missing cell.
    """
    var, val = t.names(variable)[0], t.names(value)[0]
    ids = t.names(by) if by is not None else [k for k in t.keys if k not in (var, val)]
    if names is None:
        at = F.struct(*[quoted(i) for i in ids], F.monotonically_increasing_id())
        first = t.df.select(quoted(var).alias("v"), at.alias("at")).where(F.col("v").isNotNull()).groupBy("v").agg(F.min("at").alias("at"))
        names = [r["v"] for r in first.orderBy("at", "v").limit(max_columns + 1).collect()]
        if len(names) > max_columns:
            raise ValueError(f"{var!r} has more than {max_columns} values; name the columns wanted")
    cells = t.df.groupBy(*[quoted(i) for i in ids], quoted(var))
    twice = cells.agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"a key has a variable twice: {twice[0].asDict()}")
    wide = t.df.groupBy(*[quoted(i) for i in ids]).pivot(var, names).agg(F.first(quoted(val)))
    return KeyedFrame(wide, ids, t.kind if ids else "table")


def flatten(t: KeyedFrame, sel: Any = None) -> KeyedFrame:
    """One row for each element of a list column; lists of structs give several columns.

    Rows with an empty or missing list go.  Without a selector the last column is flattened.
    """
    name = t.names(sel)[0] if sel is not None else t.columns[-1]
    kind = t.schema[name].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{name!r} holds no lists")
    if isinstance(kind.elementType, T.StructType):
        inner = kind.elementType.names
        clash = [f for f in inner if f in t.columns and f != name]
        exploded = t.df.select(*[quoted(c) for c in t.columns if c != name], F.explode(quoted(name)).alias("__row"))
        at = t.columns.index(name)
        cols = [quoted(c) for c in t.columns[:at]]
        cols += [F.col("__row").getField(f).alias(f"{name}_{f}" if f in clash else f) for f in inner]
        return KeyedFrame(exploded.select(*cols, *[quoted(c) for c in t.columns[at + 1 :]]), [k for k in t.keys if k != name], "table")
    df = t.df.select(*[F.explode(quoted(c)).alias(c) if c == name else quoted(c) for c in t.columns])
    return KeyedFrame(df, [k for k in t.keys if k != name], "table")


def mapslices(t: KeyedFrame, f: Callable, dims: Any, returns: str, outkeys: Any = ()) -> KeyedFrame:
    """A pandas function of each slice over the trailing dimensions ``dims``.

    The leading dimensions identify a slice.  ``f`` gets a DataFrame with ``dims`` and values; its
    result (a DataFrame, a row or a value) has the columns of ``returns``; ``outkeys`` names those that
    become further dimensions.
    """
    dims = t.names([t.keys[d - 1] if isinstance(d, int) else d for d in (dims if isinstance(dims, (list, tuple)) else [dims])])
    lead = [k for k in t.keys if k not in dims]
    if list(t.keys[len(lead) :]) != dims:
        raise ValueError(f"{dims} are not the trailing dimensions of {list(t.keys)}")
    body = T._parse_datatype_string(returns)
    fields = [x.name for x in body.fields]
    schema = T.StructType([*[t.schema[k] for k in lead], *body.fields])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        got = f(group.drop(columns=lead).sort_values(dims).reset_index(drop=True))
        if not isinstance(got, pd.DataFrame):
            got = pd.DataFrame([got if isinstance(got, tuple) else tuple(got.values()) if isinstance(got, dict) else (got,)], columns=fields)
        got = got[fields].copy()
        for k, v in reversed(list(zip(lead, key))):
            got.insert(0, k, [v] * len(got))
        return got

    source = t.df.select(*[quoted(c) for c in [*t.keys, *t.values]])
    grouped = source.groupBy(*[quoted(k) for k in lead]).applyInPandas(run, schema)
    keys = [*lead, *(outkeys if isinstance(outkeys, (list, tuple)) else [outkeys])]
    return KeyedFrame(grouped, keys, "array" if keys else "table")
