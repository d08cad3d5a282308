"""Projection and editing of columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import selectors as S
from keyloom.frame import ARRAY, KeyedFrame, quoted
from keyloom.session import fresh


def _aliased(pairs: list[tuple[str, Column]]) -> list[Column]:
    return [c.alias(n) for n, c in pairs]


def select(t: KeyedFrame, sel: Any) -> KeyedFrame:
    """The selected columns; the key stays where all key columns are among them.

    A list of values (no names, positions or functions), or a dict of such lists, stands for itself: columns of
    these values in key order, as many as there are rows.
    """
    if isinstance(sel, dict):  # {name: values in key order}
        wide = t
        for name, values in sel.items():
            wide = _with_literal(wide, fresh(name), list(values))
        added = wide.columns[len(t.columns) :]
        return KeyedFrame(wide.df.select(*[quoted(c).alias(n) for c, n in zip(added, sel)]))
    if isinstance(sel, list) and sel and all(not isinstance(x, (str, int, tuple, list, dict)) and not callable(x) and not S.is_expression(x) for x in sel):
        return select(t, {"_1": sel})  # a literal array
    pairs = t.exprs(sel)
    kept = [n for n, _ in pairs]
    keys = t.keys if t.keys and all(k in kept for k in t.keys) else ()
    return KeyedFrame(t.df.select(*_aliased(pairs)), keys, t.kind if keys else "table")


def rows(t: KeyedFrame, sel: Any = None) -> DataFrame:
    """One struct for each row."""
    return t.df.select(F.struct(*_aliased(t.exprs(sel))).alias("row"))


def columns(t: KeyedFrame, sel: Any = None) -> dict[str, DataFrame]:
    """Each selected column as a frame of its own."""
    return {n: t.df.select(c.alias(n)) for n, c in t.exprs(sel)}


def column(t: KeyedFrame, sel: Any) -> DataFrame:
    """One column; the selector must stand for one."""
    pairs = t.exprs(sel)
    if len(pairs) != 1:
        raise KeyError(f"{sel!r} stands for {len(pairs)} columns")
    return t.df.select(*_aliased(pairs))


def key_rows(t: KeyedFrame) -> DataFrame:
    """The key of each row, or the row number where there is no key."""
    return t.df.select(*[quoted(k) for k in t.keys]) if t.keys else t.with_row_number("row").select("row")


def value_rows(t: KeyedFrame, which: Any = None) -> DataFrame:
    return t.df.select(*_aliased(t.exprs(which if which is not None else list(t.values))))


def pairs(t: KeyedFrame) -> DataFrame:
    """``key, value`` structs."""
    return t.df.select(F.struct(*[quoted(k) for k in t.keys]).alias("key"), F.struct(*[quoted(v) for v in t.values]).alias("value"))


def map_rows(t: KeyedFrame, f: Callable, sel: Any = None, returns: str | None = None) -> KeyedFrame:
    """``f`` of each row.

    ``f`` builds expressions from a row of Columns.  With ``returns`` (a schema or type) it is a
    pandas function instead: of a Series for a single column, of a DataFrame for several.
    """
    single = isinstance(sel, (int, str))
    if returns is None:
        out = t.exprs(S.Via(sel if sel is not None else list(t.columns), f))
        named = [("value" if len(out) == 1 and not single and n == S.function_name(f) else n, c) for n, c in out]
        if t.kind == ARRAY:
            return KeyedFrame(t.df.select(*[quoted(k) for k in t.keys], *_aliased(named)), t.keys, ARRAY)
        return KeyedFrame(t.df.select(*_aliased(named)))
    wanted = t.names(sel)
    if ":" in returns or " " in returns:
        def run(batches):
            for pdf in batches:
                yield f(pdf[wanted[0]] if single else pdf[wanted])

        return KeyedFrame(t.df.select(*[quoted(c) for c in wanted]).mapInPandas(run, returns))
    udf = F.pandas_udf(f, returns)
    return KeyedFrame(t.df.select(udf(*[quoted(c) for c in wanted]).alias(wanted[0] if single else "value")))


def transform(t: KeyedFrame, changes: dict[str, Any]) -> KeyedFrame:
    """Replace or append columns; expressions see the columns as they were before."""
    new: dict[str, Column] = {}
    for name, sel in changes.items():
        if callable(sel) and not isinstance(sel, (type, Column)):
            sel = S.Via(list(t.columns), sel)
        if isinstance(sel, (bool, float)) or sel is None or isinstance(sel, list):
            if isinstance(sel, list):
                return transform(_with_literal(t, name, sel), {k: v for k, v in changes.items() if k != name})
            new[name] = F.lit(sel)
            continue
        new[name] = t.exprs(sel)[0][1]
    return t.like(t.df.withColumns(new))


def _with_literal(t: KeyedFrame, name: str, values: list) -> KeyedFrame:
    """A column of given values in key order; as many as there are rows."""
    row = fresh("row")
    numbered = t.with_row_number(row)
    n = numbered.count()
    if n != len(values):
        raise ValueError(f"{len(values)} values for {n} rows")
    given = t.df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values, 1)], [row, fresh("v")])
    joined = numbered.join(given.toDF(row, "__given"), row).drop(row)
    cols = [F.col("__given").alias(name) if c == name else quoted(c) for c in t.columns]
    if name not in t.columns:
        cols.append(F.col("__given").alias(name))
    return t.like(joined.select(*cols))


def insertcols(t: KeyedFrame, position: int, new: dict[str, Any]) -> KeyedFrame:
    """Insert columns so that the first stands at ``position`` (from 1)."""
    if not 1 <= position <= len(t.columns) + 1:
        raise IndexError(f"no position {position} among {len(t.columns)} columns")
    clash = [n for n in new if n in t.columns]
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    wide = transform(t, new)
    order = [*t.columns[: position - 1], *new, *t.columns[position - 1 :]]
    return t.like(wide.df.select(*[quoted(c) for c in order]))


def insertcolsafter(t: KeyedFrame, after: Any, new: dict[str, Any]) -> KeyedFrame:
    return insertcols(t, t.columns.index(t.names(after)[0]) + 2, new)


def insertcolsbefore(t: KeyedFrame, before: Any, new: dict[str, Any]) -> KeyedFrame:
    return insertcols(t, t.columns.index(t.names(before)[0]) + 1, new)


def rename(t: KeyedFrame, names: dict[Any, str]) -> KeyedFrame:
    change = {t.names(old)[0]: new for old, new in names.items()}
    final = [change.get(c, c) for c in t.columns]
    if len(set(final)) != len(final):
        raise ValueError(f"names would repeat: {final}")
    return KeyedFrame(t.df.toDF(*final), [change.get(k, k) for k in t.keys], t.kind)


def reindex(t: KeyedFrame, by: Any, sel: Any = None) -> KeyedFrame:
    """A new key; its columns come first."""
    by = t.names(by)
    rest = t.names(sel) if sel is not None else t.columns
    return KeyedFrame(t.df.select(*[quoted(c) for c in [*by, *[c for c in rest if c not in by]]]), by, t.kind)


def permutedims(t: KeyedFrame, order: list[Any]) -> KeyedFrame:
    """The dimensions in another order."""
    dims = [t.keys[d - 1] if isinstance(d, int) and 1 <= d <= len(t.keys) else d for d in order]
    if sorted(map(str, dims)) != sorted(t.keys):
        raise ValueError(f"{order} is no permutation of {list(t.keys)}")
    return KeyedFrame(t.df.select(*[quoted(c) for c in [*dims, *t.values]]), dims, t.kind)


def selectkeys(t: KeyedFrame, which: Any, agg: Any = None) -> KeyedFrame:
    """Keep some dimensions; cells that then collide are combined by ``agg``, or kept."""
    from keyloom.operators.group import groupreduce

    dims = t.names([t.keys[d - 1] if isinstance(d, int) else d for d in (which if isinstance(which, (list, tuple)) else [which])])
    if agg is None:
        return KeyedFrame(t.df.select(*[quoted(c) for c in [*dims, *t.values]]), dims, t.kind)
    return KeyedFrame(groupreduce(t, [(v, v, agg) for v in t.values], dims, named=True).df, dims, t.kind)


def selectvalues(t: KeyedFrame, which: Any) -> KeyedFrame:
    return KeyedFrame(t.df.select(*[quoted(k) for k in t.keys], *_aliased(t.exprs(which))), t.keys, t.kind)


def convertdim(t: KeyedFrame, dim: Any, mapping: Any, agg: Any = None, vecagg: Any = None, name: str | None = None) -> KeyedFrame:
    """Map one dimension by an expression or a dict and combine cells that collide.

    ``agg``: a reducer; ``vecagg``: a statistic of the whole group; without either the cells are kept.
    A value that the dict does not have becomes null.
    """
    from keyloom.operators.group import groupreduce

    old = t.keys[dim - 1] if isinstance(dim, int) else t.names(dim)[0]
    if old not in t.keys:
        raise KeyError(f"{old!r} is no dimension")
    if isinstance(mapping, dict):
        value = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[quoted(old)] if mapping else F.lit(None)
    else:
        value = S.apply(mapping, [(old, quoted(old))], True)
    new = name or old
    dims = [new if k == old else k for k in t.keys]
    moved = KeyedFrame(t.df.select(*[value.alias(new) if c == old else quoted(c) for c in [*t.keys, *t.values]]), dims, t.kind)
    f = vecagg if vecagg is not None else agg
    if f is None:
        return moved
    return KeyedFrame(groupreduce(moved, [(v, v, f) for v in moved.values], dims, named=True).df, dims, t.kind)


def dropmissing(t: KeyedFrame, sel: Any = None) -> KeyedFrame:
    """Drop rows with a missing value in any of the selected columns (NaN is a value)."""
    cond = F.lit(True)
    for c in t.names(sel):
        cond = cond & quoted(c).isNotNull()
    return t.like(t.df.where(cond))


def convertmissing(t: KeyedFrame, kind: Any = None) -> KeyedFrame:
    """There is one representation of missing here: NULL."""
    return t


def column_types(t: KeyedFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in t.schema.fields}
