"""Reductions and grouping.

``groupreduce`` takes reducers that combine on the map side, so a group of any size costs one
partial result for each task.  ``groupby`` may also take functions of the whole group; known
statistics still run as built-in aggregates, and only other functions bring a group together.
``fold`` runs any associative Python function the same way as a built-in aggregate: partial folds
in each task, then a fold of the partial results.
"""

from __future__ import annotations

import inspect
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import aggs
from keyloom import selectors as S
from keyloom.frame import ARRAY, KeyedFrame, quoted
from keyloom.session import partitions


def _triples(t: KeyedFrame, f: Any, by: list[str], sel: Any) -> list[tuple[str, Column, Any]]:
    """(output name, input expression, statistic) for all accepted spellings."""
    default = sel if sel is not None else [c for c in t.columns if c not in by] or list(t.columns)
    base = t.exprs(default)
    out: list[tuple[str, Column, Any]] = []

    def add(name: str | None, stat: Any, inputs: list[tuple[str, Column]]) -> None:
        stat = aggs.stat(stat)
        for n, c in inputs:
            label = name or stat.name
            out.append((label if len(inputs) == 1 else f"{n}_{label}", c, stat))

    items = f if isinstance(f, list) else list(f) if isinstance(f, tuple) and not S._is_pair(f) and not _spec(f) else [f]
    if isinstance(f, dict):
        items = [(n, *(x if isinstance(x, tuple) else (None, x))) for n, x in f.items()]
    for item in items:
        if isinstance(item, tuple) and len(item) == 3:
            name, s, stat = item
            add(name, stat, t.exprs(s) if s is not None else base)
        elif isinstance(item, tuple) and len(item) == 2 and isinstance(item[0], str) and not isinstance(item[1], (int,)):
            add(item[0], item[1], base)
        else:
            add(None, item, base)
    if len({n for n, _, _ in out}) != len(out):
        raise ValueError(f"names would repeat: {[n for n, _, _ in out]}")
    return out


def _spec(f: tuple) -> bool:
    return len(f) == 3 and isinstance(f[0], str) and f[0] not in aggs.NAMED or len(f) == 2 and isinstance(f[0], str) and f[0] not in aggs.NAMED


def _aggregates(t: KeyedFrame, f: Any, by: list[str], sel: Any, skipmissing: bool) -> list[Column]:
    return [stat(c, skipmissing).alias(n) for n, c, stat in _triples(t, f, by, sel)]


def reduce(t: KeyedFrame, f: Any, sel: Any = None, dims: Any = None, init: Any = None, skipmissing: bool = True, returns: str | None = None) -> Any:
    """Reduce all rows to one.

    ``f``: a reducer, several, ``{name: f}`` or ``{name: (selector, f)}``.  A single reducer of a
    single column gives a value, several give a row.  ``init`` is combined with the result by the
    reducer itself.  A function of two values that is associative and commutative is applied in tasks and then
    to their results (``returns`` is its type, that of the column by default); ``init`` takes part once.  With ``dims`` the dimensions named are removed from an array instead.
    """
    if dims is not None:
        if t.kind != ARRAY:
            raise TypeError("only arrays have dimensions to reduce")
        if init is not None:
            raise TypeError("init does not go with dims")
        return reducedim(t, f, dims, skipmissing)
    if _takes_two(f):
        inputs = t.exprs(sel if sel is not None else list(t.columns))
        kind = returns or t.df.select(inputs[0][1]).schema[0].dataType.simpleString()
        rows = fold(t, f, sel if sel is not None else list(t.columns), by=[], returns=kind).df.collect()
        value = rows[0][0] if rows else None
        return value if init is None else init if value is None else f(init, value)
    cols = _aggregates(t, f, [], sel, skipmissing)
    row = t.df.agg(*cols).first()
    if len(cols) > 1:
        if init is not None:
            raise TypeError("init needs a single reducer")
        return row
    value = row[0]
    if init is not None:
        value = _with_init(f, value, init)
    return value


def _takes_two(f: Any) -> bool:
    """Whether f is a plain function of two values (and no known reducer)."""
    if not callable(f) or isinstance(f, (aggs.Stat, aggs.Several, type)):
        return False
    try:
        if f in aggs.FUNCTIONS:
            return False
        required = [p for p in inspect.signature(f).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    except (TypeError, ValueError):
        return False
    return len(required) == 2


def _with_init(f: Any, value: Any, init: Any) -> Any:
    name = aggs.stat(f).name
    if value is None:
        return init
    join = {"+": lambda a, b: a + b, "sum": lambda a, b: a + b, "*": lambda a, b: a * b, "prod": lambda a, b: a * b}
    join |= dict.fromkeys(("min", "minimum"), min) | dict.fromkeys(("max", "maximum"), max)
    if name not in join:
        raise TypeError(f"{name} takes no initial value")
    return join[name](init, value)


def reducedim(t: KeyedFrame, f: Any, dims: Any, skipmissing: bool = True) -> KeyedFrame:
    """Remove dimensions; the cells that fall together are combined."""
    gone = t.names([t.keys[d - 1] if isinstance(d, int) else d for d in (dims if isinstance(dims, (list, tuple)) else [dims])])
    kept = [k for k in t.keys if k not in gone]
    if not kept:
        raise ValueError("at least one dimension must stay; use reduce without dims")
    stat = aggs.stat(f)
    df = t.df.groupBy(*[quoted(k) for k in kept]).agg(*[stat(quoted(v), skipmissing).alias(v) for v in t.values])
    return KeyedFrame(df, kept, ARRAY)


def reducedim_vec(t: KeyedFrame, f: Any, dims: Any, returns: str | None = None) -> KeyedFrame:
    """Remove dimensions; ``f`` gets all cells that fall together at once.

    ``f``: a statistic, or with ``returns`` (a type) a pandas function from the Series of the cells, in the order of the
    removed dimensions, to a value; the array then has one value column.
    """
    if returns is None:
        return reducedim(t, f, dims)
    gone = t.names([t.keys[d - 1] if isinstance(d, int) else d for d in (dims if isinstance(dims, (list, tuple)) else [dims])])
    kept = [k for k in t.keys if k not in gone]
    if not kept:
        raise ValueError("at least one dimension must stay; use reduce without dims")
    (v,) = t.values
    out = _grouped_map(t, lambda group: (f(group.sort_values(gone)[v].reset_index(drop=True)),), kept, [*gone, v], False, False, f"`{v}` {returns}")
    return KeyedFrame(out.df, kept, ARRAY)


def groupreduce(t: KeyedFrame, f: Any, by: Any = None, sel: Any = None, skipmissing: bool = True, named: bool = False) -> KeyedFrame:
    """One row for each group with the reduced columns; ``by`` defaults to the key."""
    keys = list(t.keys) if by is None else t.names(by)
    groups = t.exprs(by) if by is not None and not isinstance(by, (list, tuple, str, int)) else [(k, quoted(k)) for k in keys]
    if not groups:
        raise ValueError("there is no key to group by; use reduce")
    cols = _aggregates(t, f, keys, sel, skipmissing)
    df = t.df.groupBy(*[c.alias(n) for n, c in groups]).agg(*cols)
    return KeyedFrame(df, [n for n, _ in groups], t.kind if t.kind == ARRAY else "table")


def groupby(
    t: KeyedFrame,
    f: Any,
    by: Any = None,
    sel: Any = None,
    flatten: bool = False,
    usekey: bool = False,
    returns: str | None = None,
    skipmissing: bool = True,
) -> Any:
    """Functions of whole groups.

    Known statistics are built-in aggregates.  ``returns`` (a schema for the columns after the
    key) makes ``f`` a pandas function of the group (of key and group with ``usekey``): its result
    is a row, or with ``flatten`` any number of rows.  ``flatten`` with a statistic that returns a
    list gives one row for each element.  An empty key gives a value, as ``reduce`` does.
    """
    keys = list(t.keys) if by is None else t.names(by)
    if returns is not None:
        return _grouped_map(t, f, keys, sel, flatten, usekey, returns)
    if not keys:
        return reduce(t, f, sel, skipmissing=skipmissing)
    out = groupreduce(t, f, by if by is not None else keys, sel, skipmissing)
    if flatten:
        from keyloom.operators.reshape import flatten as explode

        lists = [x.name for x in out.schema.fields if isinstance(x.dataType, T.ArrayType)]
        for c in lists:
            out = explode(out, c)
    return out


def _grouped_map(t: KeyedFrame, f: Callable, keys: list[str], sel: Any, flatten: bool, usekey: bool, returns: str) -> KeyedFrame:
    wanted = t.names(sel) if sel is not None else [c for c in t.columns if c not in keys]
    body = T.StructType.fromDDL(returns) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(returns)
    schema = T.StructType([*[t.schema[k] for k in keys], *body.fields])
    fields = [x.name for x in body.fields]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        part = group[wanted]
        got = f(key, part) if usekey else f(part)
        if isinstance(got, pd.DataFrame):
            out = got.copy()
        elif isinstance(got, dict):
            out = pd.DataFrame(got if flatten else {k: [v] for k, v in got.items()})
        elif flatten:
            out = pd.DataFrame({fields[0]: list(got)})
        else:
            out = pd.DataFrame([got if isinstance(got, tuple) else (got,)], columns=fields)
        for k, v in reversed(list(zip(keys, key))):
            out.insert(0, k, [v] * len(out), allow_duplicates=True)
        out.columns = [*keys, *fields]
        return out

    df = t.df.select(*[quoted(c) for c in dict.fromkeys([*keys, *wanted])]).groupBy(*[quoted(k) for k in keys]).applyInPandas(run, schema)
    return KeyedFrame(df, keys)


def summarize(t: KeyedFrame, f: Any, by: Any = None, sel: Any = None, skipmissing: bool = True) -> Any:
    """A grid of columns by statistics.

    Names: ``column_statistic``; only the statistic for a single selected column; only the column
    for a single statistic.  Grouped by the key where there is one.
    """
    keys = list(t.keys) if by is None else t.names(by)
    inputs = t.exprs(sel) if sel is not None else [(c, quoted(c)) for c in t.columns if c not in keys]
    if isinstance(f, dict):
        stats = [(n, aggs.stat(x)) for n, x in f.items()]
    else:
        stats = [(s.name, s) for s in map(aggs.stat, f if isinstance(f, (list, tuple)) else [f])]
    one_column = sel is not None and isinstance(sel, (str, int)) and len(inputs) == 1
    one_stat = not isinstance(f, (list, tuple, dict))

    def name(c: str, s: str) -> str:
        return s if one_column else c if one_stat else f"{c}_{s}"

    cols = [s(c, skipmissing).alias(name(n, label)) for label, s in stats for n, c in inputs]
    if not keys:
        return t.df.agg(*cols).first()
    return KeyedFrame(t.df.groupBy(*[quoted(k) for k in keys]).agg(*cols), keys)


class Mergeable:
    """A statistic that sees one value at a time and can be merged.

    ``start()`` makes an empty state, ``fit(state, value)`` and ``merge(state, state)`` return a state,
    ``value(state)`` gives the result.  States are pickled between tasks.
    """

    def __init__(self, start: Callable, fit: Callable, merge: Callable, value: Callable = lambda s: s, returns: str = "double"):
        self.start, self.fit, self.merge, self.value, self.returns = start, fit, merge, value, returns


def fold(t: KeyedFrame, stat: Mergeable | Callable, value: Any, by: Any = None, name: str = "value", returns: str = "double") -> KeyedFrame:
    """A custom mergeable statistic, or any associative and commutative ``f(a, b)``.

    Each task folds its rows to one state a group; the states are shuffled, about one for each
    task and group, and merged.  Several columns reach the function as a dict.  Missing values are
    skipped.
    """
    if not isinstance(stat, Mergeable):
        f = stat
        nothing = None
        stat = Mergeable(lambda: nothing, lambda s, v: v if s is None else f(s, v), lambda a, b: b if a is None else a if b is None else f(a, b), returns=returns)
    keys = list(t.keys) if by is None else t.names(by)
    inputs = t.exprs(value)
    expr = inputs[0][1] if len(inputs) == 1 else F.struct(*[c.alias(n) for n, c in inputs])
    fields = [t.schema[k] for k in keys]
    source = t.df.select(*[quoted(k) for k in keys], expr.alias("__value"))
    middle = T.StructType([*fields, T.StructField("__state", T.BinaryType())])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for row in zip(*lists):
                key = row[:-1]
                state = states[key] if key in states else stat.start()
                states[key] = state if row[-1] is None else stat.fit(state, row[-1])
            if len(states) > 200_000:  # many groups: give the states on
                yield from _states(states, arrow)
                states = {}
        yield from _states(states, arrow)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # states come in the order of their keys, so one group is open at a time
        done: dict[tuple, Any] = {}
        key, held = None, None
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for row in zip(*lists):
                state = pickle.loads(row[-1])
                if key is not None and row[:-1] == key:
                    held = stat.merge(held, state)
                    continue
                if key is not None:
                    done[key] = held
                key, held = row[:-1], state
                if len(done) >= 10_000:
                    yield from _states(done, arrow)
                    done = {}
        if key is not None:
            # a key that is no number may come again under another spelling of nothing (NaN): merged here
            done[key] = stat.merge(done[key], held) if key in done else held
        yield from _states(done, arrow)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [stat.value(pickle.loads(s)) for s in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, final_type)], [*keys, name])

    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    arrow = to_arrow_schema(middle)
    kind = T._parse_datatype_string(stat.returns)
    final_type = to_arrow_type(kind)
    partial = source.mapInArrow(grow, middle)
    if keys:
        order = [quoted(k) for k in keys]
        merged = partial.repartition(partitions(t.df), *order).sortWithinPartitions(*order).mapInArrow(join, middle)
    else:
        merged = partial.coalesce(1).mapInArrow(join, middle)
    schema = T.StructType([*fields, T.StructField(name, kind)])
    return KeyedFrame(merged.mapInArrow(end, schema), keys)


def _states(states: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = list(states.items())
    for a in range(0, len(rows), 10_000):
        part = rows[a : a + 10_000]
        columns = list(zip(*[(*k, pickle.dumps(s)) for k, s in part]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def mapchunks(t: KeyedFrame, f: Callable, returns: str) -> DataFrame:
    """A pandas function over pieces of a partition, without order among them."""
    def run(batches):
        for pdf in batches:
            yield f(pdf)

    return t.df.mapInPandas(run, returns)


def countmap(t: KeyedFrame, column: Any, by: Any = None) -> KeyedFrame:
    """How often each value occurs: a map for each group.  Counts combine before the map is built."""
    keys = list(t.names(by)) if by is not None else []
    ((n, c),) = t.exprs(column)
    counts = t.df.groupBy(*[quoted(k) for k in keys], c.alias("__v")).agg(F.count("*").alias("__n")).where(F.col("__v").isNotNull())
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("__v", "__n")))).alias("counts")
    return KeyedFrame(counts.groupBy(*[quoted(k) for k in keys]).agg(entries), keys)


def mosaic(t: KeyedFrame, a: Any, b: Any) -> KeyedFrame:
    """Counts of every pair of values."""
    x, y = t.exprs(a)[0], t.exprs(b)[0]
    df = t.df.groupBy(x[1].alias(x[0]), y[1].alias(y[0])).agg(F.count("*").alias("count"))
    return KeyedFrame(df, [x[0], y[0]], ARRAY)


def partitioned(t: KeyedFrame, y: Any, stat: Any = "extrema", parts: int = 100, x: Any = None, by: Any = None, dropmissing: bool = False) -> KeyedFrame:
    """A summary of ``y`` in ``parts`` buckets, for plots.

    Without ``x`` the buckets are stretches of rows in key order of about equal size; with ``x``
    they are ranges of x of equal width.  ``by`` summarises groups apart.
    """
    if parts < 1:
        raise ValueError("there must be at least one part")
    keys = t.names(by) if by is not None else []
    (yn, yc) = t.exprs(y)[0]
    if dropmissing:
        t = filter_not_null(t, [yc] + ([t.exprs(x)[0][1]] if x is not None else []))
    s = aggs.stat(stat)
    if x is None:
        row = "__row"
        df = t.with_row_number(row, 0)
        n = df.count()
        bucket = F.floor(quoted(row) * parts / F.lit(max(n, 1))).cast("int")
        extra = [F.min(quoted(row)).alias("first_row"), F.max(quoted(row)).alias("last_row")]
    else:
        xc = t.exprs(x)[0][1]
        df = t.df
        low, high = df.agg(F.min(xc), F.max(xc)).first()
        if low is None:
            low, high = 0, 0
        width = (float(high) - float(low)) / parts or 1.0
        bucket = F.least(F.floor((xc - F.lit(low)) / F.lit(width)), F.lit(parts - 1)).cast("int")
        extra = [F.min(xc).alias("x_min"), F.max(xc).alias("x_max")]
    out = df.groupBy(*[quoted(k) for k in keys], bucket.alias("bucket")).agg(*extra, s(yc).alias(s.name))
    return KeyedFrame(out, [*keys, "bucket"])


def filter_not_null(t: KeyedFrame, cols: list[Column]) -> KeyedFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & c.isNotNull()
    return t.like(t.df.where(cond))
