"""Joins: equi-joins, group joins, as-of joins and broadcasting over dimensions.

Null keys never match unless ``null_safe`` is set.  Columns of the same name on both sides get the suffixes
``_1`` and ``_2``.  Physical joins are left to Catalyst, which also reads the sizes at run time;
``broadcast=True`` is a request that is granted only to a side with a checked number of rows.
"""

from __future__ import annotations

from functools import reduce as fold_left
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import selectors as S
from keyloom.frame import ARRAY, KeyedFrame, quoted
from keyloom.session import checkpointed, guarded_broadcast, partitions

HOW = ("inner", "left", "outer", "anti")


def _sides(left: KeyedFrame, right: KeyedFrame, lkey: Any, rkey: Any, lselect: Any, rselect: Any):
    lk = left.names(lkey) if lkey is not None else list(left.keys)
    rk = right.names(rkey) if rkey is not None else (list(right.keys) if right.keys and lkey is None else lk if lkey is not None and rkey is None else list(right.keys))
    if not lk:
        raise ValueError("there is no key to join on")
    if len(lk) != len(rk):
        raise ValueError(f"{len(lk)} key columns on the left, {len(rk)} on the right")
    ls = [(n, c) for n, c in left.exprs(lselect if lselect is not None else [c for c in left.columns if c not in lk]) if n not in lk]
    rs = [(n, c) for n, c in right.exprs(rselect if rselect is not None else [c for c in right.columns if c not in rk]) if n not in rk]
    l_names, r_names = {n for n, _ in ls}, {n for n, _ in rs}
    both = (l_names & r_names) | (set(lk) & (l_names | r_names))
    l_out = [(f"{n}_1" if n in both else n) for n, _ in ls]
    r_out = [(f"{n}_2" if n in both else n) for n, _ in rs]
    ldf = left.df.select(*[quoted(k).alias(f"__l{i}") for i, k in enumerate(lk)], *[c.alias(f"__a{i}") for i, (_, c) in enumerate(ls)])
    rdf = right.df.select(*[quoted(k).alias(f"__r{i}") for i, k in enumerate(rk)], *[c.alias(f"__b{i}") for i, (_, c) in enumerate(rs)])
    return lk, ldf, l_out, rdf, r_out


def _on(n: int, null_safe: bool) -> Column:
    match = [F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}")) if null_safe else F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(n)]
    return fold_left(lambda a, b: a & b, match)


def join(
    left: KeyedFrame,
    right: KeyedFrame,
    how: str = "inner",
    f: Any = None,
    lkey: Any = None,
    rkey: Any = None,
    lselect: Any = None,
    rselect: Any = None,
    broadcast: Any = False,
    null_safe: bool = False,
    missingtype: Any = None,
) -> KeyedFrame:
    """Equi-join; the keys default to the keys of the frames, the columns to all others.

    ``how``: inner, left, outer (keys of both sides as one) or anti (left rows without a match, left
    columns only).  ``f`` combines the value columns of matching rows: it gets a row of the left
    and a row of the right values and returns a Column or a dict of Columns.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    if broadcast == "left":
        raise ValueError("only the right side can be broadcast")
    if broadcast and how == "outer":
        raise ValueError("an outer join cannot broadcast")
    lk, ldf, l_out, rdf, r_out = _sides(left, right, lkey, rkey, lselect, rselect)
    if how == "anti":
        rdf = rdf.select(*[f"__r{i}" for i in range(len(lk))])
    if broadcast:
        rdf = guarded_broadcast(rdf)
    kind = {"inner": "inner", "left": "left", "outer": "full", "anti": "left_anti"}[how]
    df = ldf.join(rdf, _on(len(lk), null_safe), kind)
    key = [(F.coalesce(F.col(f"__l{i}"), F.col(f"__r{i}")) if how == "outer" else F.col(f"__l{i}")).alias(k) for i, k in enumerate(lk)]
    a = [(n, F.col(f"__a{i}")) for i, n in enumerate(l_out)]
    b = [(n, F.col(f"__b{i}")) for i, n in enumerate(r_out)] if how != "anti" else []
    if f is None:
        cells = [c.alias(n) for n, c in [*a, *b]]
    else:
        cells = _combined(f, a, b)
    return KeyedFrame(df.select(*key, *cells), lk, left.kind if left.kind == ARRAY else "table")


def _combined(f: Any, a: list[tuple[str, Column]], b: list[tuple[str, Column]]) -> list[Column]:
    """``f`` of the left and right values; single columns come bare."""
    x = a[0][1] if len(a) == 1 else S.Row([(n.removesuffix("_1"), c) for n, c in a])
    y = b[0][1] if len(b) == 1 else S.Row([(n.removesuffix("_2"), c) for n, c in b])
    out = f(x, y)
    if isinstance(out, dict):
        return [c.alias(n) for n, c in out.items()]
    if isinstance(out, tuple):
        return [c.alias(f"_{i}") for i, c in enumerate(out, 1)]
    name = a[0][0].removesuffix("_1") if len(a) == 1 else "value"
    return [out.alias(name)]


def innerjoin(left: KeyedFrame, right: KeyedFrame, f: Any = None) -> KeyedFrame:
    """Inner join of arrays on all dimensions; ``f`` combines the cells."""
    return join(left, right, "inner", f)


naturaljoin = innerjoin


def leftjoin(left: KeyedFrame, right: KeyedFrame, f: Any = None) -> KeyedFrame:
    """Left join of arrays; ``f`` sees null where the right side has no cell."""
    return join(left, right, "left", f)


def map_pair(f: Any, left: KeyedFrame, right: KeyedFrame) -> KeyedFrame:
    """``f`` of the cells that both arrays have."""
    return join(left, right, "inner", f)


def groupjoin(left: KeyedFrame, right: KeyedFrame, how: str = "inner", f: Any = None, lkey: Any = None, rkey: Any = None, lselect: Any = None, rselect: Any = None) -> KeyedFrame:
    """One row for each key with the list of its joined rows in ``groups``.

    Keys without a match (left and outer) have an empty list.  The lists are sorted.  With ``f``, a
    statistic of a single value column or a dict ``{name: (column, statistic)}``, groups are reduced
    as they join and no list is built.
    """
    if how not in ("inner", "left", "outer"):
        raise ValueError("how must be inner, left or outer")
    matched = join(left, right, "inner", lkey=lkey, rkey=rkey, lselect=lselect, rselect=rselect)
    lk = list(matched.keys)
    rk = right.names(rkey) if rkey is not None else (list(right.keys) if lkey is None else lk)
    if f is None:
        cells = [quoted(c) for c in matched.values]
        groups = matched.df.groupBy(*[quoted(k) for k in lk]).agg(F.sort_array(F.collect_list(F.struct(*cells))).alias("groups"))
    else:
        from keyloom.operators.group import groupreduce

        groups = groupreduce(matched, f, lk).df
    if how == "inner":
        return KeyedFrame(groups, lk)
    every = left.df.select(*[quoted(k) for k in (left.names(lkey) if lkey is not None else left.keys)])
    if how == "outer":
        every = every.union(right.df.select(*[quoted(k) for k in rk]))
    every = every.distinct().toDF(*[f"__k{i}" for i in range(len(lk))])
    same = fold_left(lambda x, y: x & y, [F.col(f"__k{i}").eqNullSafe(quoted(k)) for i, k in enumerate(lk)])
    wide = every.join(groups, same, "left")
    rest = [c for c in groups.columns if c not in lk]
    cells = [F.coalesce(quoted(c), F.array()).alias(c) if f is None else quoted(c) for c in rest]
    return KeyedFrame(wide.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(lk)], *cells), lk)


def asofjoin(left: KeyedFrame, right: KeyedFrame, tile: str | int | None = "auto") -> KeyedFrame:
    """The last right row not after the left row, for equal leading keys.

    Keys but the last must be equal, the last is matched backwards (an equal one counts).  Value
    columns of the same name are replaced by the match and keep the left value if there is none;
    other right columns are added.  Of right rows with equal keys the largest values win.

    One sorted pass over both sides: right rows sort before left rows of the same key, and each
    left row takes the last right row seen.  ``tile`` cuts long histories: a width (for numbers) or
    a unit of ``date_trunc`` (for dates); inside a tile the pass is local, and a tile without an
    earlier right row takes the last one of the tiles before, so that a key with a large share of
    the rows is spread over its tiles.  By default dates are cut by month and numbers into ranges of about
    equal size ("parts"); None leaves everything of one key in one pass.
    """
    if len(left.keys) != len(right.keys) or not left.keys:
        raise ValueError("both sides need the same number of keys")
    width = len(left.keys)
    if tile == "auto":
        tile = "month" if isinstance(left.schema[left.keys[-1]].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "parts"
    l = left.df.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(left.keys)], F.lit(1).alias("__side"),
                       F.struct(*[quoted(v) for v in left.values]).alias("__left"))
    r = right.df.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(right.keys)], F.lit(0).alias("__side"),
                        F.struct(*[quoted(v) for v in right.values]).alias("__right"))
    on = F.col(f"__k{width - 1}")
    both = l.unionByName(r, allowMissingColumns=True).where(on.isNotNull() | (F.col("__side") == 1))
    head = [F.col(f"__k{i}") for i in range(width - 1)]
    order = [on, F.col("__side"), F.col("__right")]
    if tile is None:
        w = Window.partitionBy(*head).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("__match", F.last("__right", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    else:
        if tile == "parts":
            ranged = both.repartitionByRange(partitions(both), *head, on)
            tiled = checkpointed(ranged.withColumn("__tile", F.spark_partition_id()))
        else:
            cut = F.date_trunc(tile, on) if isinstance(tile, str) else F.floor(on / F.lit(tile))
            tiled = both.withColumn("__tile", cut)
        w = Window.partitionBy(*head, "__tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        inside = tiled.withColumn("__match", F.last("__right", ignorenulls=True).over(w))
        ends = tiled.groupBy(*head, "__tile").agg(F.max(F.when(F.col("__side") == 0, F.struct(on.alias("at"), F.col("__right").alias("row")))).alias("__end"))
        if head:
            across = Window.partitionBy(*head).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)
            before = F.last("__end", ignorenulls=True).over(across).getField("row")
            carried = ends.select(*[c.alias(f"__t{i}") for i, c in enumerate(head)], F.col("__tile").alias("__tile2"), before.alias("__before"))
        else:
            carried = F.broadcast(_carried_ends(ends))
        same = F.col("__tile").eqNullSafe(F.col("__tile2"))
        for i, c in enumerate(head):
            same = same & c.eqNullSafe(F.col(f"__t{i}"))
        found = inside.where(F.col("__side") == 1).join(carried, same, "left").withColumn("__match", F.coalesce("__match", "__before"))
    # a null in a leading or last key matches nothing
    known = on.isNotNull()
    for c in head:
        known = known & c.isNotNull()
    match = F.when(known, F.col("__match"))
    out = [F.col(f"__k{i}").alias(k) for i, k in enumerate(left.keys)]
    for v in left.values:
        own = F.col("__left").getField(v)
        out.append((F.when(match.isNotNull(), match.getField(v)).otherwise(own) if v in right.values else own).alias(v))
    out += [match.getField(v).alias(v) for v in right.values if v not in left.values]
    return KeyedFrame(found.select(*out), left.keys, left.kind)


def _carried_ends(ends: DataFrame) -> DataFrame:
    """``__tile2, __before``: the last right row before each tile; one row a tile passes through the driver."""
    kind = next(f.dataType for f in ends.schema["__end"].dataType.fields if f.name == "row")
    last, rows = None, []
    for tile, end in sorted(ends.where(F.col("__tile").isNotNull()).collect(), key=lambda r: r[0]):
        rows.append((tile, last))
        last = last if end is None else end["row"]
    schema = T.StructType([T.StructField("__tile2", ends.schema["__tile"].dataType), T.StructField("__before", kind)])
    return ends.sparkSession.createDataFrame(rows, schema)


def broadcast(f: Any, a: KeyedFrame, b: KeyedFrame, dimmap: tuple[int, ...] | None = None) -> KeyedFrame:
    """``f`` of the cells of two arrays whose dimensions match in part.

    The array with fewer dimensions is laid over the other.  ``dimmap`` gives for each dimension
    of the larger array the dimension (from 1) of the smaller one, 0 for none; by default dimensions
    of the same name match.
    """
    if len(a.keys) < len(b.keys):
        return broadcast(lambda x, y: f(y, x), b, a, dimmap)
    if dimmap is None:
        dimmap = tuple(b.keys.index(k) + 1 if k in b.keys else 0 for k in a.keys)
    if len(dimmap) != len(a.keys) or sorted(d for d in dimmap if d) != list(range(1, len(b.keys) + 1)):
        raise ValueError(f"{dimmap} does not map the dimensions {list(b.keys)} to {list(a.keys)}")
    lkey = [k for k, d in zip(a.keys, dimmap) if d]
    rkey = [b.keys[d - 1] for d in dimmap if d]
    rest = [k for k in a.keys if k not in lkey]
    shared = [(v, v) for v in a.values]
    ldf = a.df.select(*[quoted(k).alias(f"__l{i}") for i, k in enumerate(lkey)], *[quoted(k).alias(f"__d{i}") for i, k in enumerate(rest)], *[quoted(v).alias(f"__a{i}") for i, v in enumerate(a.values)])
    rdf = b.df.select(*[quoted(k).alias(f"__r{i}") for i, k in enumerate(rkey)], *[quoted(v).alias(f"__b{i}") for i, v in enumerate(b.values)])
    df = ldf.join(rdf, _on(len(lkey), False), "inner")
    cells = _combined(f, [(n, F.col(f"__a{i}")) for i, (n, _) in enumerate(shared)], [(v, F.col(f"__b{i}")) for i, v in enumerate(b.values)])
    where = {k: F.col(f"__l{i}") for i, k in enumerate(lkey)} | {k: F.col(f"__d{i}") for i, k in enumerate(rest)}
    return KeyedFrame(df.select(*[where[k].alias(k) for k in a.keys], *cells), a.keys, ARRAY)


def rechunk_together(left: KeyedFrame, right: KeyedFrame, lkey: Any = None, rkey: Any = None, chunks: int | None = None) -> tuple[KeyedFrame, KeyedFrame]:
    """Both sides hash-partitioned alike on their keys and kept, so that joins on them need no exchange."""
    lk = left.names(lkey) if lkey is not None else list(left.keys)
    rk = right.names(rkey) if rkey is not None else list(right.keys)
    n = chunks or max(partitions(left.df), partitions(right.df))
    a = left.df.repartition(n, *[quoted(k) for k in lk]).sortWithinPartitions(*[quoted(k) for k in lk])
    b = right.df.repartition(n, *[quoted(k) for k in rk]).sortWithinPartitions(*[quoted(k) for k in rk])
    return left.like(a), right.like(b)

