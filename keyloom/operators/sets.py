"""Order, merging, equality and partitioning of frames."""

from __future__ import annotations

from functools import reduce as fold_left
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom import aggs
from keyloom.frame import ARRAY, KeyedFrame, quoted
from keyloom.session import fresh


def sort(t: KeyedFrame, by: Any = None, sel: Any = None, reverse: bool = False) -> KeyedFrame:
    """Sorted by columns (by the key by default); missing last, first when reversed."""
    order = t.order(by if by is not None else (list(t.keys) or list(t.columns)), reverse)
    df = t.df.orderBy(*order)
    if sel is not None:
        df = df.select(*[c.alias(n) for n, c in t.exprs(sel)])
    return KeyedFrame(df, [k for k in t.keys if k in df.columns] if all(k in df.columns for k in t.keys) else (), "table")


def top(t: KeyedFrame, n: int, by: Any = None, reverse: bool = False) -> DataFrame:
    """The first n rows in an order; kept per partition before they meet."""
    return t.df.orderBy(*t.order(by if by is not None else (list(t.keys) or list(t.columns)), reverse)).limit(n)


def rechunk(t: KeyedFrame, by: Any = None, sel: Any = None, chunks: int | None = None, closed: bool = True, **ignored: Any) -> KeyedFrame:
    """Range-partitioned and sorted by ``by``; bounds come from a sample.

    ``closed``: equal keys share a partition.  With ``closed=False`` ties may be cut (a hot key is
    spread by a random second key).  Sampling options of the scheduler are accepted and ignored.
    """
    by = t.names(by) if by is not None else list(t.keys)
    out = t if sel is None else t.like(t.df.select(*[quoted(c) for c in dict.fromkeys([*by, *t.names(sel)])]), by)
    n = chunks or int(t.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [quoted(c).asc_nulls_last() for c in by]
    if closed:
        return KeyedFrame(out.df.repartitionByRange(n, *order).sortWithinPartitions(*order), by, t.kind)
    salt = fresh("salt")
    salted = out.df.withColumn(salt, F.xxhash64(*[F.col(c) for c in out.df.columns]))
    return KeyedFrame(salted.repartitionByRange(n, *order, salt).sortWithinPartitions(*order).drop(salt), by, t.kind)


def merge(left: KeyedFrame, right: KeyedFrame, agg: Any = "right") -> KeyedFrame:
    """Tables: all rows of both.  Arrays: cells of both.

    Of two arrays' cells with equal keys the right one counts; ``agg`` combines them instead (a
    reducer, or a function of the left and right cell), ``agg=None`` keeps both.
    """
    if left.kind != ARRAY or right.kind != ARRAY or agg is None:
        return left.like(left.df.unionByName(right.df, allowMissingColumns=True))
    if left.keys != right.keys or set(left.values) != set(right.values):
        raise ValueError("arrays to merge have the same dimensions and values")
    width = range(len(left.keys))
    a = left.df.select(*[quoted(k).alias(f"__l{i}") for i, k in enumerate(left.keys)], F.struct(*[quoted(v) for v in left.values]).alias("__a"))
    b = right.df.select(*[quoted(k).alias(f"__r{i}") for i, k in enumerate(left.keys)], F.struct(*[quoted(v) for v in left.values]).alias("__b"))
    same = fold_left(lambda x, y: x & y, [F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}")) for i in width])
    # a marker tells a cell that is null from no cell
    both = a.withColumn("__has_a", F.lit(True)).join(b.withColumn("__has_b", F.lit(True)), same, "full")
    has_a, has_b = F.col("__has_a").isNotNull(), F.col("__has_b").isNotNull()
    key = [F.when(has_a, F.col(f"__l{i}")).otherwise(F.col(f"__r{i}")).alias(k) for i, k in zip(width, left.keys)]
    cells = []
    for v in left.values:
        x, y = F.col("__a").getField(v), F.col("__b").getField(v)
        cells.append(F.when(has_a & has_b, _pair(agg, x, y)).when(has_b, y).otherwise(x).alias(v))
    return KeyedFrame(both.select(*key, *cells), left.keys, ARRAY)


def _pair(agg: Any, x: Any, y: Any) -> Any:
    if agg == "right":
        return y
    if agg == "left":
        return x
    named = {"+": lambda: x + y, "sum": lambda: x + y, "*": lambda: x * y, "prod": lambda: x * y}
    named |= dict.fromkeys(("min", "minimum"), lambda: F.least(x, y)) | dict.fromkeys(("max", "maximum"), lambda: F.greatest(x, y))
    named["mean"] = lambda: (x + y) / 2
    if isinstance(agg, str):
        if agg not in named:
            raise ValueError(f"{agg!r} does not combine two cells")
        return named[agg]()
    try:
        known = aggs.FUNCTIONS.get(agg)
    except TypeError:
        known = None
    return named[known.name]() if known is not None else agg(x, y)


def isequal(a: KeyedFrame, b: KeyedFrame) -> bool:
    """The same rows as often, missing equal to missing."""
    if a.columns != b.columns or a.keys != b.keys:
        return False
    count = lambda df, sign: df.groupBy(*[quoted(c) for c in a.columns]).agg((F.count("*") * sign).alias("__n"))
    differ = count(a.df, 1).unionByName(count(b.df, -1)).groupBy(*[quoted(c) for c in a.columns]).agg(F.sum("__n").alias("__n"))
    return differ.where(F.col("__n") != 0).isEmpty()


def equal(a: KeyedFrame, b: KeyedFrame) -> bool | None:
    """As ``isequal``, but None (unknown) where the frames agree only if missing equals missing."""
    same = isequal(a, b)
    if not same:
        return False
    missing = fold_left(lambda x, y: x | y, [quoted(c).isNull() for c in a.columns])
    return None if not a.df.where(missing).isEmpty() else True


def unique(t: KeyedFrame, sel: Any = None) -> DataFrame:
    """Distinct rows of the selection."""
    return t.df.select(*[c.alias(n) for n, c in t.exprs(sel)]).distinct()


def intersect(a: KeyedFrame, b: KeyedFrame) -> KeyedFrame:
    return a.like(a.df.intersectAll(b.df.select(*[quoted(c) for c in a.columns])))


def subtract(a: KeyedFrame, b: KeyedFrame) -> KeyedFrame:
    return a.like(a.df.exceptAll(b.df.select(*[quoted(c) for c in a.columns])))


def distribute(t: KeyedFrame, layout: int | list[int] | KeyedFrame) -> KeyedFrame:
    """``n`` partitions of about equal size, given numbers of rows, or as many as another frame has."""
    if isinstance(layout, KeyedFrame):
        layout = layout.df.rdd.getNumPartitions()
    if isinstance(layout, int):
        if layout < 1:
            raise ValueError("there must be at least one partition")
        return t.like(t.df.repartition(layout))
    row = fresh("row")
    numbered = t.with_row_number(row, 0)
    n = numbered.count()
    if sum(layout) != n:
        raise ValueError(f"the partitions hold {sum(layout)} rows, the table has {n}")
    ends, total = [], 0
    for size in layout:
        total += size
        ends.append(total)
    part = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col(row))).cast("int")
    placed = numbered.withColumn("__part", part)
    return t.like(placed.repartitionById(len(layout), F.col("__part")).sortWithinPartitions(row).drop("__part", row))


def fromchunks(chunks: list[Any], keys: Any = (), kind: str = "table") -> KeyedFrame:
    """One frame from several; columns that a piece does not have are missing, empty pieces are no matter."""
    frames = [c.df if isinstance(c, KeyedFrame) else c for c in chunks]
    if not frames:
        raise ValueError("there are no pieces")
    keys = keys or next((c.keys for c in chunks if isinstance(c, KeyedFrame)), ())
    return KeyedFrame(fold_left(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), keys, kind)
