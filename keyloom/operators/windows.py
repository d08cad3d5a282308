"""Idioms over ordered groups: ranks, first rows of groups, differences, group values on rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import aggs
from keyloom.frame import KeyedFrame, quoted
from keyloom.session import checkpointed, fresh, partitions


def _window(t: KeyedFrame, by: Any, order: Any, reverse: bool):
    keys = t.names(by) if by is not None else list(t.keys)
    return Window.partitionBy(*[quoted(k) for k in keys]).orderBy(*t.order(order, reverse))


def rank(t: KeyedFrame, order: Any, by: Any = None, reverse: bool = False, name: str = "rank") -> KeyedFrame:
    """Ordinal rank in the group (1, 2, ...); give ``order`` a last column that breaks ties."""
    return t.like(t.df.withColumn(name, F.row_number().over(_window(t, by, order, reverse))))


def topk(t: KeyedFrame, k: int, order: Any, by: Any = None, reverse: bool = True) -> KeyedFrame:
    """The first k rows of each group; tasks cut their own part of a group before the shuffle."""
    ranked = rank(t, order, by, reverse, "__rank")
    return t.like(ranked.df.where(F.col("__rank") <= k).drop("__rank"))


def lagdiff(t: KeyedFrame, column: Any, order: Any, by: Any = None, name: str | None = None) -> KeyedFrame:
    """The difference to the row before in the group; missing in the first.

    Without groups the rows are cut into ranges of the order; each range takes the last value of the range before
    it (one row for each range is carried), so no task sees all rows.
    """
    c = t.names(column)[0]
    out = name or f"{c}_diff"
    if by is not None and t.names(by):
        return t.like(t.df.withColumn(out, quoted(c) - F.lag(quoted(c)).over(_window(t, by, order, False))))
    part, rank, last = fresh("part"), fresh("rank"), fresh("last")
    df = checkpointed(t.df.repartitionByRange(partitions(t.df), *t.order(order)).withColumn(part, F.spark_partition_id()))
    w = Window.partitionBy(part).orderBy(*t.order(order))
    ranked = df.withColumn(rank, F.row_number().over(w)).withColumn(last, F.lead(F.lit(1)).over(w).isNull())
    ends = {r[0]: r[1] for r in ranked.where(last).select(part, quoted(c)).collect()}  # one row a range
    carried = dict(zip(sorted(ends)[1:], [ends[p] for p in sorted(ends)]))
    value = F.lit(None).cast(t.schema[c].dataType)
    if carried:
        rows = t.df.sparkSession.createDataFrame(list(carried.items()), T.StructType([T.StructField(fresh("p"), T.IntegerType()), T.StructField("__end", t.schema[c].dataType)]))
        ranked = ranked.join(F.broadcast(rows), F.col(part) == F.col(rows.columns[0]), "left")
        value = F.col("__end")
    before = F.when(F.col(rank) == 1, value).otherwise(F.lag(quoted(c)).over(w))
    return t.like(ranked.select(*[quoted(x) for x in t.columns], (quoted(c) - before).alias(out)))


def groupvalue(t: KeyedFrame, column: Any, stat: Any = "mean", by: Any = None, name: str | None = None) -> KeyedFrame:
    """A statistic of the group on each of its rows.

    The statistic is aggregated (combined on the map side) and joined back, so that no group passes through
    one task as it would in a window.
    """
    keys = t.names(by) if by is not None else list(t.keys)
    ((n, c),) = t.exprs(column)
    s = aggs.stat(stat)
    out = name or f"{n}_{s.name}"
    by_ = [quoted(k) for k in keys] or [F.lit(0)]
    groups = t.df.groupBy(*[c.alias(f"__g{i}") for i, c in enumerate(by_)]).agg(s(c).alias(out))
    rows, same = t.df.withColumns({f"__k{i}": c for i, c in enumerate(by_)}), F.lit(True)
    for i in range(len(by_)):
        same = same & F.col(f"__k{i}").eqNullSafe(F.col(f"__g{i}"))
    joined = rows.join(groups if keys else F.broadcast(groups), same, "left")  # without a key there is one row
    return t.like(joined.select(*[quoted(x) for x in t.columns], quoted(out)))
