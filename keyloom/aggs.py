"""Reducers and statistics: names and functions mapped to built-in aggregates.

All are partial/final aggregates of Spark (they combine on the map side) except ``identity`` and
``union``, which return the group itself.  Missing values are skipped; with ``skipmissing=False``
a group with a missing value has a missing result.
"""

from __future__ import annotations

import builtins
import operator
import statistics
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stat:
    """A named aggregate of one column."""

    name: str
    build: Callable[[Column], Column]
    whole: bool = False  # counts rows whatever the column holds

    def __call__(self, column: Column, skipmissing: bool = True) -> Column:
        out = self.build(column)
        if skipmissing or self.whole:
            return out
        return F.when(F.count_if(column.isNull()) > 0, F.lit(None)).otherwise(out)


@dataclass(frozen=True)
class Several:
    """Several statistics as the fields of one struct."""

    stats: tuple[Stat, ...]
    name: str = "series"
    whole = False

    def __call__(self, column: Column, skipmissing: bool = True) -> Column:
        return F.struct(*[s(column, skipmissing).alias(s.name) for s in self.stats])


def _distinct(count_missing: bool) -> Callable[[Column], Column]:
    if count_missing:
        return lambda c: F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0))
    return F.count_distinct


SUM = Stat("sum", F.sum)
PROD = Stat("prod", F.product)
MIN, MAX = Stat("min", F.min), Stat("max", F.max)
MINIMUM, MAXIMUM = Stat("minimum", F.min), Stat("maximum", F.max)
MEAN = Stat("mean", F.avg)
VAR, STD = Stat("var", F.var_samp), Stat("std", F.stddev_samp)
MEDIAN = Stat("median", F.median)
LENGTH = Stat("length", lambda c: F.count("*"), whole=True)
COUNT = Stat("count", F.count)
IDENTITY = Stat("identity", lambda c: F.sort_array(F.collect_list(c)))
UNION = Stat("union", lambda c: F.sort_array(F.collect_set(c)))
DISTINCT = Stat("distinct", F.count_distinct)
EXTREMA = Stat("extrema", lambda c: F.struct(F.min(c).alias("min"), F.max(c).alias("max")))
FIRST = Stat("first", F.first)
APPROX_DISTINCT = Stat("approx_distinct", F.approx_count_distinct)

NAMED = {s.name: s for s in (SUM, PROD, MIN, MAX, MINIMUM, MAXIMUM, MEAN, VAR, STD, MEDIAN, LENGTH, COUNT, IDENTITY, UNION, DISTINCT, EXTREMA, FIRST, APPROX_DISTINCT)}
NAMED |= {"+": Stat("+", F.sum), "*": Stat("*", F.product), "avg": Stat("avg", F.avg), "variance": Stat("variance", F.var_samp)}
FUNCTIONS: dict[Any, Stat] = {
    operator.add: NAMED["+"],
    operator.mul: NAMED["*"],
    builtins.sum: SUM,
    builtins.min: MIN,
    builtins.max: MAX,
    builtins.len: LENGTH,
    builtins.set: UNION,
    builtins.list: IDENTITY,
    statistics.mean: MEAN,
    statistics.median: MEDIAN,
    statistics.stdev: STD,
    statistics.variance: VAR,
}


def distinct(count_missing: bool = False) -> Stat:
    """How many distinct values there are; ``count_missing`` counts missing as one more."""
    return Stat("distinct", _distinct(count_missing))


def quantile(q: float) -> Stat:
    """Linear interpolated quantile (exact)."""
    return Stat(f"q{q:g}", lambda c: F.percentile(c, F.lit(float(q))))


def quantiles(qs: Sequence[float]) -> Several:
    return Several(tuple(Stat(f"q{q:g}", lambda c, q=q: F.percentile(c, F.lit(float(q)))) for q in qs), "quantiles")


def series(*stats: Any) -> Several:
    """Several statistics of the same column."""
    return Several(tuple(stat(s) for s in stats))


def hist(edges: Sequence[float]) -> Stat:
    """Counts between consecutive edges (left included; the last bin includes its right edge)."""
    edges = list(edges)
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must increase")

    def build(c: Column) -> Column:
        bins = []
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            upper = c <= b if i == len(edges) - 2 else c < b
            bins.append(F.count_if((c >= a) & upper))
        return F.array(*bins)

    return Stat("hist", build)


def adaptive_hist(bins: int) -> Stat:
    """An adaptive histogram of at most ``bins`` bins (approximate; NaN is left out)."""
    return Stat("khist", lambda c: F.histogram_numeric(F.when(~F.isnan(c.cast("double")), c.cast("double")), F.lit(bins)))


def filtered(f: Any, keep: Callable[[Column], Column]) -> Stat:
    """A statistic of the values that satisfy a condition."""
    inner = stat(f)
    return Stat(inner.name, lambda c: inner(F.when(keep(c), c)) if not inner.whole else F.count_if(keep(c)))


def regression(x: str) -> Stat:
    """Slope and intercept of the column on ``x``."""
    return Stat("linreg", lambda c: F.struct(F.regr_slope(c, F.col(x)).alias("slope"), F.regr_intercept(c, F.col(x)).alias("intercept")))


def stat(f: Any) -> Any:
    """A name, a known function, a statistic, or a function from a Column to an aggregate."""
    if isinstance(f, (Stat, Several)):
        return f
    if isinstance(f, str):
        if f not in NAMED:
            raise KeyError(f"no statistic {f!r}; there are {sorted(NAMED)}")
        return NAMED[f]
    try:
        if f in FUNCTIONS:
            return FUNCTIONS[f]
    except TypeError:
        pass
    if callable(f):
        name = getattr(f, "__name__", "f").strip("<>")
        return Stat(name, f)
    raise TypeError(f"{f!r} is no statistic")
