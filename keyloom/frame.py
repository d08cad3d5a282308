"""Keyed frames: a Spark DataFrame with the names of its key columns.

Two kinds exist.  A *table* may have a key and keeps duplicates; an *array* (sparse,
N-dimensional) has its dimensions as keys and its cells as values.  Frames are immutable; every
operator returns a new frame or a DataFrame.  Most run nothing; those that must look at the data to plan
run small jobs (row numbers, ``partitioned``, ``unstack`` without names, ``load_table``, guarded broadcasts,
carried ends).  Order by key is a property of presentation: only ``collect``, ``take``, ``show`` and ``partition`` sort.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import selectors as S
from keyloom.session import fresh

TABLE, ARRAY = "table", "array"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class KeyedFrame:
    """A DataFrame, its key columns and its kind."""

    def __init__(self, df: DataFrame, keys: Iterable[Any] = (), kind: str = TABLE):
        self.df = df
        self.keys = tuple(S.names(df.schema, (), list(keys) if not isinstance(keys, str) else [keys]))
        self.kind = kind
        if kind == ARRAY and not self.keys:
            raise ValueError("an array needs at least one dimension")

    # -- metadata ---------------------------------------------------------------------------

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    colnames = columns

    @property
    def values(self) -> list[str]:
        """Names of the columns that are no keys."""
        return [c for c in self.df.columns if c not in self.keys]

    pkeynames = property(lambda self: self.keys)
    dimlabels = property(lambda self: self.keys)
    valuenames = values

    @property
    def ndims(self) -> int:
        return len(self.keys)

    def eltype(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def keytype(self) -> dict[str, str]:
        return {k: v for k, v in self.df.dtypes if k in self.keys}

    def __len__(self) -> int:
        return self.df.count()

    def __repr__(self) -> str:
        marks = ", ".join(f"{n}*" if n in self.keys else n for n in self.df.columns)
        return f"{self.kind}({marks})"

    # -- helpers ----------------------------------------------------------------------------

    def like(self, df: DataFrame, keys: Iterable[str] | None = None, kind: str | None = None) -> KeyedFrame:
        return KeyedFrame(df, self.keys if keys is None else keys, kind or (self.kind if (self.keys if keys is None else keys) else TABLE))

    def names(self, sel: Any) -> list[str]:
        return S.names(self.schema, self.keys, sel)

    def exprs(self, sel: Any) -> list[tuple[str, Column]]:
        return S.columns_of(self.schema, self.keys, sel)

    def order(self, by: Any = None, reverse: bool = False) -> list[Column]:
        """Missing values sort last, or first when reversed."""
        by = self.keys if by is None else self.names(by)
        return [quoted(c).desc_nulls_first() if reverse else quoted(c).asc_nulls_last() for c in by]

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.order()) if self.keys else self.df

    # -- materialisation ----------------------------------------------------------------------

    def compute(self) -> KeyedFrame:
        """Run pending work once and keep the result on the executors (memory, then disk)."""
        kept = self.df.persist()
        kept.count()
        return self.like(kept)

    def collect(self) -> list:
        return self.ordered().collect()

    def to_pandas(self) -> pd.DataFrame:
        return self.ordered().toPandas()

    def take(self, n: int) -> list:
        return self.ordered().limit(n).collect()

    def show(self, n: int = 20) -> str:
        """Heading and first rows as text."""
        heading = f"{self.kind} with {self.df.count()} rows, {len(self.columns)} columns, {self.df.rdd.getNumPartitions()} partitions"
        return heading + "\n" + self.ordered().limit(n).toPandas().to_string(index=False)

    def partition(self, n: int) -> Iterator[list]:
        """Pieces of n rows in key order; one partition at a time reaches the caller."""
        if n < 1:
            raise ValueError("pieces have at least one row")
        piece: list = []
        for row in self.ordered().toLocalIterator(prefetchPartitions=True):
            piece.append(row)
            if len(piece) == n:
                yield piece
                piece = []
        if piece:
            yield piece

    def copy(self) -> KeyedFrame:
        return self.like(self.df)

    # -- rows with numbers ----------------------------------------------------------------------

    def with_row_number(self, name: str = "row", start: int = 1) -> DataFrame:
        """A dense row number in key order (input order without keys), without a single-task window.

        Partition sizes are counted, and each partition numbers its own rows from its offset.
        """
        from keyloom.session import checkpointed, partitions

        df = self.df
        if self.keys:
            parts = partitions(df)
            order = self.order()
            df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        part, place = fresh("part"), fresh("place")
        df = checkpointed(df.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id() % (1 << 33)))
        sizes = sorted((r[0], r[1]) for r in df.groupBy(part).count().collect())  # one row a partition
        offsets, total = {}, start
        for p, n in sizes:
            offsets[p] = total
            total += n
        if not offsets:
            return df.withColumn(name, F.lit(0).cast("bigint")).drop(part, place)
        lookup = df.sparkSession.createDataFrame(list(offsets.items()), f"{part} int, {name} bigint")
        return df.join(F.broadcast(lookup), part).withColumn(name, F.col(name) + F.col(place)).drop(part, place)

    # -- operators (methods are attached by keyloom.operators) ---------------------------------


def table(data: Any, keys: Iterable[Any] = (), names: Iterable[str] | None = None, spark: SparkSession | None = None) -> KeyedFrame:
    """A table from a DataFrame, a frame, pandas, a dict of columns, or rows.

    Columns without names are called ``_1, _2, ...``.
    """
    return KeyedFrame(_frame(data, names, spark), keys, TABLE)


def array(keys: Any, values: Any = None, agg: Any = None, names: Iterable[str] | None = None, spark: SparkSession | None = None) -> KeyedFrame:
    """A sparse array.

    Either ``array(df, ["i", "j"])``, where the names are the dimensions, or dicts of key columns and value
    columns.  ``agg`` combines cells with the same key.
    """
    if isinstance(keys, dict):
        cells = values if isinstance(values, dict) else {f"_{len(keys) + 1}": values}
        out = KeyedFrame(_frame({**keys, **cells}, names, spark), list(keys), ARRAY)
    else:
        out = KeyedFrame(_frame(keys, names, spark), values, ARRAY)
    if agg is not None:
        from keyloom.operators.group import groupreduce

        out = KeyedFrame(groupreduce(out, [(v, v, agg) for v in out.values], list(out.keys), named=True).df, out.keys, ARRAY)
    return out


def _frame(data: Any, names: Iterable[str] | None, spark: SparkSession | None) -> DataFrame:
    if isinstance(data, KeyedFrame):
        return data.df
    if isinstance(data, DataFrame):
        return data.toDF(*names) if names else data
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("there is no active session")
    if isinstance(data, dict):
        sizes = {len(v) for v in data.values()}
        if len(sizes) > 1:
            raise ValueError(f"columns differ in length: {sorted(sizes)}")
        rows = list(zip(*data.values()))
        return spark.createDataFrame(rows, list(data)) if rows else spark.createDataFrame([], ", ".join(f"`{n}` string" for n in data))
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    rows = [tuple(r) if isinstance(r, (list, tuple)) else r for r in data]
    if names is None and rows and isinstance(rows[0], tuple) and not hasattr(rows[0], "_fields") and not hasattr(rows[0], "__fields__"):
        names = [f"_{i}" for i in range(1, len(rows[0]) + 1)]
    return spark.createDataFrame(rows, list(names) if names else None)
