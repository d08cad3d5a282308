"""Saved frames: parquet with the key in a side file, in one directory."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from keyloom.frame import KeyedFrame
from keyloom.session import partitions

SIDECAR = "_keys"


def save(t: KeyedFrame, path: str, append: bool = False, single: bool = False) -> KeyedFrame:
    """Write a frame and return it reloaded.

    Rows are range-partitioned and sorted by key, so that lookups by key skip files and row groups
    by their statistics.  ``append`` adds to what is there (same key and columns).  ``single`` writes one file.
    """
    spark = t.df.sparkSession
    if append and exists(spark, path):
        old = load(path, spark)
        if old.keys != t.keys or old.kind != t.kind:
            raise ValueError(f"the saved frame has the key {old.keys}, this one {t.keys}")
        if old.df.dtypes != t.df.dtypes:
            raise ValueError(f"the saved frame has the columns {old.df.dtypes}, this one {t.df.dtypes}")
    df = t.df
    if single:
        df = df.coalesce(1)
        df = df.sortWithinPartitions(*t.order()) if t.keys else df
    elif t.keys:
        parts = partitions(df)
        df = df.repartitionByRange(parts, *t.order()).sortWithinPartitions(*t.order())
    df.write.mode("append" if append else "overwrite").parquet(path)
    meta = json.dumps({"keys": list(t.keys), "kind": t.kind})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{SIDECAR}")
    return load(path, spark)


def load(path: str, spark: SparkSession | None = None, merge_schema: bool = False, **ignored: Any) -> KeyedFrame:
    """A saved frame, or any parquet directory (without a key).

    Saved frames have one schema; ``merge_schema`` reads the footer of every file for directories that do not.
    """
    spark = spark or SparkSession.getActiveSession()
    df = spark.read.option("mergeSchema", merge_schema).option("pathGlobFilter", "*.parquet").parquet(path)
    if not exists(spark, f"{path}/{SIDECAR}"):
        return KeyedFrame(df)
    meta = json.loads(_sidecar(spark, f"{path}/{SIDECAR}"))
    return KeyedFrame(df, meta["keys"], meta["kind"])


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def _sidecar(spark: SparkSession, path: str) -> str:
    """Names that start with an underscore are hidden from Spark's readers, so the file is read by Hadoop."""
    fs, hadoop = _fs(spark, path)
    part = next(s.getPath() for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("part-"))
    stream = fs.open(part)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def from_jdbc(url: str, query: str, spark: SparkSession | None = None, **options: str) -> DataFrame:
    """Rows of a database, where its driver is on the class path; partition options pass through."""
    spark = spark or SparkSession.getActiveSession()
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
