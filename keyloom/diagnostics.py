"""Timing of what runs inside a block, from Spark's own counters."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_RUNS: list[dict] = []
_OPEN: dict[str, float] = {}


def tracktime(f: Callable[[], Any], name: str = "block") -> tuple[pd.DataFrame, Any]:
    """Run ``f`` and return (timings, result): jobs, stages, tasks and seconds."""
    start_tracking_time(name)
    result = f()
    if isinstance(result, DataFrame):
        result.write.format("noop").mode("overwrite").save()
    stop_tracking_time(name)
    return fetch_timings(), result


def start_tracking_time(name: str = "block") -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext.setJobGroup(f"keyloom:{name}", name)
    _OPEN[name] = time.perf_counter()


def stop_tracking_time(name: str = "block") -> None:
    if name not in _OPEN:
        raise ValueError(f"{name!r} is not being timed")
    row = {"name": name, "seconds": time.perf_counter() - _OPEN.pop(name), "jobs": 0, "stages": 0, "tasks": 0}
    spark = SparkSession.getActiveSession()
    if spark is not None:
        tracker = spark.sparkContext.statusTracker()
        for job in tracker.getJobIdsForGroup(f"keyloom:{name}"):
            info = tracker.getJobInfo(job)
            row["jobs"] += 1
            for stage in info.stageIds if info else ():
                row["stages"] += 1
                got = tracker.getStageInfo(stage)
                row["tasks"] += got.numTasks if got else 0
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    _RUNS.append(row)


def fetch_timings(clear: bool = True) -> pd.DataFrame:
    out = pd.DataFrame(list(_RUNS), columns=["name", "seconds", "jobs", "stages", "tasks"])
    if clear:
        _RUNS.clear()
    return out


def approx_size(df: DataFrame) -> int:
    """Catalyst's estimate of the size in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def time_table(runs: pd.DataFrame | None = None) -> pd.DataFrame:
    """Totals by name over timed runs (those not fetched yet by default): calls, seconds, their mean, jobs, stages, tasks."""
    runs = fetch_timings(clear=False) if runs is None else runs
    table = runs.groupby("name", sort=True).agg(calls=("seconds", "size"), seconds=("seconds", "sum"), mean=("seconds", "mean"), jobs=("jobs", "sum"), stages=("stages", "sum"), tasks=("tasks", "sum"))
    return table.reset_index().sort_values(["seconds", "name"], ascending=[False, True], ignore_index=True)


def show_timings(runs: pd.DataFrame | None = None, most: int | None = None) -> str:
    """The table as text, the slowest first."""
    table = time_table(runs)
    return (table if most is None else table.head(most)).to_string(index=False)
