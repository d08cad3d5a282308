"""Filling containers of fixed capacity.

Bulk-synchronous best fit.  Items and gaps lie in two sorted sequences.  A superstep is one successor
sweep from the largest size down: a gap becomes available as soon as the sweep reaches its room, and each item
takes its successor, the smallest gap it fits into that no item of higher rank (larger, then
first) has taken in this sweep.  The smallest available gap is the one reached last, so the sweep matches items
and gaps like brackets.  A gap takes one item a superstep; then all gaps are updated at once and what was
not placed sweeps again, so there are about as many supersteps as items in a container.  Items larger than
every gap open new containers.

Sizes are whole numbers of at most ``capacity``, so both sequences are runs of equal values: at
most ``capacity`` runs of items and as many of gaps, however many documents there are.  The
documents are range-sorted by (size, id) by Spark, and prefix counts of the partitions give each
its rank within its run; the sweeps match whole runs at a time, on the run lengths (a table
bounded by the capacity, which is all that reaches the driver); the resulting plan, intervals of
ranks to intervals of containers, is joined back to the documents in one pass.  The outcome is that
of the same sweeps on single documents, since equal items are told apart by rank only.

Defined results: items of size 0 or null need no container and are left out; an item larger than
the capacity is split into full pieces, each a container of its own, and a last piece that is
packed like any item; no other item is split.  Ids need not be unique.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import checkpointed


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Supersteps over runs.

    ``counts``: how many items there are of each size.  Returns rows
    ``size, first rank, number of items, first container, start in the container`` and the number
    of containers.
    """
    waiting = {s: [0, n] for s, n in counts.items() if n}  # next rank, left
    gaps: dict[int, list[list[int]]] = {}  # room -> intervals [first container, count]
    total = sum(s * n for s, n in counts.items())
    opened = -(-total // capacity) if total else 0
    if opened:
        gaps[capacity] = [[0, opened]]
    out: list[tuple[int, int, int, int, int]] = []
    while waiting:
        rooms = sorted(gaps, reverse=True)
        reached, available = 0, []
        updates: list[tuple[int, int, int]] = []
        for size in sorted(waiting, reverse=True):
            while reached < len(rooms) and rooms[reached] >= size:
                available.append(rooms[reached])
                reached += 1
            rank, left = waiting[size]
            while left and available:
                room = available[-1]
                interval = gaps[room][-1]
                n = min(interval[1], left)
                first = interval[0] + interval[1] - n
                out.append((size, rank, n, first, capacity - room))
                rank, left = rank + n, left - n
                interval[1] -= n
                if not interval[1]:
                    gaps[room].pop()
                    if not gaps[room]:
                        del gaps[room]
                        available.pop()
                if room > size:
                    updates.append((room - size, first, n))
            if left:
                waiting[size] = [rank, left]
            else:
                del waiting[size]
        for room, first, n in updates:
            gaps.setdefault(room, []).append([first, n])
        largest = max(gaps, default=0)
        stuck = sum(size * left for size, (_, left) in waiting.items() if size > largest)
        if stuck:
            more = -(-stuck // capacity)
            gaps.setdefault(capacity, []).append([opened, more])
            opened += more
    return np.array(out, np.int64).reshape(-1, 5), opened


def pieces_of(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``<key>, piece, size``: whole items, or full pieces and a rest."""
    full = F.floor(F.col(size) / F.lit(capacity)).cast("int")
    rest = (F.col(size) % F.lit(capacity)).cast("int")
    lengths = F.concat(F.array_repeat(F.lit(capacity), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    return sizes.where(F.col(size) > 0).select(key, F.posexplode(lengths).alias("piece", "size"))


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``<key>, piece, size, container, start`` of every item; ``start`` is its place in the container."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    kind = sizes.schema[key].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("size").desc(), F.col(key), F.col("piece")]
    # ordering reads its input twice (once to find the ranges), so sizes are worked out before
    sizes = checkpointed(sizes.select(key, size))
    items = pieces_of(sizes, key, size, capacity).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = checkpointed(items.withColumn("part", F.spark_partition_id()))
    # at most one row for each size, and one more for each partition's edge
    table = sorted((r["part"], -r["size"], r["n"]) for r in ranked.groupBy("part", "size").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = defaultdict(int)
    prefix: dict[tuple[int, int], int] = {}
    for part, negative, n in table:
        prefix[part, -negative] = counts[-negative]
        counts[-negative] += n
    steps, _ = plan(dict(counts), capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    sent = spark.sparkContext.broadcast((steps, prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, prefix = sent.value
        code = steps[:, 0] * (1 << 40) + steps[:, 1]
        seen: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            size, part = batch.column("size").to_numpy().astype(np.int64), int(batch.column("part")[0].as_py())
            heads = np.flatnonzero(np.r_[True, np.diff(size) != 0])
            rank = np.arange(len(size)) - np.repeat(heads, np.diff(np.r_[heads, len(size)]))
            for a, b in zip(heads, np.r_[heads[1:], len(size)]):
                s = int(size[a])
                rank[a:b] += prefix[part, s] + seen.get(s, 0)
                seen = {s: seen.get(s, 0) + int(b - a)}
            at = np.searchsorted(code, size * (1 << 40) + rank, side="right") - 1
            container = steps[at, 3] + rank - steps[at, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("piece"), batch.column("size"), pa.array(container), pa.array(steps[at, 4].astype(np.int32))],
                [key, "piece", "size", "container", "start"],
            )

    return ranked.mapInArrow(run, f"{key} {kind}, piece int, size int, container bigint, start int")
