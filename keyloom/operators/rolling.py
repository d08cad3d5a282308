"""Rolling totals over trailing calendar periods.

Entities by days are packed into dense numpy blocks: a block holds the entities of one hash
bucket over one tile of days, with a halo of the days before the tile.  Multiplying a block by a
banded 0/1 matrix sums every trailing period at once; days without rows are zeros of the block.
Rows are reduced to one total for each entity and day first (partial sums before the shuffle), so
an entity holds at most one row a day whatever its share of the input, and no block is larger
than 4096 entities by ``tile + halo`` days.

Exactness: totals are kept as decimal(38,0) and multiplied as limbs of 2^31, so every product is
a whole number below 2^53 and no float rounding happens.

Defined results: rows with a null entity or day are left out; a null or negative amount counts as
0; every entity has a row for each day from its first to its last; days before the first count as
0, and averages divide by the length of the period.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import guarded_broadcast

LIMB = 1 << 31
MARK = -(1 << 31)  # stands for a null day in a block
ENTITIES = 4096  # entities multiplied at once
HELD = 400_000  # rows of a bucket and tile held at once
TICKER = r"^[A-Z]{3,5}(\.[A-Z])?\z"


def last_delivery(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Of rows with the same feed, ticker and date the last by ``written_at``, then by ``row_id``.

    ``feed, ticker, date, volume``.  A row whose file is not in the catalog counts as the earliest.
    Copies are reduced on the map side already.
    """
    written = guarded_broadcast(catalog.select("file_id", F.unix_micros(F.col("written_at").cast("timestamp")).alias("at")))
    kept = rows.where(F.col("date").isNotNull() & F.col("ticker").rlike(TICKER)).select("file_id", "feed", "ticker", "date", "row_id", "volume")
    dated = kept.join(written, "file_id", "left").withColumn("at", F.coalesce("at", F.lit(-(1 << 62))))
    return dated.groupBy("feed", "ticker", "date").agg(
        F.max(F.struct("at", "row_id", "volume")).getField("volume").alias("volume")
    )


def daily_totals(rows: DataFrame, entity: str, day: str, amount: str) -> DataFrame:
    """``entity, day_no, total``: one row for each entity and day."""
    value = F.when(F.col(amount) > 0, F.col(amount)).otherwise(F.lit(0))
    return (
        rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.unix_date(F.col(day)).alias("day_no"))
        .agg(F.sum(value.cast("decimal(19,0)")).cast("decimal(38,0)").alias("total"))
    )


def band(tile: int, halo: int, period: int) -> np.ndarray:
    """The banded operator: column j sums the ``period`` days that end with day j of the tile."""
    rows, columns = np.arange(halo + tile)[:, None], np.arange(tile)[None, :] + halo
    return ((rows <= columns) & (rows > columns - period)).astype(np.float64)


def trailing_totals(
    rows: DataFrame,
    entity: str,
    day: str,
    amount: str,
    periods: tuple[int, ...] = (7, 30),
    tile: int = 128,
    buckets: int | None = None,
    quiet_only: bool = False,
) -> DataFrame:
    """``<entity>, <day>``, and ``total_<p>, avg_<p>`` for each period, for every calendar day.

    ``quiet_only`` returns only days with nothing in the shortest and something in the longest
    period; the filter runs inside the block, so the dense rows never leave it.
    """
    if not periods or min(periods) < 1:
        raise ValueError("periods must be at least one day")
    periods = tuple(sorted(set(periods)))
    halo = max(periods) - 1
    spark = rows.sparkSession
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    totals = daily_totals(rows, entity, day, amount)
    span = totals.groupBy("entity").agg(F.min("day_no").alias("first_day"), F.max("day_no").alias("last_day"))
    tile_of = lambda c: F.floor(c / F.lit(tile)).cast("int")
    limbs = [
        F.floor(F.col("total") / F.lit(LIMB * LIMB)).cast("double").alias("high"),
        F.floor((F.col("total") % F.lit(LIMB * LIMB)) / F.lit(LIMB)).cast("double").alias("mid"),
        (F.col("total") % F.lit(LIMB)).cast("double").alias("low"),
    ]
    # a total goes to its own tile and, within the halo, to the tile after it
    touched = F.array_distinct(F.array(tile_of(F.col("day_no")), tile_of(F.col("day_no") + halo)))
    if halo > tile:
        touched = F.sequence(tile_of(F.col("day_no")), tile_of(F.col("day_no") + halo))
    cells = totals.select("entity", "day_no", F.explode(touched).alias("tile"), *limbs)
    tiles = span.select(
        "entity", F.explode(F.sequence(tile_of(F.col("first_day")), tile_of(F.col("last_day")))).alias("tile"), "first_day", "last_day"
    )
    # the span goes along as rows without a day, so that tiles without totals exist as well
    frame = cells.select("entity", "tile", "day_no", "high", "mid", "low", F.lit(None).cast("int").alias("first_day"), F.lit(None).cast("int").alias("last_day"))
    marks = tiles.select("entity", "tile", F.lit(None).cast("int").alias("day_no"), F.lit(0.0).alias("high"), F.lit(0.0).alias("mid"), F.lit(0.0).alias("low"), "first_day", "last_day")
    blocks = frame.unionByName(marks).withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int"))

    names = [f"total_{p}" for p in periods] + [f"avg_{p}" for p in periods]
    schema = "entity string, day_no int, " + ", ".join(f"{n} decimal(38,0)" for n in names[: len(periods)]) + ", " + ", ".join(f"{n} double" for n in names[len(periods) :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = [band(tile, halo, p) for p in periods]

        def solve(part: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            every, index = np.unique(part["entity"], return_inverse=True)
            order = np.argsort(index, kind="stable")
            cuts = np.searchsorted(index[order], np.arange(0, len(every) + ENTITIES, ENTITIES))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    own = order[a:b]
                    block = {n: c[own] for n, c in part.items()}
                    yield from dense_block(block, every[k * ENTITIES : (k + 1) * ENTITIES], index[own] - k * ENTITIES)

        def dense_block(part: dict[str, np.ndarray], names_: np.ndarray, index: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = int(part["tile"][0]) * tile
            first, last = np.full(len(names_), 1 << 40), np.full(len(names_), -(1 << 40))
            mark = part["day_no"] == MARK
            first[index[mark]], last[index[mark]] = part["first_day"][mark], part["last_day"][mark]
            own, column = index[~mark], part["day_no"][~mark] - start + halo
            days = np.arange(start, start + tile)
            sums: list[list[np.ndarray]] = []
            for limb in ("high", "mid", "low"):
                values = part[limb][~mark]
                dense = np.zeros((len(names_), halo + tile))
                if values.any():
                    dense[own, column] = values
                    sums.append([dense @ b for b in bands])
                else:
                    sums.append([np.zeros((len(names_), tile)) for _ in bands])
            keep = (days[None, :] >= first[:, None]) & (days[None, :] <= last[:, None])
            if quiet_only:
                short = sums[0][0] + sums[1][0] + sums[2][0]
                long = sums[0][-1] + sums[1][-1] + sums[2][-1]
                keep &= (short == 0) & (long > 0)
            row, col = np.nonzero(keep)
            if not len(row):
                return
            arrays = [pa.array(names_[row], pa.string()), pa.array(days[col], pa.int32())]
            averages = []
            for k, p in enumerate(periods):
                high, mid, low = (s[k][row, col] for s in sums)
                if high.any() or mid.max(initial=0) >= LIMB:
                    exact = [(int(h) * LIMB + int(m)) * LIMB + int(lo) for h, m, lo in zip(high, mid, low)]
                    arrays.append(pa.array([Decimal(x) for x in exact], pa.decimal128(38, 0)))
                    averages.append(pa.array([x / p for x in exact], pa.float64()))
                else:
                    exact = mid.astype(np.int64) * LIMB + low.astype(np.int64)
                    arrays.append(pa.array(exact, pa.int64()).cast(pa.decimal128(38, 0)))
                    averages.append(pa.array(exact / p, pa.float64()))
            yield pa.RecordBatch.from_arrays([*arrays, *averages], ["entity", "day_no", *names])

        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            part = {n: batch.column(n) for n in batch.schema.names}
            part = {
                n: np.asarray(c.fill_null(MARK) if n in ("day_no", "first_day", "last_day") else c.to_pylist() if n == "entity" else c)
                for n, c in part.items()
            }
            if not len(part["tile"]):
                continue
            part["entity"] = part["entity"].astype(object)
            key = part["bucket"].astype(np.int64) * (1 << 32) + part["tile"]
            cuts = np.flatnonzero(np.diff(key)) + 1
            pieces = [{n: c[a:b] for n, c in part.items()} for a, b in zip([0, *cuts], [*cuts, len(key)])]
            for piece in pieces:
                if held and (held[0]["tile"][0], held[0]["bucket"][0]) != (piece["tile"][0], piece["bucket"][0]):
                    yield from solve({n: np.concatenate([h[n] for h in held]) for n in piece})
                    held = []
                held.append(piece)
                if sum(len(h["tile"]) for h in held) >= HELD:
                    # rows come entity by entity: all but the last entity are complete
                    whole = {n: np.concatenate([h[n] for h in held]) for n in piece}
                    cut = int(np.flatnonzero(whole["entity"] != whole["entity"][-1])[-1] + 1) if (whole["entity"] != whole["entity"][-1]).any() else 0
                    if cut:
                        yield from solve({n: c[:cut] for n, c in whole.items()})
                    held = [{n: c[cut:] for n, c in whole.items()}]
        if held:
            yield from solve({n: np.concatenate([h[n] for h in held]) for n in held[0]})

    packed = blocks.repartition(F.col("bucket"), F.col("tile")).sortWithinPartitions("bucket", "tile", "entity")
    done = packed.mapInArrow(run, schema)
    return done.select(F.col("entity").alias(entity), F.date_from_unix_date(F.col("day_no")).alias(day), *names)


