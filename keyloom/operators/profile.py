"""Column-level profile of loads, and what sets a load apart from the one before.

Values are unpivoted to (column, value) and reduced to one counted row for each load, column and
value (partial counts before the shuffle, so a value that fills a third of the input is one row a
load).  These rows are range-sorted by (feed, column, value): all loads of a feed lie merged in
one ascending sequence, which range partitioning cuts anywhere.  One sweep over each partition
keeps, for every pair of consecutive loads, how far their cumulative curves drift apart within
the partition; counts before the partition (prefix counts) only shift that drift by a constant,
so the extremes of each piece and its counts are all that must be kept, and putting the pieces
together gives the exact Kolmogorov-Smirnov distance.  The same prefix counts give exact distinct
counts and quantiles.  Equal values never lie in two partitions.

Defined results: numbers compare as doubles; NaN is one distinct value, and neither NaN nor
infinities are part of curves, minima, maxima or quantiles; a load without finite values has no
curve and no distance; a load absent from the catalog has no load before; the catalog's loads
without rows have counts of 0.  Loads written at the same time follow each other by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.session import checkpointed, guarded_broadcast, partitions, previous_row

STAT, PAIR, RANK = 0, 1, 2
SWEEP = (
    "kind int, feed_no bigint, col int, load bigint, lo double, x double, y double, "
    "n1 bigint, n2 bigint, m1 bigint, m2 bigint"
)
CHUNK = 200_000  # rows swept at once


def _sweep_chunk(c: dict[str, np.ndarray], ranks: bool) -> dict[str, np.ndarray]:
    """The pieces of one ascending run of one feed and column."""
    load, num, cnt = c["load"], c["num"], c["cnt"]
    out: dict[str, list] = {k: [] for k in ("kind", "load", "lo", "x", "y", "n1", "n2", "m1", "m2")}

    def add(kind: int, **values: np.ndarray) -> None:
        size = len(values["load"])
        values["kind"] = np.full(size, kind)
        for k in out:
            out[k].append(np.asarray(values.get(k, np.zeros(size)), np.float64 if k in "loxy" and k != "load" else np.int64))

    finite = np.isfinite(num)
    lo = float(num[finite][0]) if finite.any() else np.nan
    order = np.argsort(load, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(load[order]) != 0])
    ids = load[order][at]
    with np.errstate(invalid="ignore"):
        least = np.minimum.reduceat(np.where(finite, num, np.inf)[order], at)
        most = np.maximum.reduceat(np.where(finite, num, -np.inf)[order], at)
    add(STAT, load=ids, lo=np.full(len(ids), lo), x=least, y=most, n1=np.add.reduceat(cnt[order], at), n2=np.diff(np.r_[at, len(load)]),
        m1=np.add.reduceat(np.where(finite, cnt, 0)[order], at))
    if finite.any():
        c = {k: v[finite] for k, v in c.items()}
        load, num, cnt = c["load"], c["num"], c["cnt"]
        # every row raises the curve of its own pair and lowers that of the load after
        mine, after = (c["n_prev"] > 0), (c["next_id"] >= 0) & (c["n_next"] > 0)
        pair = np.r_[load[mine], c["next_id"][after]]
        own, before = np.r_[cnt[mine], np.zeros(after.sum(), np.int64)], np.r_[np.zeros(mine.sum(), np.int64), cnt[after]]
        m1, m2 = np.r_[c["n"][mine], c["n_next"][after]], np.r_[c["n_prev"][mine], c["n"][after]]
        value = np.r_[num[mine], num[after]]
        if len(pair):
            order = np.lexsort((value, pair))
            pair, own, before, m1, m2, value = (a[order] for a in (pair, own, before, m1, m2, value))
            at = np.flatnonzero(np.r_[True, np.diff(pair) != 0])
            group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(pair)]))
            c1, c2 = np.cumsum(own), np.cumsum(before)
            c1, c2 = c1 - (c1[at] - own[at])[group], c2 - (c2[at] - before[at])[group]
            drift = c1 * m2.astype(np.float64) - c2 * m1.astype(np.float64)
            settled = np.r_[(np.diff(value) != 0) | (np.diff(pair) != 0), True]
            end = np.r_[at[1:], len(pair)] - 1
            add(PAIR, load=pair[at], lo=np.full(len(at), lo),
                x=np.maximum.reduceat(np.where(settled, drift, -np.inf), at), y=np.minimum.reduceat(np.where(settled, drift, np.inf), at),
                n1=c1[end], n2=c2[end], m1=m1[at], m2=m2[at])
        if ranks:
            order = np.argsort(load, kind="stable")
            load, num, cnt, n = load[order], num[order], cnt[order], c["n"][order]
            at = np.flatnonzero(np.r_[True, np.diff(load) != 0])
            upto = np.cumsum(cnt)
            upto = upto - np.repeat(upto[at] - cnt[at], np.diff(np.r_[at, len(load)]))
            add(RANK, load=load, lo=np.full(len(load), lo), x=num, n1=upto - cnt, n2=upto, m1=n)
    return {k: np.concatenate(v) for k, v in out.items()}


def _sweep(ranks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if not held:
                return
            c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            held, size = [], 0
            cuts = np.flatnonzero((np.diff(c["feed_no"]) != 0) | (np.diff(c["col"]) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(c["col"])]):
                part = {k: v[a:b] for k, v in c.items()}
                got = _sweep_chunk(part, ranks)
                rows = len(got["kind"])
                columns = {"kind": got["kind"].astype(np.int32), "feed_no": np.full(rows, part["feed_no"][0]), "col": np.full(rows, part["col"][0], np.int32)}
                columns |= {k: got[k] for k in ("load", "lo", "x", "y", "n1", "n2", "m1", "m2")}
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            c = {n: v.astype(np.float64 if n == "num" else np.int32 if n == "col" else np.int64) for n, v in c.items()}
            # a chunk may end only where the value changes (or the run does)
            if size >= CHUNK:
                changed = np.flatnonzero(
                    np.r_[
                        (c["feed_no"][0] != held[-1]["feed_no"][-1]) | (c["col"][0] != held[-1]["col"][-1]) | ~(c["num"][0] <= held[-1]["num"][-1]),
                        (np.diff(c["feed_no"]) != 0) | (np.diff(c["col"]) != 0) | ~(np.diff(c["num"]) <= 0),
                    ]
                )
                if len(changed):
                    cut = changed[0]
                    if cut:
                        held.append({n: v[:cut] for n, v in c.items()})
                    yield from flush()
                    c = {n: v[cut:] for n, v in c.items()}
            held.append(c)
            size += len(c["col"])
        yield from flush()

    return run


def _loads(rows: DataFrame, catalog: DataFrame, load: str, numeric: Sequence[str], text: Sequence[str], bad: dict[str, Column]) -> DataFrame:
    """One row for each load with its counts, feed, and the counts of the loads before and after."""
    finite = lambda c: F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")))
    aggs = [F.count("*").alias("n_rows")]
    for c in [*numeric, *text]:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"), F.count_if(bad[c] if c in bad else F.lit(False)).alias(f"bad_{c}")]
    aggs += [finite(c).alias(f"n_{c}") for c in numeric]
    counted = checkpointed(rows.groupBy(F.col(load).alias("load")).agg(*aggs))  # one row a load; the rows are read once for it
    known = catalog.select(F.col(load).alias("load"), F.col("feed").alias("feed_"), "written_at").dropDuplicates(["load"])
    every = counted.join(known, "load", "full")
    every = every.withColumn("feed", F.coalesce("feed_", F.concat(F.lit("\u0000"), F.col("load").cast("string"))))
    every = every.fillna(0, [c for c in counted.columns if c != "load"]).drop("feed_")
    carry = ["load", "n_rows", *[f"nulls_{c}" for c in [*numeric, *text]], *[f"n_{c}" for c in numeric]]
    linked = previous_row(every, ["feed"], "written_at", "load", carry)
    after = linked.where(F.col("prev_row").isNotNull()).select(
        F.col("prev_row.load").alias("load"), F.col("load").alias("next_id"), *[F.col(f"n_{c}").alias(f"next_{c}") for c in numeric]
    )
    feeds = linked.groupBy("feed").agg(F.min("load").alias("feed_no"))
    return checkpointed(linked.join(feeds, "feed").join(after, "load", "left"))


def profile_loads(
    rows: DataFrame,
    catalog: DataFrame,
    load: str = "file_id",
    numeric: Sequence[str] = ("open", "volume"),
    text: Sequence[str] = ("ticker",),
    bad: dict[str, Column] | None = None,
    quantiles: Sequence[float] = (),
) -> DataFrame:
    """One row for each load and column.

    ``load, column_name, n_rows, nulls, bad, n_distinct, least, most, q_<p>..., prev_load,
    prev_rows, prev_nulls, prev_distinct, ks``.  ``bad`` maps a column to the condition of a bad
    value; ``ks`` is the distance to the load before of the feed.
    """
    bad = bad or {}
    columns = [*numeric, *text]
    loads = _loads(rows, catalog, load, numeric, text, bad)
    items = [F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("num"), F.lit(None).cast("string").alias("txt")) for i, c in enumerate(numeric)]
    items += [F.struct(F.lit(len(numeric) + i).alias("col"), F.lit(None).cast("double").alias("num"), F.col(c).cast("string").alias("txt")) for i, c in enumerate(text)]
    cells = (
        rows.select(F.col(load).alias("load"), F.explode(F.array(*items)).alias("v"))
        .select("load", "v.col", "v.num", "v.txt")
        .where(F.col("num").isNotNull() | F.col("txt").isNotNull())
        .groupBy("load", "col", "num", "txt")
        .agg(F.count("*").alias("cnt"))
    )
    pick = lambda prefix: F.coalesce(F.array(*[F.coalesce(f"{prefix}{c}", F.lit(0)) for c in numeric], *[F.lit(0)] * len(text))[F.col("col")], F.lit(0)).cast("bigint")
    known = loads.select("load", "feed_no", F.coalesce("next_id", F.lit(-1)).alias("next_id"),
                         *[f"n_{c}" for c in numeric], *[F.coalesce(F.col(f"prev_row.n_{c}"), F.lit(0)).alias(f"prev_{c}") for c in numeric], *[f"next_{c}" for c in numeric])
    placed = cells.join(guarded_broadcast(known), "load").select(
        "feed_no", "col", "num", "txt", "load", "cnt", "next_id", pick("n_").alias("n"), pick("prev_").alias("n_prev"), pick("next_").alias("n_next")
    )
    parts = partitions(rows.select(load, *columns))
    ordered = placed.repartitionByRange(parts, "feed_no", "col", "num", "txt").sortWithinPartitions("feed_no", "col", "num", "txt")
    swept = checkpointed(
        ordered.select("feed_no", "col", F.coalesce("num", F.lit(float("nan"))).alias("num"), "load", "cnt", "next_id", "n", "n_prev", "n_next")
        .mapInArrow(_sweep(bool(quantiles)), SWEEP)
    )

    real = lambda c, unset: F.when(c != unset, c)
    stats = swept.where(F.col("kind") == STAT).groupBy("load", "col").agg(
        F.sum("n2").alias("n_distinct"),
        real(F.min("x"), float("inf")).alias("least"),
        real(F.max("y"), float("-inf")).alias("most"),
    )
    sofar = Window.partitionBy("load", "col").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n1").over(sofar), F.lit(0)) * F.col("m2").cast("double") - F.coalesce(F.sum("n2").over(sofar), F.lit(0)) * F.col("m1").cast("double")
    curves = (
        swept.where(F.col("kind") == PAIR)
        .withColumn("offset", offset)
        .groupBy("load", "col", "m1", "m2")
        .agg(F.max(F.greatest(F.abs(F.col("offset") + F.col("x")), F.abs(F.col("offset") + F.col("y")))).alias("gap"))
        .select("load", "col", (F.col("gap") / (F.col("m1").cast("double") * F.col("m2").cast("double"))).alias("ks"))
    )
    shape = loads.select(
        "load", "n_rows", "prev_row",
        F.explode(F.array(*[F.struct(
            F.lit(i).alias("col"), F.lit(c).alias("column_name"), F.col(f"nulls_{c}").alias("nulls"), F.col(f"bad_{c}").alias("bad"),
            F.col(f"prev_row.nulls_{c}").alias("prev_nulls")) for i, c in enumerate(columns)])).alias("c"),
    ).select("load", "n_rows", "c.*", F.col("prev_row.load").alias("prev_load"), F.col("prev_row.n_rows").alias("prev_rows"))
    full = shape.join(stats, ["load", "col"], "left").join(curves, ["load", "col"], "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    before = full.select(F.col("load").alias("prev_load"), "col", F.col("n_distinct").alias("prev_distinct"))
    full = full.join(before, ["prev_load", "col"], "left")
    names = [f"q_{q:g}" for q in quantiles]
    if quantiles:
        full = full.join(_quantiles(swept, quantiles), ["load", "col"], "left")
    return full.select(
        F.col("load").alias(load), "column_name", "n_rows", "nulls", "bad", "n_distinct", "least", "most", *[F.col(f"`{n}`") for n in names],
        "prev_load", "prev_rows", "prev_nulls", "prev_distinct", "ks",
    )


def _quantiles(swept: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Linear interpolated quantiles from the ranks that prefix counts give to the values."""
    sofar = Window.partitionBy("load", "col").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    starts = swept.where((F.col("kind") == STAT) & ~F.isnan("lo")).select("load", "col", "lo", F.coalesce(F.sum("m1").over(sofar), F.lit(0)).alias("start"))
    ranked = swept.where(F.col("kind") == RANK).join(starts, ["load", "col", "lo"])
    aggs = []
    for q in quantiles:
        rank = F.lit(float(q)) * (F.col("m1") - 1)
        for side, at in (("a", F.floor(rank)), ("b", F.ceil(rank))):
            inside = (F.col("start") + F.col("n1") <= at) & (at < F.col("start") + F.col("n2"))
            aggs.append(F.max(F.when(inside, F.col("x"))).alias(f"{side}_{q:g}"))
        aggs.append(F.max(rank - F.floor(rank)).alias(f"w_{q:g}"))
    got = ranked.groupBy("load", "col").agg(*aggs)
    return got.select("load", "col", *[
        (F.col(f"`a_{q:g}`") + (F.col(f"`b_{q:g}`") - F.col(f"`a_{q:g}`")) * F.col(f"`w_{q:g}`")).alias(f"q_{q:g}") for q in quantiles
    ])


def load_issues(
    profile: DataFrame,
    load: str = "file_id",
    distinct_of: Sequence[str] = ("ticker",),
    shift_of: Sequence[str] = ("open", "volume"),
    pattern_of: Sequence[str] = ("ticker",),
    null_rise: float = 0.05,
    factor: int = 2,
    distance: float = 0.35,
) -> DataFrame:
    """``load, column_name, issue``: pattern, range, nulls, distinct, shift.

    Shares are compared as whole-number products, so a share that lies exactly on a limit is no case.
    """
    wide = "decimal(38,0)"
    rows, before = F.col("n_rows").cast(wide), F.col("prev_rows").cast(wide)
    rise = (F.col("nulls") * before - F.col("prev_nulls") * rows).cast("double") - F.lit(null_rise) * (rows * before).cast("double")
    has = F.col("prev_load").isNotNull()
    name = F.col("column_name")
    issues = [
        F.when((F.col("bad") > 0) & name.isin(*pattern_of), F.lit("pattern")).when(F.col("bad") > 0, F.lit("range")),
        F.when(has & (before > 0) & (rows > 0) & (rise > 1e-9), F.lit("nulls")),
        F.when(has & name.isin(*distinct_of) & ((F.col("n_distinct") * factor < F.col("prev_distinct")) | (F.col("n_distinct") > F.col("prev_distinct") * factor)), F.lit("distinct")),
        F.when(has & name.isin(*shift_of) & (F.col("ks") > distance + 1e-12), F.lit("shift")),
    ]
    return profile.select(load, "column_name", F.explode(F.array_compact(F.array(*issues))).alias("issue"))
