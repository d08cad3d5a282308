"""Implausible readings, relative to what is normal for their source.

For each source (feed) an isolation forest is grown on four features of its readings: level
(distance from the series' median, in units of the series' spread), difference (distance from the
readings around it, in units of the series' noise), season (the same against what is usual on that
weekday) and run length (how surprising it is that the reading has not changed for so long).  Every
reading is scored.  The forest decides what is far: a reading is proposed where its score is above
the threshold of its source, and so is its score along the feature in question alone (the other
features at their usual value), which tells why it is isolated.  The threshold lies ``FENCE``
times as far above the median of the source's scores along the difference as their 98th percentile does.  What follows
is about shape only: a spike must leave the level before and after it and return within three
rows, a stuck stretch must last for eight further rows, a filler must be a large multiple of its
series, high and low may have changed places.  Explicit physical limits (a price not above 0 or
not finite, a negative volume) are applied to every row as well.

Trees cut the whole box of possible features, not only the range of their own readings, so the
empty space beyond the usual readings is cut off early whether or not a tree has seen an unusual
reading.  Features are rounded to half a unit (``STEP``) and bounded (``BOUND`` units and beyond are alike), so
equal ones are scored once.

Shape of the plan.  Distinct rows of a day are partitioned by (feed, bucket): a feed has more than
one bucket of tickers only where it has more rows than ``feed_rows``, so a feed with a third of all
rows is spread over many tasks, and a task holds one bucket.  A first pass tells three things of a feed,
each from all of its buckets: a pool of readings for the trees (those whose hash is below a
bound that depends on the size of the feed), how often each difference occurs, which gives the
threshold, and how far each load is from the medians of its series, which tells loads written in
another unit.  They are a few kilobytes a feed and meet every bucket of the feed in a second pass over
the same exchange, so cutting a feed into buckets changes nothing.  Flags go back to
the rows by an equi-join, so that every row sent with the faulty reading is reported.

Defined results: rows with a null or malformed ticker belong to no series; rows without a date
are held against the physical limits only; nulls and a volume of 0 are no readings; a series with
fewer than ``MIN_READINGS`` readings is judged with the usual noise and spread of its feed; all
different readings of a day that was sent more than once are judged.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.rolling import TICKER
from keyloom.session import checkpointed, guarded_broadcast, partitions

FIELDS = ("close", "high", "low", "volume")
KINDS = {"price": (0, 1, 2), "volume": (3,)}
MIN_READINGS = 12
TREES, SAMPLE, DEPTH = 64, 256, 8
POOL = 1024  # about how many readings of a source its trees draw from
BOUND, STEP, NOTCH = 12.0, 0.5, 0.25
FENCE_AT, FENCE = 0.98, {"price": 5.0, "volume": 3.8}
SPIKE_ROWS, STUCK_ROWS = 3, 8
UNIT = 2.3  # log of the factor from which a whole load counts as written in another unit
UNIT_STEP = 1 / 64  # distances of loads are counted in steps of this
FILLER = 3.0  # log of the factor beyond the series from which a price is a filler
LEVEL, DIFFERENCE, SEASON, RUN = range(4)


@functools.cache
def _cuts(dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and place of the cuts of ``TREES`` complete trees, drawn at random from the boxes they divide."""
    rng = np.random.default_rng(seed)
    inner = (1 << DEPTH) - 1
    feature, cut = np.zeros((TREES, inner), np.int64), np.zeros((TREES, inner), np.float32)
    low = np.full((TREES, 1, dims), -BOUND - STEP, np.float32)
    high = -low
    for level in range(DEPTH):
        first, width = (1 << level) - 1, 1 << level
        choice = rng.integers(0, dims, (TREES, width))
        at = np.arange(TREES)[:, None], np.arange(width)[None, :], choice
        value = low[at] + rng.random((TREES, width), np.float32) * (high[at] - low[at])
        feature[:, first : first + width], cut[:, first : first + width] = choice, value
        low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
        high[at[0], 2 * at[1], choice] = value
        low[at[0], 2 * at[1] + 1, choice] = value
    return feature, cut


class Forest:
    """Isolation trees over the box of all features.

    A tree is cut at random to ``DEPTH``; the readings drawn for it then say at which node a place is isolated (at
    most one of them is left), or how many share its last node.
    """

    def __init__(self, pool: np.ndarray, seed: int):
        size, dims = min(SAMPLE, len(pool)), pool.shape[1]
        self.feature, self.cut = _cuts(dims, seed)
        drawn = np.random.default_rng(seed).integers(0, len(pool), (TREES, size))
        leaf = self._leaves(pool, drawn) + np.arange(TREES)[:, None] * (1 << DEPTH)
        counts = [np.bincount(leaf.ravel(), minlength=TREES << DEPTH).reshape(TREES, -1)]
        for _ in range(DEPTH):
            counts.append(counts[-1][:, ::2] + counts[-1][:, 1::2])
        counts = counts[::-1]
        depth, open_ = np.zeros((TREES, 1), np.float32), np.ones((TREES, 1), bool)
        for level, count in enumerate(counts):
            depth = np.where(open_, level + _expected(count), depth)
            open_ = open_ & (count > 1)
            if level < DEPTH:
                depth, open_ = np.repeat(depth, 2, axis=1), np.repeat(open_, 2, axis=1)
        self.leaf = depth
        self.scale = float(_expected(np.array([size]))[0]) or 1.0

    def _leaves(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The last node that readings come to: ``rows`` are those of each tree, or of all trees alike."""
        flat, dims, inner = np.ascontiguousarray(x, np.float32).ravel(), x.shape[1], (1 << DEPTH) - 1
        feature, cut = self.feature.ravel(), self.cut.ravel()
        root = np.arange(TREES, dtype=np.int64)[:, None] * inner
        out = np.empty((TREES, rows.shape[1]), np.int64)
        for a in range(0, rows.shape[1], 512):  # what is gathered for all trees at once stays in the cache
            base = rows[:, a : a + 512] * dims
            node = np.repeat(root, base.shape[1], axis=1)
            for _ in range(DEPTH):
                go = flat.take(base + feature.take(node)) > cut.take(node)
                node += node
                node += go
                node += 1 - root
            out[:, a : a + 512] = node - root - inner
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean depth / expected depth): near 1 for readings that are easy to isolate."""
        total = np.take_along_axis(self.leaf, self._leaves(x, np.arange(len(x))[None, :]), 1).sum(0)
        return np.exp2(-(total / TREES) / self.scale)

    def score_rounded(self, x: np.ndarray) -> np.ndarray:
        """The scores of features as they come from ``rounded``; equal ones are scored once."""
        codes, back = np.unique(np.ascontiguousarray(x).view(np.uint32).ravel(), return_inverse=True)
        return self.score(codes.view(np.int8).reshape(-1, 4) * np.float32(STEP))[back]


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n readings."""
    n = np.maximum(n.astype(np.float64), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0)).astype(np.float32)


def rounded(x: np.ndarray) -> np.ndarray:
    return np.round(np.clip(x, -BOUND, BOUND) / STEP).astype(np.int8)


class Axis:
    """The score along one feature, the others at their usual value, for each ``NOTCH`` of it."""

    def __init__(self, forest: Forest, usual: np.ndarray, feature: int):
        self.forest, self.usual, self.feature = forest, usual, feature

    @functools.cached_property
    def scores(self) -> np.ndarray:
        notches = np.arange(-BOUND, BOUND + NOTCH / 2, NOTCH, dtype=np.float32)
        probe = np.tile(self.usual.astype(np.float32), (len(notches), 1))
        probe[:, self.feature] = notches
        return self.forest.score(probe)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.scores[notch(x)]


def notch(x: np.ndarray) -> np.ndarray:
    """Which notch of its axis a value falls to, from 0."""
    return np.round((np.clip(x, -BOUND, BOUND) + BOUND) / NOTCH).astype(np.int64)


class Series:
    """The readings of one field, series after series, without gaps."""

    def __init__(self, series: np.ndarray, value: np.ndarray):
        self.keep = np.isfinite(value) & (value > 0)
        self.row = np.flatnonzero(self.keep)
        self.series, self.value = series[self.keep], value[self.keep]
        self.n = len(self.row)
        if not self.n:
            return
        self.start = np.flatnonzero(np.r_[True, np.diff(self.series) != 0])
        self.sizes = np.diff(np.r_[self.start, self.n])
        self.of = np.repeat(np.arange(len(self.start)), self.sizes)
        self.raw = np.log(self.value)
        (self.median,) = self.quantiles(self.raw, 0.5)

    def quantiles(self, x: np.ndarray, *qs: float) -> list[np.ndarray]:
        """Of each series; NaN is left out."""
        order = np.argsort(x, kind="stable")  # NaN sorts last
        order = order[np.argsort(self.of[order], kind="stable")]  # whole numbers: a radix sort
        held = np.bincount(self.of, np.isfinite(x)).astype(np.int64)
        return [np.nan_to_num(x[order[self.start + np.clip(np.round(q * (held - 1)).astype(np.int64), 0, None)]]) for q in qs]

    def apart(self) -> np.ndarray:
        return self.raw - self.median[self.of]


class Readings(Series):
    """The same with what the features are made of.

    ``unit``: how far the load of a reading is moved by its unit.  ``usual``: noise and spread of the source, for
    short series.
    """

    def __init__(self, series: np.ndarray, day: np.ndarray, value: np.ndarray, load: np.ndarray, unit: np.ndarray, usual: tuple[float, float] = (0.0, 0.0)):
        super().__init__(series, value)
        if not self.n:
            return
        n, self.day = self.n, day[self.keep]
        moved = unit_offset(self, load[self.keep], unit[self.keep])
        self.level = level = self.raw - moved
        if moved.any():
            (self.median,) = self.quantiles(level, 0.5)
        step = np.abs(np.diff(level, prepend=level[:1]))
        step[self.start] = np.nan
        middle, high = self.quantiles(step, 0.5, 0.9)
        move = np.maximum(1.4826 * middle, high / 1.645)
        self.around = self.neighbours(level)
        self.dev = level - self.around
        middle, high = self.quantiles(np.abs(self.dev), 0.5, 0.9)
        self.noise = np.maximum(np.maximum(1.4826 * middle, high / 1.645), np.maximum(0.5 * move, 1e-4))
        (far,) = self.quantiles(np.abs(level - self.median[self.of]), 0.5)
        self.spread = np.maximum(1.4826 * far, self.noise)
        short = self.sizes < MIN_READINGS
        self.noise = np.where(short & (usual[0] > 0), usual[0], self.noise)
        self.spread = np.where(short & (usual[1] > 0), usual[1], self.spread)
        # runs of the same reading
        same = np.r_[False, (self.value[1:] == self.value[:-1]) & (self.series[1:] == self.series[:-1])]
        head = np.flatnonzero(~same)
        length = np.diff(np.r_[head, n])
        self.run_length = np.repeat(length, length)
        self.place = np.arange(n) - np.repeat(head, length)
        ordinary = self.run_length <= STUCK_ROWS
        repeats = np.bincount(self.of, same & ordinary) / np.maximum(np.bincount(self.of, ordinary), 1)
        self.repeats = np.clip(repeats, 1 / np.maximum(self.sizes, 2), 0.999)

    def neighbours(self, level: np.ndarray) -> np.ndarray:
        """The median of up to four readings on each side."""
        n, stack = self.n, []
        for k in (1, 2, 3, 4):
            before = np.full(n, np.nan)
            after = np.full(n, np.nan)
            if n > k:
                same = self.series[k:] == self.series[:-k]
                before[k:][same] = level[:-k][same]
                after[:-k][same] = level[k:][same]
            stack += [before, after]
        stack = np.sort(np.stack(stack), axis=0)
        held = np.isfinite(stack).sum(0)
        rows = np.arange(n)
        low, high = stack[np.maximum((held - 1) // 2, 0), rows], stack[np.minimum(held // 2, 7), rows]
        return np.where(held > 0, (low + high) / 2, level)

    def features(self, upward: bool) -> np.ndarray:
        """Level, difference, season, run length; only upwards departures of volumes count."""
        noise = self.noise[self.of]
        weekday = self.of * 7 + (self.day + 3) % 7
        slots = 7 * len(self.start)
        mean = np.bincount(weekday, np.clip(self.dev, -4 * noise, 4 * noise), minlength=slots) / np.maximum(np.bincount(weekday, minlength=slots), 1)
        difference, season = self.dev / noise, (self.dev - mean[weekday]) / noise
        if upward:
            difference, season = np.maximum(difference, 0), np.maximum(season, 0)
        # each further repetition is as surprising as repetitions are rare; in units of two natural logs
        run = self.place * -np.log(self.repeats[self.of]) / 2
        return np.stack([(self.level - self.median[self.of]) / self.spread[self.of], difference, season, run], 1)


def unit_offset(r: Series, load: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Levels of loads written in another unit are moved back to their series."""
    apart = r.apart()
    if not np.abs(apart).max() > UNIT:
        return unit
    # inside one series the load's own level says it better, where it has enough readings
    loads, index = np.unique(load, return_inverse=True)
    own, cell = np.unique(r.of * len(loads) + index, return_inverse=True)
    order = np.lexsort((apart, cell))
    at = np.searchsorted(cell[order], np.arange(len(own)))
    sizes = np.diff(np.r_[at, len(cell)])
    mine = apart[order][at + (sizes - 1) // 2]
    sure = (np.abs(mine) > UNIT) & (sizes > 2 * SPIKE_ROWS + 2)
    return np.where(sure[cell], mine[cell], unit)


def returning(r: Readings, far: np.ndarray) -> np.ndarray:
    """Of the readings that are far, those in stretches of up to three that leave the level before and after and return."""
    sign = np.where(far, np.sign(r.dev), 0).astype(np.int8)
    out = np.zeros(r.n, bool)
    edge = np.r_[True, (sign[1:] != sign[:-1]) | (r.of[1:] != r.of[:-1])]
    heads = np.flatnonzero(edge)
    ends = np.r_[heads[1:], r.n]
    for a, b in zip(heads[sign[heads] != 0], ends[sign[heads] != 0]):
        if b - a > SPIKE_ROWS:
            continue
        lo, hi = r.start[r.of[a]], r.start[r.of[a]] + r.sizes[r.of[a]]
        before, after = r.level[max(lo, a - 3) : a], r.level[b : min(hi, b + 3)]
        if not len(before) or not len(after):
            continue
        x, y = np.median(before), np.median(after)
        inside = r.level[a:b]
        gap = min(np.abs(inside - x).min(), np.abs(inside - y).min())
        leaves = np.all(np.sign(inside - x) == np.sign(inside - y))
        if leaves and gap > 0.5 * np.abs(r.dev[a:b]).min() and abs(x - y) < 0.5 * gap:
            out[a:b] = True
    return out


class Source:
    """What all buckets of a feed know of it: a forest for its prices, one for its volumes, thresholds, units."""

    def __init__(self, pools: dict[str, np.ndarray], counts: dict[str, tuple[np.ndarray, np.ndarray]], units: dict[int, np.ndarray]):
        self.forests: dict[str, Forest] = {}
        self.axes: dict[str, dict[int, Axis]] = {}
        self.limit: dict[str, float] = {}
        self.usual: dict[str, tuple[float, float]] = {}
        self.units = units
        for kind, pool in pools.items():
            x = pool[:, :4].astype(np.float32) * STEP
            forest = self.forests[kind] = Forest(x, seed=len(kind))
            middle = np.median(x, axis=0)
            axes = self.axes[kind] = {k: Axis(forest, middle, k) for k in (LEVEL, DIFFERENCE, RUN)}
            note = np.ascontiguousarray(pool[:, 4:]).view(np.float16).astype(np.float64)
            self.usual[kind] = tuple(np.exp(np.median(note, axis=0)))
            notches, n = counts[kind]
            scores = axes[DIFFERENCE].scores[notches]
            order = np.argsort(scores, kind="stable")
            upto = np.cumsum(n[order])
            half, most = (float(scores[order][np.searchsorted(upto, q * upto[-1])]) for q in (0.5, FENCE_AT))
            self.limit[kind] = half + FENCE[kind] * (most - half)


def judge(c: dict[str, np.ndarray], source: Source) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``field, days, values`` of implausible readings of whole series."""
    out = []
    for kind, fields in KINDS.items():
        if kind not in source.forests:
            continue
        forest, axes, limit = source.forests[kind], source.axes[kind], source.limit[kind]
        held = []
        for f in fields:
            unit = np.array([source.units[x][f] if x in source.units else 0.0 for x in c["loads"]])[c["load_no"]]
            for value, rows in variants(c, f):
                r = Readings(c["series"][rows], c["day"][rows], value, c["load_no"][rows], unit[rows], source.usual[kind])
                if r.n:
                    held.append((f, rows, r, r.features(kind == "volume")))
        if not held:
            continue
        scores = forest.score_rounded(rounded(np.concatenate([x for *_, x in held])))
        ends = np.cumsum([r.n for _, _, r, _ in held])
        for (f, rows, r, x), isolated in zip(held, np.split(scores > limit, ends[:-1])):
            far = isolated & (axes[DIFFERENCE](x[:, DIFFERENCE]) > limit)
            flags = returning(r, far)
            # a run is judged at its end; its first reading is no case
            last = np.flatnonzero((r.place == r.run_length - 1) & (r.run_length > STUCK_ROWS))
            last = last[isolated[last]]
            for i in last[axes[RUN](x[last, RUN]) > limit] if len(last) else ():
                flags[i - r.place[i] + 1 : i + 1] = True
            if kind == "price":
                beyond = np.flatnonzero(far & (r.raw - r.around > FILLER) & (r.level - r.median[r.of] > FILLER))
                if len(beyond):
                    flags[beyond[axes[LEVEL](x[beyond, LEVEL]) > limit]] = True
            hit = np.flatnonzero(flags)
            out.append((f, rows[r.row[hit]], r.value[hit]))
    return out


def variants(c: dict[str, np.ndarray], f: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Readings of field f with the days they belong to.

    First the smallest reading of each day; then, for days that were sent with different ones, the next ones among the
    smallest readings of the other days of the series.
    """
    least = c["least"][f]
    yield least, np.arange(len(least))
    day, value, rank = c["further"][f]
    for k in range(1, int(rank.max(initial=0)) + 1):
        here = rank == k
        touched = np.flatnonzero(np.isin(c["series"], np.unique(c["series"][day[here]])))
        other = least.copy()
        other[day[here]] = value[here]
        yield other[touched], touched


def _days(table: pa.Table) -> dict[str, np.ndarray]:
    """Rows of whole series as days: the smallest reading of each field, and the further ones."""
    ticker = table["ticker"].combine_chunks().dictionary_encode()
    code, day, load = ticker.indices.to_numpy(zero_copy_only=False), table["day"].to_numpy(), table["load"].to_numpy()
    order = np.lexsort((load, day, code))
    code, day, load = code[order], day[order], load[order]
    head = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(day) != 0)])
    of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
    out: dict = {"day": day[head], "series": code[head], "tickers": ticker.dictionary, "least": [], "further": []}
    out["loads"], out["load_no"] = np.unique(load[head], return_inverse=True)
    several = np.zeros(len(head), bool)
    several[of[1:][of[1:] == of[:-1]]] = True
    for f in FIELDS:
        v = table[f].to_numpy().astype(np.float64)[order]
        out["least"].append(np.fmin.reduceat(v, head))  # NaN where there is none
        rows = np.flatnonzero(several[of] & np.isfinite(v))
        pairs = np.unique(np.stack([of[rows].astype(np.float64), v[rows]], 1), axis=0)
        d = pairs[:, 0].astype(np.int64)
        rank = np.arange(len(d)) - np.searchsorted(d, d)
        out["further"].append((d[rank > 0], pairs[rank > 0, 1], rank[rank > 0]))
    return out


def _uniform(c: dict, f: int, rows: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each reading, from a hash of its ticker, day and field."""
    word = np.array([zlib.crc32((t or "").encode()) for t in c["tickers"].to_pylist()], np.uint64)[c["series"][rows]]
    x = (word << np.uint64(32)) ^ (c["day"][rows].astype(np.int64).astype(np.uint64) * np.uint64(8) + np.uint64(f))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


UNITS, COUNTS, POOLED = 0, 1, 2
TOLD = "feed string, what int, field int, load long, bin int, n long, pool binary"


def _survey(table: pa.Table) -> pa.Table:
    """What one bucket says of its feed: distances of loads, counts of differences, readings for the pool."""
    c = _days(table)
    feed, size, bucket = (table[n][0].as_py() for n in ("feed", "feed_n", "bucket"))
    out: dict[str, list] = {k: [] for k in ("what", "field", "load", "bin", "n", "pool")}

    def add(what: int, field: int, load=None, bin=None, n=None, pool=None) -> None:
        rows = 1 if load is None and bin is None else len(load if load is not None else bin)
        for k, v in (("what", what), ("field", field)):
            out[k] += [v] * rows
        for k, v in (("load", load), ("bin", bin), ("n", n)):
            out[k] += [None] * rows if v is None else [x if x is None else int(x) for x in v]
        out["pool"] += [pool] * rows

    none = np.zeros(len(c["day"]))
    for k, (kind, fields) in enumerate(KINDS.items()):
        pool, seen = [], np.zeros(0)
        for f in fields:
            r = Readings(c["series"], c["day"], c["least"][f], c["load_no"], none)
            if not r.n:
                continue
            load = c["load_no"][r.keep]
            total = np.bincount(load, minlength=len(c["loads"]))
            apart = r.apart()
            far = np.abs(apart) > UNIT
            add(UNITS, f, load=c["loads"][total > 0], n=total[total > 0])
            if far.any():
                cells, n = np.unique(np.stack([load[far], np.round(apart[far] / UNIT_STEP).astype(np.int64)], 1), axis=0, return_counts=True)
                add(UNITS, f, load=c["loads"][cells[:, 0]], bin=cells[:, 1], n=n)
            x = r.features(kind == "volume")
            seen = np.r_[seen, x[:, DIFFERENCE]]
            drawn = _uniform(c, f, r.row) * size * len(fields) < POOL
            note = np.log(np.stack([r.noise[r.of[drawn]], r.spread[r.of[drawn]]], 1)).astype(np.float16)
            pool.append(np.concatenate([rounded(x[drawn]), note.view(np.int8)], 1))
        if len(seen):
            n = np.bincount(notch(seen))
            add(COUNTS, k, bin=np.flatnonzero(n), n=n[n > 0])
            add(POOLED, k, load=[bucket], pool=np.concatenate(pool).tobytes())
    kinds = {"what": pa.int32(), "field": pa.int32(), "load": pa.int64(), "bin": pa.int32(), "n": pa.int64(), "pool": pa.binary()}
    columns = {k: pa.array(v, kinds[k]) for k, v in out.items()}
    return pa.table({"feed": pa.array([feed] * len(out["what"]), pa.string()), **columns})


def _sources(told: DataFrame) -> DataFrame:
    """One row for each feed: ``feed, counts, pools, units``.  Adds up and ranks what the buckets say; one linear plan, so the buckets are surveyed once.

    A load is in another unit if the median distance of all its readings from the medians of their series
    is beyond ``UNIT``; the readings within lie between those far below and those far above.
    """
    summed = told.groupBy("feed", "what", "field", "load", "bin").agg(F.sum("n").alias("n"), F.first("pool").alias("pool"))
    cells = summed.groupBy("feed", "what", "field", "load").agg(
        F.sum(F.when(F.col("bin").isNull(), F.col("n"))).alias("all"),
        F.sum(F.when(F.col("bin") < 0, F.col("n"))).alias("below"),
        F.sum(F.when(F.col("bin") > 0, F.col("n"))).alias("above"),
        F.sort_array(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("bins"),
        F.first("pool", ignorenulls=True).alias("pool"),
    )
    middle = F.floor((F.col("all") - 1) / 2)
    below, above = F.coalesce("below", F.lit(0)), F.coalesce("above", F.lit(0))
    start = F.when(middle < below, F.lit(0).cast("bigint")).otherwise(F.col("all") - above)
    side = F.filter("bins", lambda b: F.when(middle < below, b["bin"] < 0).otherwise(b["bin"] > 0))
    ranked = F.aggregate(
        side, F.struct(start.alias("upto"), F.lit(None).cast("int").alias("bin")),
        lambda s, b: F.struct((s["upto"] + b["n"]).alias("upto"), F.when(s["bin"].isNull() & (s["upto"] + b["n"] > middle), b["bin"]).otherwise(s["bin"]).alias("bin")),
    )["bin"]
    shifted = (F.col("all") >= MIN_READINGS) & ((middle < below) | (middle >= F.col("all") - above))
    kept = cells.withColumn("unit", F.when((F.col("what") == UNITS) & shifted, ranked)).where((F.col("what") != UNITS) | F.col("unit").isNotNull())
    return kept.groupBy("feed").agg(
        F.collect_list(F.when(F.col("what") == COUNTS, F.struct("field", "bins"))).alias("counts"),
        F.sort_array(F.collect_list(F.when(F.col("what") == POOLED, F.struct("field", "load", "pool")))).alias("pools"),
        F.collect_list(F.when(F.col("what") == UNITS, F.struct("field", "load", "unit"))).alias("units"),
    )


def _source(row: dict) -> Source:
    names = list(KINDS)
    pools: dict[str, list[np.ndarray]] = {}
    for p in row["pools"]:
        pools.setdefault(names[p["field"]], []).append(np.frombuffer(p["pool"], np.int8).reshape(-1, 8))
    joined = {k: np.concatenate(v) for k, v in pools.items()}
    # in an order of their own, so that buckets make no difference
    joined = {k: v[np.lexsort(v.T)] for k, v in joined.items() if len(v)}
    counts = {}
    for x in row["counts"]:
        counts[names[x["field"]]] = np.array([b["bin"] for b in x["bins"]]), np.array([b["n"] for b in x["bins"]], np.int64)
    units: dict[int, np.ndarray] = {}
    for u in row["units"]:
        units.setdefault(u["load"], np.zeros(len(FIELDS)))[u["field"]] = u["unit"] * UNIT_STEP
    return Source(joined, counts, units)


def _flag(table: pa.Table, known: pa.Table) -> pa.Table:
    """Implausible readings of one bucket, with what is known of its feed."""
    schema = pa.schema([("feed", pa.string()), ("ticker", pa.string()), ("day", pa.int32()), ("field", pa.int32()), ("value", pa.float64())])
    if not table.num_rows or not known.num_rows:
        return schema.empty_table()
    c = _days(table)
    got = judge(c, _source(known.to_pylist()[0]))
    rows = np.concatenate([r for _, r, _ in got]) if got else np.zeros(0, np.int64)
    field = np.concatenate([np.full(len(r), f, np.int32) for f, r, _ in got]) if got else np.zeros(0, np.int32)
    value = np.concatenate([v for _, _, v in got]) if got else np.zeros(0)
    ticker = c["tickers"].take(pa.array(c["series"][rows]))
    feed = pa.array([table["feed"][0].as_py()] * len(rows), pa.string())
    return pa.Table.from_arrays([feed, ticker, pa.array(c["day"][rows].astype(np.int32)), pa.array(field), pa.array(value)], schema=schema)


def flagged(rows: DataFrame, feed_rows: int = 200_000) -> DataFrame:
    """``feed, ticker, day, field, value`` of the readings that are implausible in their series."""
    known = rows.where(F.col("ticker").rlike(TICKER) & F.col("date").isNotNull())
    # one row a feed
    sizes = guarded_broadcast(checkpointed(known.groupBy("feed").agg(F.count("*").alias("feed_n")).select(F.col("feed").alias("feed_"), "feed_n", F.ceil(F.col("feed_n") / feed_rows).cast("int").alias("buckets"))))
    finite = {f: F.when(F.col(f).cast("double").between(1e-300, 1e300) & ~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in FIELDS}
    dated = known.select("feed", "ticker", F.unix_date("date").alias("day"), F.coalesce("file_id", F.lit(-1)).cast("long").alias("load"), *[finite[f].alias(f) for f in FIELDS])
    dated = dated.join(sizes, F.col("feed").eqNullSafe(F.col("feed_")))
    dated = dated.withColumn("bucket", F.pmod(F.xxhash64("ticker"), F.col("buckets")).cast("int")).drop("feed_", "buckets")
    parts = partitions(dated)
    # the partitioning by feed and bucket serves the aggregate and both passes
    key = ["feed", "bucket"]
    days = dated.repartition(parts, *key).groupBy(*key, "feed_n", "ticker", "day", *FIELDS).agg(F.min("load").alias("load"))
    told = days.groupBy(*key).applyInArrow(_survey, TOLD)
    sources = _sources(told).join(sizes, F.col("feed").eqNullSafe(F.col("feed_"))).drop("feed_", "feed_n")
    sources = sources.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).drop("buckets")
    flags = days.groupBy(*key).cogroup(sources.groupBy(*key)).applyInArrow(_flag, "feed string, ticker string, day int, field int, value double")
    return checkpointed(flags)


def implausible(rows: DataFrame, feed_rows: int = 200_000) -> DataFrame:
    """``row_id, field_name`` of implausible readings of close, high, low and volume.

    ``feed_rows``: about how many rows of a source one task handles; a larger source is spread over
    buckets of tickers, which changes nothing in the result.
    """
    marks = flagged(rows, feed_rows).groupBy(F.col("feed").alias("feed_"), F.col("ticker").alias("ticker_"), F.col("day").alias("day_"))
    # the readings of one day
    marks = marks.agg(*[F.collect_set(F.when(F.col("field") == i, F.col("value"))).alias(f"{f}_") for i, f in enumerate(FIELDS)])
    v = {f: F.col(f).cast("double") for f in FIELDS}
    dated = rows.where(F.col("ticker").rlike(TICKER)).select("row_id", "feed", "ticker", F.unix_date("date").alias("day"), *FIELDS)
    same = F.col("feed").eqNullSafe(F.col("feed_")) & (F.col("ticker") == F.col("ticker_")) & (F.col("day") == F.col("day_"))
    both = dated.join(guarded_broadcast(marks), same, "left")
    # explicit limits hold for every row
    limit = {f: F.coalesce(F.isnan(v[f]) | (v[f] <= 0) | (F.abs(v[f]) == float("inf")), F.lit(False)) for f in FIELDS if f != "volume"}
    limit["volume"] = F.coalesce(F.col("volume") < 0, F.lit(False))
    told = {f: F.coalesce(F.array_contains(f"{f}_", v[f]), F.lit(False)) for f in FIELDS}
    # high and low have changed places, unless a spike or a limit in one of them explains their order
    swapped = F.coalesce(F.col("high") < F.col("low"), F.lit(False)) & F.col("day").isNotNull()
    for f in ("high", "low"):
        swapped = swapped & ~told[f] & ~limit[f]
    cases = [F.when(told[f] | limit[f] | (swapped if f in ("high", "low") else F.lit(False)), F.lit(f)) for f in FIELDS]
    some = F.col("ticker_").isNotNull() | F.coalesce(F.col("high") < F.col("low"), F.lit(False))
    for f in FIELDS:
        some = some | limit[f]
    return both.where(some).select("row_id", F.explode(F.array_compact(F.array(*cases))).alias("field_name"))
