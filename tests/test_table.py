"""Golden values of tables: selection, editing, grouping, reshaping."""

import datetime
import operator
import re
import statistics

import pytest
from pyspark.sql import functions as F

import keyloom as k
from keyloom import aggs


@pytest.fixture
def xyz(spark):
    return k.table({"x": [1, 1, 1, 2, 2, 2], "y": [1, 1, 2, 2, 1, 1], "z": [1, 2, 3, 4, 5, 6]}, keys=["x", "y"])


@pytest.fixture
def txy(spark):
    return k.table({"t": [0.01, 0.05], "x": [2, 1], "y": [3, 4]}, keys=["t"])


def test_metadata(spark, xyz):
    assert xyz.pkeynames == ("x", "y") and xyz.colnames == ["x", "y", "z"] and xyz.valuenames == ["z"]
    assert xyz.ndims == 2 and xyz.keytype() == {"x": "bigint", "y": "bigint"} and len(xyz) == 6
    assert k.table([(1, 2), (3, 4)]).columns == ["_1", "_2"]
    assert "z" in xyz.show() and repr(xyz) == "table(x*, y*, z)"
    assert len(xyz.compute()) == 6 and xyz.copy().keys == xyz.keys


def test_selectors(spark, txy, rows):
    assert rows(txy.select(2)) == [(1,), (2,)]
    assert rows(txy.select(("x", 1))) == [(1, 0.05), (2, 0.01)]
    assert rows(txy.select(("t", lambda t: 1 / t))) == [(20.0,), (100.0,)]
    got = txy.select(["x", "t", ("vx", ["x", "t"], lambda p: p.x / p.t)])
    assert got.columns == ["x", "t", "vx"] and [round(r[2], 6) for r in rows(got)] == [20.0, 200.0]
    assert txy.select(re.compile("^[tx]$")).columns == ["t", "x"]
    assert txy.select(k.Not("x")).columns == ["t", "y"]
    assert txy.select(k.Between("x", "y")).columns == ["x", "y"]
    assert txy.select(k.Keys()).columns == ["t"]
    assert txy.select(k.All("y", k.Keys())).columns == ["y", "t"] and txy.select(k.All()).columns == ["t", "x", "y"]
    assert txy.select(int).columns == ["x", "y"] and txy.select(float).columns == ["t"]
    assert txy.select(lambda n: n > "t").columns == ["x", "y"]
    assert txy.select(k.Named("m", k.Via("t", operator.neg))).columns == ["m"]
    assert txy.select(F.col("x") + 1).df.count() == 2
    with pytest.raises(KeyError):
        txy.select("nothing")
    with pytest.raises(KeyError):
        txy.select(9)
    with pytest.raises(Exception, match="[Cc]annot convert column into bool|CANNOT_CONVERT_COLUMN_INTO_BOOL"):
        txy.select(("x", lambda c: 1 if c > 1 else 0))


def test_columns_and_rows(spark, txy, rows):
    assert set(txy.column_frames()) == {"t", "x", "y"}
    assert rows(txy.column("x")) == [(1,), (2,)] and txy.rows().columns == ["row"]
    assert rows(txy.key_rows()) == [(0.01,), (0.05,)] and rows(txy.value_rows("x")) == [(1,), (2,)]
    assert rows(k.table({"a": [5, 6, 7]}).key_rows()) == [(1,), (2,), (3,)]
    assert txy.pairs().columns == ["key", "value"]


def test_transform(spark, txy, rows):
    t = k.table({"x": [1, 2], "y": [3, 4]})
    assert rows(t.transform({"y": [5, 6]})) == [(1, 5), (2, 6)]
    assert rows(t.transform({"x": ("x", lambda x: 1 / x)})) == [(0.5, 4), (1.0, 3)]
    assert rows(txy.transform({"t": [0.1, 0.05]})) == [(0.05, 1, 4), (0.1, 2, 3)]
    with pytest.raises(ValueError):
        t.transform({"y": [1, 2, 3]})


def test_columns_inserted(spark, txy, rows):
    for got in (txy.insertcols(2, {"w": [0, 1]}), txy.insertcolsafter("t", {"w": [0, 1]}), txy.insertcolsbefore("x", {"w": [0, 1]})):
        assert got.columns == ["t", "w", "x", "y"] and rows(got) == [(0.01, 0, 2, 3), (0.05, 1, 1, 4)]
    with pytest.raises(IndexError):
        txy.insertcols(9, {"w": [0, 1]})


def test_rename_reindex(spark, txy):
    assert txy.rename({"t": "time"}).keys == ("time",)
    t = k.table({"x": [2, 1], "y": [1, 3], "z": [4, 5]}, keys=[1, 2])
    got = t.reindex(["y", "z"])
    assert got.columns == ["y", "z", "x"] and got.keys == ("y", "z") and t.keys == ("x", "y")
    assert got.collect() == [(1, 4, 2), (3, 5, 1)]
    with pytest.raises(ValueError):
        txy.rename({"t": "x"})


def test_missing(spark, rows):
    t = spark.createDataFrame([(0.1, 2, None), (0.5, None, 6), (None, 4, None), (0.7, 5, 7)], "t double, x long, y long")
    t = k.table(t)
    assert rows(t.dropmissing()) == [(0.7, 5, 7)]
    assert rows(t.dropmissing("y")) == [(0.5, None, 6), (0.7, 5, 7)]
    assert rows(t.dropmissing(["t", "x"])) == [(0.1, 2, None), (0.7, 5, 7)]
    assert t.convertmissing().df is t.df
    assert [r[1] for r in t.sort("x").df.collect()] == [2, 4, 5, None]
    assert [r[1] for r in t.sort("x", reverse=True).df.collect()] == [None, 5, 4, 2]
    assert t.reduce("+", "x") == 11 and t.reduce("+", "x", skipmissing=False) is None
    assert t.reduce(aggs.distinct(), "y") == 2 and t.reduce(aggs.distinct(count_missing=True), "y") == 3
    assert t.equal(t) is None and t.isequal(t)


def test_filter(spark, rows):
    t = k.table({"n": ["a", "b", "c"], "t": [0.01, 0.05, 0.07], "x": [2, 1, 0]})
    assert rows(t.filter(lambda p: p.x / p.t < 100)) == [("b", 0.05, 1), ("c", 0.07, 0)]
    assert rows(t.filter(lambda x: x % 2 == 0, "x"), "n") == [("a",), ("c",)]
    assert rows(t.filter((("x", lambda x: x % 2 == 0), ("t", lambda a: a > 0.01)))) == [("c", 0.07, 0)]
    assert rows(t.filter("x < 0")) == [] and len(t.mask(F.col("x") > 0)) == 2
    a = k.array({"n": ["a", "b", "c"], "t": [0.01, 0.05, 0.07]}, [2, 1, 0])
    assert rows(a.filter(lambda y: y < 2, 3)) == [("b", 0.05, 1), ("c", 0.07, 0)]


def test_map(spark, rows):
    t = k.table({"t": [0.01, 0.05], "x": [1, 2], "y": [3, 4]})
    assert rows(t.map(lambda r: r.x + r.y)) == [(4,), (6,)]
    polar = t.map(lambda p: {"r": F.hypot(p.x, p.y), "a": F.atan2(p.y, p.x)})
    assert polar.columns == ["r", "a"]
    assert rows(t.map(lambda s: s * 2, "x", returns="bigint")) == [(2,), (4,)]
    got = t.map(lambda pdf: pdf.assign(s=pdf.x + pdf.y)[["s"]], ["x", "y"], returns="s bigint")
    assert rows(got) == [(4,), (6,)]


def test_reduce(spark):
    t = k.table({"t": [0.1, 0.5, 0.75], "x": [0, 1, 2]})
    assert t.reduce("+", "t") == pytest.approx(1.35) and t.reduce(operator.add, "x", init=10) == 13
    assert t.reduce(statistics.mean, "t") == pytest.approx(0.45)
    got = t.reduce((min, max), "x")
    assert (got["min"], got["max"]) == (0, 2)
    got = t.reduce(["mean", "variance"], "t")
    assert got["variance"] == pytest.approx(0.1075)
    got = t.reduce({"xsum": ("x", "+"), "negtsum": (("t", operator.neg), "+")})
    assert (got["xsum"], round(got["negtsum"], 6)) == (3, -1.35)
    assert t.reduce(aggs.EXTREMA, "x") == (0, 2)
    assert k.table(t.df.where("x > 9")).reduce("+", "x", init=5) == 5


def test_groupreduce(spark, xyz, rows):
    got = xyz.groupreduce("+", "x", "z")
    assert got.columns == ["x", "+"] and rows(got) == [(1, 6), (2, 15)]
    assert xyz.groupreduce({"y": "+"}, "x", "z").columns == ["x", "y"]
    got = xyz.groupreduce((operator.add, min, max), ["x", "y"], "z")
    assert got.columns == ["x", "y", "+", "min", "max"]
    assert rows(got) == [(1, 1, 3, 1, 2), (1, 2, 3, 3, 3), (2, 1, 11, 5, 6), (2, 2, 4, 4, 4)]
    got = xyz.groupreduce({"xsum": ("z", "+"), "negysum": (("y", operator.neg), "+")}, "x")
    assert rows(got) == [(1, 6, -4), (2, 15, -4)]
    assert rows(xyz.groupreduce("+")) == [(1, 1, 3), (1, 2, 3), (2, 1, 11), (2, 2, 4)]
    with pytest.raises(ValueError):
        k.table(xyz.df).groupreduce("+")


def test_groupby(spark, xyz, rows):
    assert rows(xyz.groupby("mean", "x", "z")) == [(1, 2.0), (2, 5.0)]
    got = xyz.groupby("identity", ["x", "y"], "z")
    assert rows(got) == [(1, 1, [1, 2]), (1, 2, [3]), (2, 1, [5, 6]), (2, 2, [4])]
    got = xyz.groupby({"q25": aggs.quantile(0.25), "q50": "median", "q75": aggs.quantile(0.75)}, "y", "z")
    assert rows(got) == [(1, 1.75, 3.5, 5.25), (2, 3.25, 3.5, 3.75)]
    assert k.table(xyz.df).groupby("mean", [], "z") == 3.5
    flat = xyz.groupby("identity", "x", "z", flatten=True)
    assert rows(flat) == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6)]
    norm = k.table({"x": [1, 1, 2, 2], "y": [3, 4, 5, 6]}).groupby(lambda g: [g.y.mean()] * len(g), "x", "y", flatten=True, returns="normy double")
    assert rows(norm) == [(1, 3.5), (1, 3.5), (2, 5.5), (2, 5.5)]
    keyed = xyz.groupby(lambda key, g: float(key[0] * 10 + len(g)), "x", "z", usekey=True, returns="v double")
    assert rows(keyed) == [(1, 13.0), (2, 23.0)]


def test_summarize(spark, rows):
    a = k.table({"x": [1, 3, 5], "y": [2, 2, 2]})
    assert a.summarize(["mean", "std"]).asDict() == {"x_mean": 3.0, "y_mean": 2.0, "x_std": 2.0, "y_std": 0.0}
    assert a.summarize(["mean", "std"], sel="x").asDict() == {"mean": 3.0, "std": 2.0}
    assert set(a.summarize({"m": "mean", "s": "std"}).asDict()) == {"x_m", "y_m", "x_s", "y_s"}
    b = k.table({"x": ["a", "a", "b", "b"], "y": [1, 3, 5, 7], "z": [2, 2, 2, 2]}, keys=["x"])
    got = b.summarize("mean")
    assert got.columns == ["x", "y", "z"] and rows(got) == [("a", 2.0, 2.0), ("b", 6.0, 2.0)]


def test_stack_unstack(spark, rows):
    t = k.table({"x": [1, 2, 3, 4], "xsquare": [1, 4, 9, 16], "xcube": [1, 8, 27, 64]}, keys=["x"])
    long = t.stack(variable="var", value="val")
    assert len(long) == 8 and long.columns == ["x", "var", "val"]
    wide = long.unstack(variable="var", value="val")
    assert wide.columns == ["x", "xsquare", "xcube"] and rows(wide) == rows(t)
    mixed = k.table({"i": [1], "a": [1], "b": [0.5], "c": ["z"]}, keys=["i"])
    assert mixed.stack(sel=["a", "b"]).df.dtypes[2] == ("value", "double")
    assert mixed.stack().df.dtypes[2] == ("value", "string")
    with pytest.raises(ValueError):
        k.table(long.df.union(long.df), keys=["x"]).unstack(variable="var", value="val")


def test_flatten(spark, rows):
    t = k.table(spark.createDataFrame([(1, [3, 4]), (2, [5, 6]), (3, [])], "x long, y array<long>"))
    assert rows(t.flatten(2)) == [(1, 3), (1, 4), (2, 5), (2, 6)]
    n = k.table(spark.createDataFrame([(1, [(3, 5), (4, 6)]), (2, [(7, 9), (8, 10)])], "x long, y array<struct<a:long,b:long>>"))
    assert rows(n.flatten("y")) == [(1, 3, 5), (1, 4, 6), (2, 7, 9), (2, 8, 10)]
    with pytest.raises(TypeError):
        t.flatten("x")


def test_windows(spark, rows):
    t = k.table({"g": ["a", "a", "a", "b"], "v": [3, 1, 2, 9]})
    assert rows(t.topk(2, "v", "g"), "g", "v") == [("a", 2), ("a", 3), ("b", 9)]
    assert rows(t.rank("v", "g"), "g", "v", "rank") == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 9, 1)]
    assert rows(t.lagdiff("v", "v", "g"), "v", "v_diff") == [(1, None), (2, 1), (3, 1), (9, None)]
    assert rows(t.groupvalue("v", "mean", "g"), "v", "v_mean") == [(1, 2.0), (2, 2.0), (3, 2.0), (9, 9.0)]
    assert rows(t.groupvalue("v", "max", []), "v_max") == [(9,)] * 4


def test_pieces_and_rows(spark):
    t = k.array({"i": list(range(1, 8))}, list(range(8, 15)))
    assert [len(p) for p in t.partition(2)] == [2, 2, 2, 1]
    assert [r[1] for p in t.partition(3) for r in p] == list(range(8, 15))
    assert [r[1] for r in t.subtable(2, 4).collect()] == [9, 10, 11]
    assert t.row_at(1)[1] == 8 and t.row_at(-1)[1] == 14 and t.take(1)[0][1] == 8
    with pytest.raises(IndexError):
        t.row_at(99)


def test_distribute(spark, rows):
    t = k.array({"i": [1, 2, 3, 4]}, [1, 2, 3, 4])
    assert t.distribute(3).df.rdd.getNumPartitions() == 3
    sized = t.distribute([1, 3])
    assert [len(p) for p in sized.df.rdd.glom().collect()] == [1, 3] and rows(sized) == rows(t)
    with pytest.raises(ValueError):
        t.distribute([1, 1])
    assert len(k.fromchunks([t, t.df.where("i < 0"), t])) == 8
    chunked = t.rechunk("i", chunks=2)
    assert [r[0] for p in chunked.df.rdd.glom().collect() for r in p] == [1, 2, 3, 4]
    assert len(t.rechunk("i", chunks=2, closed=False)) == 4


def test_sets(spark, rows):
    a, b = k.table({"x": [1, 2, 2]}), k.table({"x": [2, 3]})
    assert rows(a.intersect(b)) == [(2,)] and rows(a.subtract(b)) == [(1,), (2,)]
    assert rows(a.unique("x")) == [(1,), (2,)]
    assert a.isequal(k.table({"x": [2, 1, 2]})) and not a.isequal(b) and not a.isequal(k.table({"x": [1, 1, 2]}))
    assert a.equal(a) is True and [r[0] for r in a.top(2, "x", reverse=True).collect()] == [2, 2]


def test_statistics(spark, rows):
    t = k.table({"g": ["a", "a", "b"], "v": [1.0, 2.0, 4.0], "w": [2.0, 4.0, 8.0]})
    assert t.reduce(aggs.hist([0, 2, 4]), "v") == [1, 2]
    assert len(t.reduce(aggs.adaptive_hist(2), "v")) == 2
    assert t.reduce(aggs.series("mean", "max"), "v") == (pytest.approx(7 / 3), 4.0)
    assert t.reduce(aggs.regression("v"), "w")[0] == pytest.approx(2.0)
    assert rows(t.countmap("g")) == [({"a": 2, "b": 1},)]
    assert rows(t.mosaic("g", "v")) == [("a", 1.0, 1), ("a", 2.0, 1), ("b", 4.0, 1)]
    assert t.reduce(aggs.quantiles([0.0, 1.0]), "v") == (1.0, 4.0)
    parts = k.table({"i": list(range(10)), "y": [float(i) for i in range(10)]}, keys=["i"]).partitioned("y", "mean", 5)
    assert [round(r[3], 6) for r in sorted(parts.df.collect())] == [0.5, 2.5, 4.5, 6.5, 8.5]
    byx = k.table({"x": [0.0, 1.0, 10.0], "y": [1.0, 3.0, 5.0]}).partitioned("y", "mean", 2, x="x")
    assert [(r["bucket"], r["mean"]) for r in sorted(byx.df.collect())] == [(0, 2.0), (1, 5.0)]
    with pytest.raises(KeyError):
        t.reduce("no such statistic", "v")


def test_fold(spark, rows):
    t = k.table({"g": ["a"] * 50 + ["b"], "v": list(range(50)) + [7]})
    assert rows(t.fold(lambda a, b: a + b, "v", "g", returns="bigint")) == [("a", 1225), ("b", 7)]
    mean = k.Mergeable(lambda: (0, 0), lambda s, v: (s[0] + v, s[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1])
    assert rows(t.fold(mean, "v", "g")) == [("a", 24.5), ("b", 7.0)]
    assert rows(t.fold(max, "v", [], returns="bigint")) == [(49,)]
    assert rows(t.mapchunks(lambda p: p[["v"]].head(0), "v bigint")) == []


def test_dates_as_keys(spark):
    days = [datetime.date(2014 + i, 1, 1) for i in range(4)]
    x = k.array({"date": days}, [4, 5, 6, 7])
    assert x.at(datetime.date(2015, 1, 1)) == 5


def test_builder(spark, txy, rows):
    b = k.ColumnBuilder(txy)
    b["z"] = ("x", lambda x: x * 10)
    b.insert_before("x", "w", [7, 8])
    b.insert_after("x", "v", ("y", lambda y: y + 1))
    b.rename("y", "q")
    del b["z"]
    got = b.build()
    assert got.columns == ["t", "w", "x", "v", "q"] and rows(got) == [(0.01, 7, 2, 4, 3), (0.05, 8, 1, 5, 4)]
    assert rows(b["w"]) == [(7,), (8,)] and txy.columns == ["t", "x", "y"]


def test_filtered_and_row_folds(spark, rows):
    t = k.table({"g": ["a", "a", "b"], "v": [1, 2, 4], "w": [5, 6, 7]})
    assert t.reduce(aggs.filtered("+", lambda c: c > 1), "v") == 6 and t.reduce(aggs.filtered("length", lambda c: c > 1), "v") == 2
    got = t.fold(lambda a, b: {"v": a["v"] + b["v"], "w": max(a["w"], b["w"])}, ["v", "w"], "g", returns="struct<v:bigint,w:bigint>")
    assert rows(got) == [("a", (3, 6)), ("b", (4, 7))]
