"""Golden values of arrays and joins; every result is the same over any number of partitions."""

import datetime

import pytest
from pyspark.sql import functions as F

import keyloom as k

D = datetime.date


@pytest.fixture
def lr(spark):
    left = k.table({"a": [1, 1, 2, 2], "b": [1, 2, 1, 2], "c": [1, 2, 3, 4]}, keys=["a", "b"])
    right = k.table({"a": [0, 1, 1, 3], "b": [1, 1, 2, 2], "d": [1, 2, 3, 4]}, keys=["a", "b"])
    return left, right


@pytest.mark.parametrize("n", [1, 2, 5])
def test_joins(spark, lr, rows, n):
    left, right = (t.distribute(n) for t in lr)
    assert rows(left.join(right)) == [(1, 1, 1, 2), (1, 2, 2, 3)]
    assert rows(left.join(right, "left")) == [(1, 1, 1, 2), (1, 2, 2, 3), (2, 1, 3, None), (2, 2, 4, None)]
    outer = left.join(right, "outer")
    assert outer.columns == ["a", "b", "c", "d"]
    assert rows(outer) == [(0, 1, None, 1), (1, 1, 1, 2), (1, 2, 2, 3), (2, 1, 3, None), (2, 2, 4, None), (3, 2, None, 4)]
    assert rows(left.join(right, "anti")) == [(2, 1, 3), (2, 2, 4)]
    assert rows(left.join(right, broadcast="right")) == rows(left.join(right))


def test_join_options(spark, lr, rows):
    l1 = k.table({"x": [1, 2, 2, 3], "y": [1, 2, 3, 4]})
    r1 = k.table({"x": [2, 2, 3, 3], "z": [5, 6, 7, 8]})
    assert rows(l1.join(r1, lkey="x", rkey="x")) == [(2, 2, 5), (2, 2, 6), (2, 3, 5), (2, 3, 6), (3, 4, 7), (3, 4, 8)]
    left, right = lr
    got = left.join(right, "outer", lkey="a", rkey="a", lselect="b", rselect="d")
    assert rows(got) == [(0, None, 1), (1, 1, 2), (1, 1, 3), (1, 2, 2), (1, 2, 3), (2, 1, None), (2, 2, None), (3, None, 4)]
    assert left.join(left).columns == ["a", "b", "c_1", "c_2"]
    assert rows(left.join(right, f=lambda c, d: c + d)) == [(1, 1, 3), (1, 2, 5)]
    nulls = k.table(spark.createDataFrame([(None, 1)], "x long, v long"), keys=["x"])
    assert len(nulls.join(nulls)) == 0 and len(nulls.join(nulls, null_safe=True)) == 1
    for bad in ({"how": "cross"}, {"broadcast": "left"}, {"how": "outer", "broadcast": True}):
        with pytest.raises(ValueError):
            left.join(right, **bad)


def test_groupjoin(spark, rows):
    left = k.table({"a": [1, 1, 1, 2], "b": [1, 2, 2, 1], "c": [1, 2, 3, 4]}, keys=["a", "b"])
    right = k.table({"a": [0, 1, 1, 2], "b": [1, 2, 2, 1], "d": [1, 2, 3, 4]}, keys=["a", "b"])
    four = [(2, 2), (2, 3), (3, 2), (3, 3)]
    assert rows(left.groupjoin(right)) == [(1, 2, four), (2, 1, [(4, 4)])]
    assert rows(left.groupjoin(right, "left")) == [(1, 1, []), (1, 2, four), (2, 1, [(4, 4)])]
    assert rows(left.groupjoin(right, "outer")) == [(0, 1, []), (1, 1, []), (1, 2, four), (2, 1, [(4, 4)])]
    got = left.groupjoin(right, "outer", lkey="a", rkey="a", lselect="c", rselect="d")
    assert rows(got) == [(0, []), (1, [(1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]), (2, [(4, 4)])]
    assert rows(left.groupjoin(right, "left", f={"n": ("d", "length")})) == [(1, 1, None), (1, 2, 4), (2, 1, 1)]


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("tile", [None, "month"])
def test_asof_dates(spark, rows, n, tile):
    x = k.array({"k": ["ko", "ko", "xrx", "xrx"], "d": [D(2017, 11, 11), D(2017, 11, 12)] * 2}, {"v": [1, 2, 3, 4]}).distribute(n)
    y = k.array({"k": ["ko", "ko", "xrx", "xrx"], "d": [D(2017, 11, 12), D(2017, 11, 13), D(2017, 11, 10), D(2017, 11, 13)]}, {"v": [5, 6, 7, 8]})
    assert [r[2] for r in rows(x.asofjoin(y, tile=tile))] == [1, 5, 7, 7]


@pytest.mark.parametrize("tile", [None, 2, 100])
def test_asof_numbers(spark, rows, tile):
    x = k.array({"s": ["msft", "ibm", "ge"], "t": [1, 3, 4]}, {"p": [100, 200, 150]})
    y = k.array({"s": ["ibm", "msft", "aapl", "ibm"], "t": [0, 0, 0, 2]}, {"p": [100, 99, 101, 98]})
    assert rows(x.asofjoin(y, tile=tile)) == [("ge", 4, 150), ("ibm", 3, 98), ("msft", 1, 99)]


def test_asof_missing_match(spark, rows):
    x = k.array(spark.createDataFrame([("a", 5, 1), (None, 5, 2), ("a", None, 3)], "s string, t long, v long"), ["s", "t"])
    y = k.array(spark.createDataFrame([("a", 4, None), (None, 4, 9)], "s string, t long, v long"), ["s", "t"])
    assert {r[2] for r in x.asofjoin(y).df.collect()} == {None, 2, 3}


@pytest.mark.parametrize("n", [1, 4])
def test_array_joins(spark, rows, n):
    t1 = k.array({"i": [1, 1, 2, 2], "j": [1, 2, 1, 2]}, {"v": [1, 2, 3, 4]}).distribute(n)
    t2 = k.array({"i": [0, 2, 2, 3], "j": [1, 1, 2, 2]}, {"v": [1, 2, 3, 4]})
    assert rows(t1.innerjoin(t2, lambda x, y: x + y)) == [(2, 1, 5), (2, 2, 7)]
    assert rows(t1.leftjoin(t2)) == [(1, 1, 1, None), (1, 2, 2, None), (2, 1, 3, 2), (2, 2, 4, 3)]
    assert rows(t1.merge(t2)) == [(0, 1, 1), (1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 3), (3, 2, 4)]
    assert rows(t2.merge(t1)) == [(0, 1, 1), (1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4), (3, 2, 4)]
    assert rows(k.map_pair(lambda x, y: x * y, t1, t2)) == [(2, 1, 6), (2, 2, 12)]
    a, b = t1.rechunk_together(t2)
    assert rows(a.innerjoin(b)) == [(2, 1, 3, 2), (2, 2, 4, 3)]


def test_merge(spark, rows):
    a = k.table({"x": [1, 3, 5], "y": [1, 2, 3]}, keys=["x"])
    b = k.table({"x": [2, 3, 4], "y": [1, 2, 3]}, keys=["x"])
    assert rows(a.merge(b)) == [(1, 1), (2, 1), (3, 2), (3, 2), (4, 3), (5, 3)]
    p, q = k.array({"x": [1, 3, 5]}, {"v": [1, 2, 3]}), k.array({"x": [2, 3, 4]}, {"v": [1, 2, 3]})
    assert rows(p.merge(q)) == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]
    assert rows(p.merge(q, agg="+")) == [(1, 1), (2, 1), (3, 4), (4, 3), (5, 3)]
    assert len(p.merge(q, agg=None)) == 6 and rows(p.merge(q, agg=min))[2] == (3, 2)
    gone = k.array(spark.createDataFrame([(3, None)], "x long, v long"), ["x"])
    assert rows(p.merge(gone)) == [(1, 1), (3, None), (5, 3)]


@pytest.mark.parametrize("n", [1, 3])
def test_broadcast(spark, rows, n):
    a = k.array({"i": [1, 1, 2, 2], "j": [1, 2, 1, 2]}, {"v": [1, 2, 3, 4]}).distribute(n)
    b = k.array({"i": [1, 2]}, {"w": [1.0, 0.5]})
    mul = lambda x, y: x * y
    assert [r[2] for r in rows(k.broadcast(mul, a, b))] == [1.0, 2.0, 1.5, 2.0]
    assert [r[2] for r in rows(k.broadcast(mul, a, b, dimmap=(0, 1)))] == [1.0, 1.0, 3.0, 2.0]
    assert [r[2] for r in rows(k.broadcast(lambda x, y: x - y, b, a))] == [0.0, -1.0, -2.5, -3.5]
    with pytest.raises(ValueError):
        k.broadcast(mul, a, b, dimmap=(0, 0))


@pytest.mark.parametrize("n", [1, 3, 5])
def test_index(spark, rows, n):
    t = k.array({"x": [1, 1, 1, 2, 2], "y": [1, 2, 3, 1, 2]}, [1, 2, 3, 4, 5]).distribute(n)
    assert (t.at(1, 1), t.at(1, 3), t.at(2, 2)) == (1, 3, 5)
    assert rows(t.at(slice(1, 1), slice(1, 1))) == [(1, 1, 1)]
    assert rows(t.at(range(1, 3), [2, 3])) == [(1, 2, 2), (1, 3, 3), (2, 2, 5)]
    got = t.at(slice(None), 3)
    assert got.keys == ("x",) and rows(got) == [(1, 3)]
    with pytest.raises(KeyError):
        t.at(9, 9)
    with pytest.raises(IndexError):
        t.at(1)
    with pytest.raises(IndexError):
        t.at([2, 1], 1)


def test_upsert(spark, rows):
    x = k.array({"i": [1, 2], "j": [2, 3]}, {"v": [4, 5]})
    x = x.upsert({(2, 3): 6})
    assert rows(x) == [(1, 2, 4), (2, 3, 6)]
    assert rows(x.upsert({(2, 4): 7})) == [(1, 2, 4), (2, 3, 6), (2, 4, 7)]


def test_dims(spark, rows):
    x = k.array({"x": [1, 1, 1, 2, 2, 2], "y": [1, 2, 2, 1, 2, 2], "z": [1, 1, 2, 1, 1, 2]}, {"v": [1, 2, 3, 4, 5, 6]})
    assert rows(x.reduce("+", dims=1)) == [(1, 1, 5), (2, 1, 7), (2, 2, 9)]
    assert rows(x.reduce("+", dims=(1, 3))) == [(1, 5), (2, 16)]
    assert rows(x.reducedim_vec("length", [1, 3])) == [(1, 2), (2, 4)]
    with pytest.raises(ValueError):
        x.reduce("+", dims=(1, 2, 3))
    with pytest.raises(TypeError):
        k.table(x.df).reduce("+", dims=1)
    assert rows(x.selectkeys(2, "+")) == [(1, 5), (2, 16)] and len(x.selectkeys("y")) == 6
    assert rows(x.selectvalues("v")) == rows(x)
    assert x.permutedims([3, 1, 2]).keys == ("z", "x", "y")
    with pytest.raises(ValueError):
        x.permutedims([1, 1, 2])


def test_convertdim(spark, rows):
    t = k.array({"a": [1, 1, 1, 2, 2], "b": [1, 2, 3, 1, 2]}, {"c": [1, 2, 3, 4, 5], "d": [5, 4, 3, 2, 1]})
    at_least = lambda x: x >= 2
    assert len(t.convertdim(2, at_least)) == 5
    assert rows(t.convertdim(2, at_least, agg="+")) == [(1, False, 1, 5), (1, True, 5, 7), (2, False, 4, 2), (2, True, 5, 1)]
    assert rows(t.convertdim("b", at_least, vecagg="length", name="big"), "a", "big", "c") == [(1, False, 1), (1, True, 2), (2, False, 1), (2, True, 1)]
    assert rows(t.convertdim("b", {1: "low", 2: "high", 3: "high"}, agg="max"), "a", "b", "c") == [(1, "high", 3), (1, "low", 1), (2, "high", 5), (2, "low", 4)]
    with pytest.raises(KeyError):
        t.convertdim("c", at_least)


@pytest.mark.parametrize("layout", [1, 2, [1, 3], [3, 1], [1, 2, 1]])
def test_mapslices(spark, rows, layout):
    import pandas as pd

    t = k.array({"x": [1, 1, 2, 2], "y": [1, 2, 3, 4]}, {"v": [1, 2, 3, 4]}).distribute(layout)
    got = t.mapslices(lambda s: s.v.sum(), "y", "s bigint")
    assert rows(got) == [(1, 3), (2, 7)]
    more = t.mapslices(lambda s: pd.DataFrame({"z": [1, 2], "w": [3, 4]}), 2, "z bigint, w bigint", outkeys="z")
    assert more.keys == ("x", "z") and rows(more) == [(1, 1, 3), (1, 2, 4), (2, 1, 3), (2, 2, 4)]
    with pytest.raises(ValueError):
        t.mapslices(lambda s: s, "x", "a int")


def test_array_construction(spark, rows):
    assert rows(k.array({"i": [1, 1, 2]}, {"v": [1, 2, 3]}, agg="+")) == [(1, 3), (2, 3)]
    assert k.array({"i": [1]}, [2]).columns == ["i", "_2"]
    with pytest.raises(ValueError):
        k.array(spark.range(1), [])
    assert rows(k.array({"i": [1, 2]}, [3, 4]).map(lambda r: r[2] * F.lit(-1)), "i") == [(1,), (2,)]
