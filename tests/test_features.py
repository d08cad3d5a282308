"""Features, diagnostics and streams."""

import statistics

import pytest

import keyloom as k
from keyloom import diagnostics
from keyloom.operators import features
from keyloom.streaming import stream_groupreduce


def vectors(df):
    return [list(map(lambda v: round(v, 5), r["features"])) for r in df.collect()]


def test_continuous(spark):
    t = k.table({"x": [1, 3, 5]})
    assert vectors(t.featuremat()) == [[-1.0], [0.0], [1.0]]
    assert features.width(t.feature_schema()) == 1


def test_missing(spark):
    t = k.table(spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double"))
    delta = round(0.5 / statistics.stdev([1, 2]), 5)
    assert vectors(t.featuremat()) == [[0.0, -delta], [0.0, delta], [1.0, 0.0]]


def test_categorical(spark):
    t = k.table({"a": ["x", "y", "x"], "b": ["p", "q", "r"]})
    assert t.feature_schema() == {} and vectors(t.featuremat()) == [[], [], []]
    s = t.feature_schema({"a": k.Categorical})
    assert vectors(t.featuremat(s)) == [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]
    rest, mine = k.splitschema(s | {"b": k.Categorical(["p"])}, "b")
    assert list(rest) == ["a"] and list(mine) == ["b"]
    with pytest.raises(Exception, match="unknown label"):
        k.table({"a": ["z"]}).featuremat(s).collect()
    assert k.table({"x": [1, 2]}).feature_schema({"x": None}) == {}
    with pytest.raises(KeyError):
        t.feature_schema({"zzz": None})


def test_same_over_partitions(spark):
    t = k.table({"a": [1, 1, 2, 2], "b": [1, 2, 3, 4]})
    s = t.feature_schema({"a": k.Categorical})
    assert s == t.distribute(3).feature_schema({"a": k.Categorical})


def test_constant_column(spark):
    assert vectors(k.table({"x": [4, 4]}).featuremat()) == [[0.0], [0.0]]


def test_timing(spark):
    timings, result = diagnostics.tracktime(lambda: spark.range(10).count())
    assert result == 10 and timings["jobs"][0] >= 1 and timings["seconds"][0] > 0
    with pytest.raises(ValueError):
        diagnostics.stop_tracking_time("never started")
    assert diagnostics.approx_size(spark.range(10)) > 0


def test_stream(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "g string, v long")
    batch.write.parquet(source)
    stream = stream_groupreduce(spark.readStream.schema(batch.schema).parquet(source), {"s": ("v", "+"), "n": ("v", "length")}, "g")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("streamed")) == [("a", 3, 2), ("b", 5, 1)]
    with pytest.raises(ValueError):
        stream_groupreduce(batch, "+", "g")
