"""Loading files with differing headers, and saving and reloading frames."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

import keyloom as k


@pytest.fixture
def folder(tmp_path):
    def write(**files):
        for name, text in files.items():
            (tmp_path / f"{name}.csv").write_text(text)
        return str(tmp_path)

    return write


def prices(year):
    lines = ["date,ticker,open,high,low,close,volume"]
    for m in (1, 2):
        for i, t in enumerate(("GS", "KO")):
            lines.append(f"{year}-{m:02d}-01,{t},{10 + i}.5,12.0,9.25,11.0,{1000 * m + i}")
    return "\n".join(lines) + "\n"


def test_missing_columns(spark, folder, rows):
    d = folder(t1="a, x\n0, 1\n0, 2\n0, 3\n", t2="a, y\n1, 4.0\n1, 4.5\n1, 5.5\n")
    t = k.load_table(d, datacols=["a", "x", "y"])
    assert t.df.dtypes == [("a", "bigint"), ("x", "bigint"), ("y", "double")]
    assert rows(t) == [(0, 1, None), (0, 2, None), (0, 3, None), (1, None, 4.0), (1, None, 4.5), (1, None, 5.5)]
    assert rows(k.load_table(os.path.join(d, "t1.csv"))) == [(0, 1), (0, 2), (0, 3)]
    assert k.load_table(d, datacols=["y", "none"]).columns == ["y", "none"]


def test_directory_keys_and_file_names(spark, folder, rows):
    d = folder(**{str(y): prices(y) for y in (2010, 2011)}, **{".hidden": "junk\n1\n"})
    t = k.load_array(d, indexcols=[1, 2])
    assert t.keys == ("date", "ticker") and len(t) == 8 and t.df.dtypes[0] == ("date", "date")
    assert t.at(datetime.date(2010, 1, 1), "GS")["open"] == 10.5
    assert rows(k.load_array(sorted(k.glob(d + "/2*.csv"), reverse=True), indexcols=["date", "ticker"])) == rows(t)
    y = k.load_array(d, indexcols=["year", "date", "ticker"], filenamecol="year")
    assert rows(y.unique("year")) == [("2010",), ("2011",)]
    short = k.load_array(d, indexcols=["year", "date"], filenamecol=("year", lambda c: F.substring(c, 3, 2)), agg="max")
    assert rows(short.unique("year")) == [("10",), ("11",)]
    alt = k.load_array(d, indexcols=[("date", "dummy"), ("dummy", "ticker")])
    assert alt.keys == ("date", "dummy") and alt.values == ["open", "high", "low", "close", "volume"]
    n = k.load_array(d)
    assert n.keys == ("_1",) and [r[0] for r in n.collect()] == list(range(1, 9))


def test_options(spark, folder, rows):
    d = folder(semi='x;"y;z"\n1;"a;""b"""\n2;N/A\n')
    assert rows(k.load_table(d, delim=";")) == [(1, 'a;"b"'), (2, None)]
    d2 = os.path.join(d, "sub")
    os.mkdir(d2)
    with open(os.path.join(d2, "s.csv"), "w") as f:
        f.write("junk line\n a   b\n1   2\n3    4\n")
    assert rows(k.load_table(d2, spacedelim=True, skiplines_begin=1)) == [(1, 2), (3, 4)]
    assert k.load_table(d2, header_exists=False, spacedelim=True, skiplines_begin=2).columns == ["_1", "_2"]
    with open(os.path.join(d2, "s.csv"), "w") as f:
        f.write("skip me\nA,b\n1,31.12.2020\n")
    t = k.load_table(d2, skiplines_begin=1, samecols=[("a", "A")], colparsers={"b": k.dateformat("dd.MM.yyyy"), "a": "string"})
    assert rows(t) == [("1", datetime.date(2020, 12, 31))]
    named = k.load_table(d2, skiplines_begin=2, header_exists=False, colnames=["p", "q"], indexcols=["p"], nastrings=["1"])
    with pytest.raises(TypeError):
        k.load_table(d2, no_such_option=1)
    assert named.keys == ("p",) and rows(named) == [(None, "31.12.2020")]


def test_types_come_from_all_rows(spark, folder):
    d = folder(a="i,f,b,d,s,n\n" + "1,1,true,2020-01-01,2020-01-01 10:00,\n" * 40 + "2,1.5,FALSE,2020-01-02,2020-01-02 11:00:01,NA\n")
    kinds = dict(k.load_table(d).df.dtypes)
    assert kinds == {"i": "bigint", "f": "double", "b": "boolean", "d": "date", "s": "timestamp_ntz", "n": "string"}


def test_errors(spark, folder, tmp_path):
    d = folder(t="a,b\n1,2\n")
    with pytest.raises(FileNotFoundError):
        k.load_table(os.path.join(d, "none.csv"))
    with pytest.raises(ValueError):
        k.load_table([])
    with pytest.raises(ValueError):
        k.load_table(d, indexcols=["zzz"])
    with pytest.raises(ValueError):
        k.load_table(d, indexcols=["a", "b"])
    (tmp_path / "empty.csv").write_text("\n")
    with pytest.raises(ValueError):
        k.load_table(str(tmp_path / "empty.csv"))


def test_save_load(spark, tmp_path, rows):
    t = k.array(spark.createDataFrame([(2, "x", None), (1, None, 2.5), (3, "é", 1.0)], "i long, s string, v double"), ["i"])
    back = k.save(t, str(tmp_path / "a"))
    assert back.keys == ("i",) and back.kind == "array" and rows(back) == rows(t)
    more = k.save(k.array(spark.createDataFrame([(9, "n", 0.0)], "i long, s string, v double"), ["i"]), str(tmp_path / "a"), append=True)
    assert len(more) == 4 and len(k.load(str(tmp_path / "a"))) == 4
    one = k.save(k.table(t.df), str(tmp_path / "b"), single=True)
    assert one.keys == () and len([f for f in os.listdir(tmp_path / "b") if f.endswith(".parquet")]) == 1
    with pytest.raises(ValueError):
        k.save(k.table(t.df), str(tmp_path / "a"), append=True)


def test_load_with_output(spark, folder, tmp_path, rows):
    d = folder(**{"2010": prices(2010)})
    out = str(tmp_path / "saved")
    t = k.load_table(os.path.join(d, "2010.csv"), indexcols=["date", "ticker"], output=out)
    assert t.keys == ("date", "ticker") and rows(k.load(out)) == rows(t)
    t = k.load_table(os.path.join(d, "2010.csv"), indexcols=["date", "ticker"], output=out, append=True)
    assert len(t) == 8


def test_ingest_goes_on_counting(spark, folder, tmp_path):
    d = folder(**{"2010": prices(2010)})
    out = str(tmp_path / "kept")
    assert len(k.ingest(os.path.join(d, "2010.csv"), out)) == 4
    more = k.ingest_append(os.path.join(d, "2010.csv"), out)
    assert [r[0] for r in more.collect()] == list(range(1, 9))
