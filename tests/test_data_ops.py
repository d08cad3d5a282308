"""The operators for drift, profiles, parsing, rolling totals and implausible readings,
held against plain Python, with nulls, ties, repeated rows, empty tables and extra columns."""

import csv
import datetime
import io
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.operators import badrows, drift, profile, rolling, spikes

DATA = "/root/testdata/sf0.001"
T0 = datetime.datetime(2020, 1, 1)


# ---------------------------------------------------------------- 1: drift


def as_lines(spark, files):
    rows = [(f, i, line) for f, lines in files.items() for i, line in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "file_id long, line_no int, line string")


def as_catalog(spark, entries):
    rows = [(f, feed, T0 + datetime.timedelta(days=day) if day is not None else None, carried) for f, feed, day, carried in entries]
    return spark.createDataFrame(rows, "file_id long, feed string, written_at timestamp_ntz, carried int")


def plain_changes(lines, catalog):
    """Brute force over (file_id, line_no, line) and (file_id, feed, written_at, carried)."""
    def cells(line):
        out = next(csv.reader(io.StringIO(line or ""), skipinitialspace=True), []) or [""]
        return [c.strip(" \t") for c in out]

    def missing(c):
        return c is None or c in ("", "NA", "missing")

    def number(c):
        return float(c) if c is not None and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", c) else None

    def kind(values):
        v = [x for x in values if not missing(x)]
        if not v:
            return None
        if all(re.fullmatch(r"[+-]?\d+", x) for x in v):
            return "long"
        if all(number(x) is not None for x in v):
            return "double"
        return "date" if all(re.fullmatch(r"\d{4}-\d\d-\d\d", x) for x in v) else "string"

    def same(a, b):
        if missing(a) or missing(b):
            return missing(a) and missing(b)
        return a == b or (number(a) is not None and number(a) == number(b))

    tables = {}
    for f, n, line in sorted(lines):
        tables.setdefault(f, []).append(line)
    files = {}
    for f, body in tables.items():
        names = [re.sub(r"[ \t]+", "_", c.lower()) for c in cells(body[0])]
        records = [cells(x) for x in body[1:]]
        files[f] = {n: [r[i] if i < len(r) else None for r in records] for i, n in reversed(list(enumerate(names)))}
    out = set()
    feeds = defaultdict(list)
    for f, feed, at, carried in catalog:
        feeds[feed].append((at, f, carried or 0))
    for entries in feeds.values():
        entries.sort()
        for (_, old, _), (_, new, n) in zip(entries, entries[1:]):
            a, b = files.get(old, {}), files.get(new, {})
            renames = {}
            for x in set(a) - set(b):
                for y in set(b) - set(a):
                    tail, head = a[x][-n:] if n else [], b[y][:n]
                    if n and len(tail) == len(head) == n and all(map(same, tail, head)) and not all(map(missing, head)):
                        renames.setdefault(y, set()).add(x)
            gone = {x for xs in renames.values() for x in xs}
            out |= {(new, y, "renamed") for y in renames}
            out |= {(new, y, "added") for y in set(b) - set(a) - set(renames)} | {(new, x, "removed") for x in set(a) - set(b) - gone}
            for y in b:
                for x in [y] if y in a else renames.get(y, []):
                    if kind(a[x]) and kind(b[y]) and kind(a[x]) != kind(b[y]):
                        out.add((new, y, "retyped"))
    return out


def test_drift_small(spark, rows):
    files = {
        1: ["a, x", "1, 2", "2, NA", "3, 4"],
        2: ['"A", level , note', "2, missing, u", "3, 4.0, NA", "5, 6.5, v"],
        3: ["level,a", "6.5,5", "2020-01-02,x"],
        4: ["b", "1"],
    }
    catalog = [(1, "f", 0, 0), (2, "f", 1, 2), (3, "f", 2, 1), (4, "g", 0, 0)]
    got = rows(drift.schema_changes(as_lines(spark, files), as_catalog(spark, catalog)))
    assert got == sorted([(2, "level", "renamed"), (2, "level", "retyped"), (2, "note", "added"), (3, "a", "retyped"), (3, "level", "retyped"), (3, "note", "removed")])
    table = drift.consistent_table(as_lines(spark, files), as_catalog(spark, catalog), ["a", "x"])
    assert table.count() == 9
    values = {(r["file_id"], r["line_no"]): (r["a"], r["a_long"], r["x"], r["x_double"], r["x_text"]) for r in table.collect()}
    assert values[2, 4] == ("5", 5, "6.5", 6.5, None) and values[3, 3] == ("x", None, "2020-01-02", None, None)
    assert values[1, 3] == ("2", 2, None, None, None) and values[4, 2][0] is None


def test_drift_rename_then_add_again(spark):
    """A new column takes the old name of a renamed one: both keep all their cells."""
    files = {
        10: ["a,x", "1,2", "3,4"],
        7: ["alpha,x", "3,4", "5,6"],
        8: ["x,a,alpha", "6,50,5", "7,70,NA"],
        9: ["a,beta", "70,NA", "80,8"],
        6: ["a,p,q", "80,8,8", "90,9,11"],
    }
    catalog = [(10, "f", 0, 0), (7, "f", 1, 1), (8, "f", 2, 1), (9, "f", 3, 1), (6, "f", 4, 1)]
    lines, catalog = as_lines(spark, files), as_catalog(spark, catalog)
    names = {(r["file_id"], r["name"]): r["canonical"] for r in drift.canonical_names(lines, catalog).collect()}
    assert names[7, "alpha"] == names[8, "alpha"] == "a" and names[8, "a"] == names[9, "a"] == names[6, "a"] == "a@8"
    assert names[6, "p"] == names[9, "beta"] == "beta" and names[6, "q"] == "q"  # p and q both agree with beta
    table = drift.consistent_table(lines, catalog, ["a", "x"]).collect()
    got = {(r["file_id"], r["line_no"]): (r["a"], r["a_long"], r["x"], {n: c["canonical"] for n, c in r["other"].items()}) for r in table}
    assert got[10, 2] == ("1", 1, "2", {}) and got[7, 3] == ("5", 5, "6", {})
    assert got[8, 2] == ("5", 5, "6", {"a@8": "50"}) and got[8, 3] == (None, None, "7", {"a@8": "70"})
    assert got[9, 3] == (None, None, None, {"a@8": "80", "beta": "8"})
    assert got[6, 3] == (None, None, None, {"a@8": "90", "beta": "9", "q": "11"})


def test_cells_keep_their_branch_and_have_a_canonical_form(spark):
    files = {1: ["k,v", "1,+007", "2,-0.50", "3,1.5e3", "4,2020-01-02", "5, x y ", "6,NA", "7,0.000", "8,.05", "9,12345678901234567890123", "10,1e99"]}
    lines, catalog = as_lines(spark, files), as_catalog(spark, [(1, "f", 0, 0)])
    day = datetime.date(2020, 1, 2)
    want = {
        "1": ("7", 7, 7.0, None, None), "2": ("-0.5", None, -0.5, None, None), "3": ("1500", None, 1500.0, None, None), "4": ("2020-01-02", None, None, day, None),
        "5": ("x y", None, None, None, "x y"), "6": (None, None, None, None, None), "7": ("0", None, 0.0, None, None), "8": ("0.05", None, 0.05, None, None),
        "9": ("12345678901234567890123", None, 12345678901234567890123.0, None, None), "10": ("1e99", None, 1e99, None, None),
    }
    asked = drift.consistent_table(lines, catalog, ["k", "v"])
    assert {r["k"]: (r["v"], r["v_long"], r["v_double"], r["v_date"], r["v_text"]) for r in asked.collect()} == want
    rest = drift.consistent_table(lines, catalog, ["k"])
    assert {r["k"]: tuple(r["other"]["v"]) if "v" in r["other"] else (None,) * 5 for r in rest.collect()} == want


def test_numbers_are_compared_exactly(spark, rows):
    """Two whole numbers that are one double are two numbers; other spellings of a number are the same one."""
    for old, new, kind in (("9007199254740993", "9007199254740992", None), ("0012.50", "+1.25e1", "renamed"), ("-0", "0.0", "renamed"), ("1e400", "1e401", None)):
        lines = as_lines(spark, {1: ["a", old], 2: ["b", new]})
        got = rows(drift.schema_changes(lines, as_catalog(spark, [(1, "f", 0, 0), (2, "f", 1, 1)])))
        assert ((2, "b", "renamed") in got) == (kind == "renamed"), (old, new)


def test_appearing_alternatives(spark, rows):
    files = {
        1: ["a, x", "1, 2", "2, NA", "3, 4"],
        2: ["a, level, note", "2, missing, u", "3, 4.0, NA", "5, 6.5, v"],
        3: ["level,a,note", "6.5,5,v", "2020-01-02,x,NA"],
        5: ["a,note", "x,NA", "2020-01-03,NA", "7,NA"],
        6: ["note,a", "8,y"],
    }
    catalog = [(1, "f", 0, 0), (2, "f", 1, 2), (3, "f", 2, 1), (5, "f", 3, 0), (6, "f", 4, 0)]
    lines, catalog = as_lines(spark, files), as_catalog(spark, catalog)
    got = rows(drift.appearing_alternatives(lines, catalog))
    assert got == [(2, "level", "double"), (3, "a", "string"), (3, "level", "date"), (5, "a", "date"), (6, "note", "long")]
    assert (5, "a", "retyped") not in rows(drift.schema_changes(lines, catalog))
    assert drift.appearing_alternatives(lines.limit(0), catalog.limit(0)).count() == 0


def test_drift_brute_force(spark):
    lines = spark.read.parquet(f"{DATA}/t1.parquet").unionByName(spark.read.parquet(f"{DATA}/t2.parquet"))
    catalog = spark.read.parquet(f"{DATA}/filecatalog.parquet").where("dataset in ('t1', 't2')")
    got = {tuple(r) for r in drift.schema_changes(lines, catalog).collect()}
    want = plain_changes([tuple(r) for r in lines.collect()], [tuple(r) for r in catalog.select("file_id", "feed", "written_at", "carried").collect()])
    assert got == want and got


def test_drift_random(spark):
    rng = random.Random(4)
    files, catalog = {}, []
    for feed in range(6):
        last = []
        for day in range(5):
            names = rng.sample(["a", "b", "c", "d"], rng.randint(1, 4))
            carried = min(rng.randint(0, 2), len(last))
            body = last[len(last) - carried :] + [[rng.choice(["1", "2", "2.0", "x", "NA", "2020-02-02", ""]) for _ in range(4)] for _ in range(rng.randint(0, 3))]
            f = feed * 10 + day
            files[f] = [",".join(names)] + [",".join(r[: len(names)]) for r in body]
            catalog.append((f, f"feed{feed}", day, carried))
            last = body
    lines = [(f, i, x) for f, body in files.items() for i, x in enumerate(body, 1)]
    got = {tuple(r) for r in drift.schema_changes(as_lines(spark, files), as_catalog(spark, catalog)).collect()}
    assert got == plain_changes(lines, [(f, feed, T0 + datetime.timedelta(days=d), c) for f, feed, d, c in catalog])


def test_drift_edges(spark, rows):
    lines = as_lines(spark, {1: ["a", "1"], 2: ["a,a,", None], 3: ["a"]}).withColumn("feed", F.lit("clash"))
    catalog = as_catalog(spark, [(1, None, None, None), (2, None, None, None), (3, None, None, 5), (9, "e", 0, 0)])
    got = rows(drift.schema_changes(lines, catalog))
    assert got == [(2, "", "added"), (3, "", "removed")]
    assert drift.schema_changes(lines.limit(0), catalog.limit(0)).count() == 0
    assert drift.consistent_table(lines.limit(0), catalog.limit(0), ["a"]).count() == 0


# ---------------------------------------------------------------- 2: profile


def loads(spark, values):
    """[(file, feed, day, [(open, volume, ticker)])] as rows and catalog."""
    rows = [(f, o, v, t, "clash") for f, _, _, body in values for o, v, t in body]
    df = spark.createDataFrame(rows, "file_id long, open double, volume long, ticker string, n_rows string")
    return df, as_catalog(spark, [(f, feed, day, 0) for f, feed, day, _ in values])


def bad():
    return {"ticker": ~F.col("ticker").rlike(rolling.TICKER), "open": F.isnan("open") | ~(F.col("open") > 0), "volume": F.col("volume") < 0}


def test_profile_issues(spark, rows):
    base = [(float(i), i, "ABC") for i in range(1, 21)]
    later = [(float(i + 7), None, "ABC") for i in range(1, 21)]
    df, catalog = loads(spark, [(1, "f", 0, base), (2, "f", 1, later), (3, "f", 2, [(float("nan"), -1, "bad?"), (1.0, 3, "DEF"), (2.0, 3, "GHI")]), (4, "g", 0, base)])
    p = profile.profile_loads(df, catalog, bad=bad(), quantiles=(0.0, 0.5))
    got = {(r["file_id"], r["column_name"]): r for r in p.collect()}
    assert got[2, "open"]["ks"] == pytest.approx(0.35) and got[1, "open"]["ks"] is None
    assert got[2, "volume"]["nulls"] == 20 and got[2, "volume"]["ks"] is None
    assert (got[3, "open"]["n_distinct"], got[3, "open"]["least"], got[3, "open"]["most"]) == (3, 1.0, 2.0)
    assert got[1, "open"]["q_0.5"] == 10.5 and got[1, "open"]["q_0"] == 1.0
    issues = rows(profile.load_issues(p))
    assert issues == sorted([(2, "volume", "nulls"), (3, "open", "range"), (3, "open", "shift"), (3, "ticker", "distinct"), (3, "ticker", "pattern"), (3, "volume", "range")])


def test_profile_edges(spark):
    df, catalog = loads(spark, [(1, "f", 0, [(None, None, None)] * 3), (2, "f", 0, [(1.0, 5, "ABC")] * 3)])
    p = {(r["file_id"], r["column_name"]): r for r in profile.profile_loads(df, catalog).collect()}
    assert p[1, "open"]["nulls"] == 3 and p[1, "open"]["n_distinct"] == 0 and p[2, "ticker"]["n_distinct"] == 1
    assert p[2, "open"]["prev_load"] == 1 and p[2, "open"]["ks"] is None
    assert profile.profile_loads(df.limit(0), catalog.limit(0)).count() == 0
    alone = profile.profile_loads(df, catalog.limit(0), quantiles=(0.5,))  # loads that no catalog knows
    assert alone.count() == 6 and alone.where("prev_load is not null").isEmpty()


def test_profile_hot_feed_in_pieces(spark, monkeypatch):
    """Exact distances and quantiles where a feed is cut over partitions and chunks."""
    monkeypatch.setattr(profile, "CHUNK", 50)
    rng = np.random.default_rng(5)
    values = []
    for f in range(6):
        body = [(float(round(x, 1)), int(v), None) for x, v in zip(rng.normal(f, 2, 400), rng.integers(0, 5, 400))]
        values.append((f, "hot", f, body))
    df, catalog = loads(spark, values)
    p = {(r["file_id"], r["column_name"]): r for r in profile.profile_loads(df, catalog, quantiles=(0.25, 0.9)).collect()}
    for (_, _, _, old), (f, _, _, new) in zip(values, values[1:]):
        for i, c in enumerate(("open", "volume")):
            a, b = (np.sort([r[i] for r in x]) for x in (new, old))
            v = np.concatenate([a, b])
            ks = np.abs(np.searchsorted(a, v, "right") / len(a) - np.searchsorted(b, v, "right") / len(b)).max()
            assert p[f, c]["ks"] == pytest.approx(ks, abs=1e-12)
            assert p[f, c]["q_0.25"] == pytest.approx(np.quantile(a, 0.25)) and p[f, c]["q_0.9"] == pytest.approx(np.quantile(a, 0.9))
            assert p[f, c]["n_distinct"] == len(set(a))


# ---------------------------------------------------------------- 3: rows that fail

CASES = [
    ("2020-01-02,ABC,1,2,0.5,1.5,10", None),
    (' 2020-01-02 ,"ABC" , +1 ,2e3, .5 ,NA,missing', None),
    ('2020-01-02,"A""B,C",1,2,3,4,5', None),
    ("2020-01-02,ABC,,,,,", None),
    ("2020-01-02,ABC,1,2,3,4,9223372036854775807", None),
    ("2020-01-02,ABC,1,2,3,4,9223372036854775808", "value"),
    ("2020-02-30,ABC,1,2,3,4,5", "value"),
    ("20200102,ABC,1,2,3,4,5", "value"),
    ("missing,ABC,1,2,3,4,5", "value"),
    ("2020-01-02,NA,1,2,3,4,5", "value"),
    ("2020-01-02,ABC,1,2,3,nan,5", "value"),
    ("2020-01-02,ABC,1,2,3,4,-5", "value"),
    ("2020-01-02,ABC,1,2,3,4,5.0", "value"),
    ("2020-01-02,ABC,1,2,3,4,\xa05", "value"),
    ("2020-01-02,ABC,1,2,3,4", "columns"),
    ("2020-01-02,ABC,1,2,3,4,5,6", "columns"),
    ("", "columns"),
    (None, "columns"),
    ('2020-01-02,A"B,1,2,3,4,5', "quoting"),
    ('2020-01-02,"ABC,1,2,3,4,5', "quoting"),
    ('2020-01-02,"ABC"x,1,2,3,4,5', "quoting"),
    ('2020-01-02,ABC,1,2,3,4,""5""', "quoting"),
    ("2020-01-02,ABC,1,2,3,4," + "9" * 5000, "value"),
    ('"' * 100_001, "quoting"),
]


def test_bad_rows(spark):
    lines = spark.createDataFrame([(7, i, text, "x") for i, (text, _) in enumerate(CASES, 2)] + [(7, 1, "header", "x")], "file_id long, line_no int, line string, reason string")
    parsed = {r["line_no"]: r for r in badrows.parse_rows(lines).collect()}
    assert [parsed[i]["reason"] for i in range(2, len(CASES) + 2)] == [reason for _, reason in CASES]
    assert parsed[2]["volume"] == 10 and parsed[3]["high"] == 2000.0 and parsed[4]["ticker"] == 'A"B,C' and parsed[2]["line"] is None
    assert badrows.bad_rows(lines).count() + badrows.good_rows(lines).count() == len(CASES)
    assert parsed[20]["error_at"] == 12
    assert badrows.bad_rows(lines.limit(0)).count() == 0


def test_bad_rows_against_patterns(spark):
    """Quote-free lines by regular expressions alone."""
    lines = spark.read.parquet(f"{DATA}/sample_raw.parquet")
    got = {(r[0], r[1]): r[2] for r in badrows.bad_rows(lines).collect()}
    number = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NA|missing|"
    for r in lines.where("line_no > 1").collect():
        if '"' in r["line"]:
            continue
        cells = [c.strip(" \t") for c in r["line"].split(",")]
        want = None
        if len(cells) != 7:
            want = "columns"
        else:
            try:
                good = bool(re.fullmatch(r"\d{4}-\d\d-\d\d", cells[0])) and bool(datetime.date.fromisoformat(cells[0]))
            except ValueError:
                good = False
            good &= cells[1] not in ("", "NA", "missing") and all(re.fullmatch(number, c, re.A) for c in cells[2:6])
            good &= bool(re.fullmatch(r"\d+|NA|missing|", cells[6], re.A))
            want = None if good else "value"
        assert got.get((r["file_id"], r["line_no"])) == want, r["line"]


def test_recovery_in_whole_text():
    good = "2020-01-02,ABC,1,2,3,4,5"
    text = "\n".join([good, '2020-01-03,"ABC,1,2,3,4,5', good, '2020-01-03,"A\nB",1,2,3,4,5', good])
    got = list(badrows.parse_text(text))
    assert [r[3] for r in got] == [None, "quoting", None, None, None] and got[3][2][1] == "A\nB"


def test_whole_texts(spark):
    good = "2020-01-02,ABC,1,2,3,4,5"
    text = "\n".join([good, '2020-01-03,"ABC,1,2,3,4,5', good, '2020-01-03,"A\nB",1,2,3,4,5', "x", good])
    df = spark.createDataFrame([(1, text, "clash"), (2, None, None), (3, "", ""), (4, "\n".join([good] * 25_000), "")], "file_id long, text string, line string")
    got = badrows.parse_texts(df)
    first = sorted(got.where("file_id = 1").collect(), key=lambda r: r["record_no"])
    assert [r["reason"] for r in first] == [None, "quoting", None, None, "columns", None] and first[3]["ticker"] == "A\nB"
    assert [text[r["start"] :].startswith(r["line"] or good[:7]) for r in first] == [True] * 6 and first[1]["error_at"] == len(good) + 12
    assert got.where("file_id in (2, 3)").count() == 0
    assert tuple(got.where("file_id = 4").agg(F.count("*"), F.max("record_no"), F.count("reason")).first()) == (25_000, 25_000, 0)


def test_plain_lines_equal_the_descent(spark):
    """What Column expressions settle is what the descent gives."""
    lines = spark.read.parquet(f"{DATA}/sample_raw.parquet").where("line_no > 1").select("file_id", "line_no", "line")
    known = {(r["file_id"], r["line_no"]): r for r in badrows.parse_rows(lines).collect()}
    for r in lines.collect():
        values, reason, at = badrows.parse_line(r["line"])
        row = known[r["file_id"], r["line_no"]]
        assert (row["reason"], row["error_at"]) == (reason, at)
        assert values is None or [row[n] for n, _ in badrows.FIELDS] == values
    settled = lines.where(badrows.plainly_valid()).count()
    assert settled > 0.5 * len(known)


# ---------------------------------------------------------------- 4: rolling totals


def brute_rolling(rows, periods):
    total = Counter()
    days = defaultdict(set)
    for e, d, v in rows:
        if e is not None and d is not None:
            total[e, d] += v if v is not None and v > 0 else 0
            days[e].add(d)
    out = {}
    for e, ds in days.items():
        d = min(ds)
        while d <= max(ds):
            out[e, d] = tuple(sum(total[e, d - datetime.timedelta(days=i)] for i in range(p)) for p in periods)
            d += datetime.timedelta(days=1)
    return out


@pytest.mark.parametrize("tile", [5, 16, 128])
def test_rolling(spark, tile, monkeypatch):
    monkeypatch.setattr(rolling, "HELD", 10 if tile == 16 else 400_000)  # closures carry it to the workers by value
    rng = random.Random(tile)
    days = [datetime.date(1969, 12, 20) + datetime.timedelta(days=i) for i in range(120)]
    data = [(rng.choice(["A", "B", "C", None]), rng.choice([*rng.sample(days, 8), None]), rng.choice([None, -5, 0, 3, 1 << 40, (1 << 62) + 1])) for _ in range(80)]
    data += [("hot", days[0], 2)] * 300 + [("gap", days[0], 9), ("gap", days[-1], 1)]
    df = spark.createDataFrame(data, "e string, d date, v long").withColumn("total", F.lit("clash"))
    got = {(r["e"], r["d"]): (int(r["total_3"]), int(r["total_17"])) for r in rolling.trailing_totals(df, "e", "d", "v", (3, 17), tile=tile).collect()}
    want = brute_rolling(data, (3, 17))
    assert got == want
    quiet = {(r["e"], r["d"]) for r in rolling.trailing_totals(df, "e", "d", "v", (3, 17), tile=tile, quiet_only=True).collect()}
    assert quiet == {k for k, (a, b) in want.items() if a == 0 and b > 0}
    assert rolling.trailing_totals(df.limit(0), "e", "d", "v").count() == 0
    with pytest.raises(ValueError):
        rolling.trailing_totals(df, "e", "d", "v", (0,))


def test_last_delivery(spark, rows):
    d = datetime.date(2020, 1, 1)
    data = [(1, 1, "f", "ABC", d, 5), (2, 2, "f", "ABC", d, None), (3, 2, "f", "ABC", d, 7), (4, 9, "f", "ABC", d, 1), (5, 1, "g", "ABC", d, 2), (6, 1, "f", "abc", d, 3), (7, 1, "f", None, d, 3), (8, 1, "f", "ABC", None, 3)]
    df = spark.createDataFrame(data, "row_id long, file_id long, feed string, ticker string, date date, volume long")
    got = rows(rolling.last_delivery(df, as_catalog(spark, [(1, "f", 0, 0), (2, "f", 1, 0)])))
    assert got == [("f", "ABC", d, 7), ("g", "ABC", d, 2)]


# ---------------------------------------------------------------- 5: implausible readings


def series(seed, n=200, level=100.0):
    rng = np.random.default_rng(seed)
    close = level * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return close, close * (1 + rng.random(n) * 0.01), close * (1 - rng.random(n) * 0.01), np.exp(rng.normal(10, 0.4, n)).astype(int)


def stock_rows(close, high, low, volume, feed="f", ticker="ABC", start=0, file=1):
    day = datetime.date(2015, 1, 1)
    return [[start + i, file, feed, day + datetime.timedelta(days=i), ticker, round(float(c), 4), round(float(h), 4), round(float(lo), 4), int(v)] for i, (c, h, lo, v) in enumerate(zip(close, high, low, volume))]


STOCK = "row_id long, file_id long, feed string, date date, ticker string, close double, high double, low double, volume long"


def test_implausible(spark):
    data = stock_rows(*series(1))
    other = stock_rows(*series(2), ticker="DEF", start=1000)
    want = set()
    for i, field, value in ((20, 5, -1.0), (30, 6, float("nan")), (40, 7, float("inf")), (50, 8, -3), (60, 5, 99999.99), (70, 5, data[70][5] * 3), (71, 5, data[71][5] * 3), (90, 8, data[90][8] * 80), (199, 5, 0.0)):
        data[i][field] = value
        want.add((i, ("close", "high", "low", "volume")[field - 5]))
    data[100][6], data[100][7] = data[100][7], data[100][6]
    want |= {(100, "high"), (100, "low")}
    for i in range(121, 132):
        data[i][5] = data[120][5]
        want.add((i, "close"))
    for i in range(150, 200):  # a level that changes and stays is no case
        for f in (5, 6, 7):
            data[i][f] *= 2
    resent = [list(data[70])]
    resent[0][0] = 5000
    want.add((5000, "close"))
    null = [None] * 9
    null[0] = 6000
    odd = [[6001, 1, "f", None, "ABC", -1.0, None, None, None], [6002, 1, "f", data[5][3], "abc", -1.0, -1.0, -1.0, -1], null]
    want.add((6001, "close"))
    df = spark.createDataFrame(data + other + resent + odd, STOCK).withColumn("bucket", F.lit("clash"))
    assert {tuple(r) for r in spikes.implausible(df).collect()} == want
    # a feed cut into buckets gives the same
    assert {tuple(r) for r in spikes.implausible(df, feed_rows=100).collect()} == want


def test_load_in_another_unit(spark):
    close, high, low, volume = series(3, 120)
    data = stock_rows(close, high, low, volume)
    for i in range(40, 80):
        data[i][1], data[i][8] = 2, data[i][8] * 1000
    late = [10, 90]  # days of the other load in the middle of this one
    for i in late:
        data[i][1], data[i][8] = 2, data[i][8] * 1000
    assert spikes.implausible(spark.createDataFrame(data, STOCK)).count() == 0


def test_late_rows_of_a_load_in_another_unit(spark):
    """Late rows of a load are told by the whole load, however the feed is cut."""
    data = []
    for k, ticker in enumerate(("ABC", "DEF", "GHI", "JKL")):
        own = stock_rows(*series(20 + k, 120), ticker=ticker, start=1000 * k)
        for i in range(40, 80) if k == 0 else (10 + k, 90):
            own[i][1], own[i][8] = 2, own[i][8] * 1000
        data += own
    df = spark.createDataFrame(data, STOCK)
    assert spikes.implausible(df).count() == 0
    assert spikes.implausible(df, feed_rows=100).count() == 0
    spiked = next(r for r in data if r[0] == 2050)
    spiked[8] *= 80
    for sizes in ({}, {"feed_rows": 100}):
        assert [tuple(r) for r in spikes.implausible(spark.createDataFrame(data, STOCK), **sizes).collect()] == [(2050, "volume")]


def test_implausible_edges(spark):
    empty = spark.createDataFrame([], STOCK)
    assert spikes.implausible(empty).count() == 0
    same = [[i, 1, None, datetime.date(2020, 1, 1), "ABC", 1.0, 1.0, 1.0, 5] for i in range(50)]
    assert spikes.implausible(spark.createDataFrame(same, STOCK)).count() == 0
    short = stock_rows(*series(4, 5))
    short[2][5] = 1e6
    # a short series is judged by what is usual in its feed, be it alone there or not
    assert [tuple(r) for r in spikes.implausible(spark.createDataFrame(short, STOCK)).collect()] == [(2, "close")]
    beside = stock_rows(*series(5, 200), ticker="DEF", start=100)
    assert [tuple(r) for r in spikes.implausible(spark.createDataFrame(short + beside, STOCK)).collect()] == [(2, "close")]


def test_every_reading_of_a_day_is_judged(spark):
    """A day sent three times with different readings: the one in the middle is judged as well."""
    data = stock_rows(*series(6, 200))
    usual = data[80][5]
    again = [list(data[80]) for _ in range(2)]
    again[0][0], again[0][5] = 900, usual * 3
    again[1][0], again[1][5] = 901, 99999.0
    got = {tuple(r) for r in spikes.implausible(spark.createDataFrame(data + again, STOCK)).collect()}
    assert got == {(900, "close"), (901, "close")}


def test_cutting_a_feed_changes_nothing(spark):
    """Real data: buckets of tickers of any size give the same rows."""
    df = spark.read.parquet("/root/testdata/sf0.01/stock_sample.parquet")
    whole = {tuple(r) for r in spikes.implausible(df).collect()}
    assert len(whole) > 300
    assert {tuple(r) for r in spikes.implausible(df, feed_rows=500).collect()} == whole


def test_the_forest_decides():
    """The same readings under a forest that finds nothing isolated give no case."""
    data = stock_rows(*series(7, 300))
    data[100][5] *= 2
    table = pa.table({
        "feed": ["f"] * 300, "bucket": [0] * 300, "feed_n": [300] * 300, "ticker": ["ABC"] * 300, "day": pa.array(range(300), pa.int32()), "load": pa.array([1] * 300, pa.int64()),
        **{f: pa.array([float(r[k]) for r in data]) for f, k in (("close", 5), ("high", 6), ("low", 7), ("volume", 8))},
    })
    told = spikes._survey(table).to_pylist()
    counts = [{"field": k, "bins": [t for t in told if t["what"] == spikes.COUNTS and t["field"] == k]} for k in (0, 1)]
    source = spikes._source({"counts": counts, "pools": [t for t in told if t["what"] == spikes.POOLED], "units": []})
    days = spikes._days(table)
    found = lambda: sorted((f, int(r)) for f, rows, _ in spikes.judge(days, source) for r in rows)
    assert found() == [(0, 100)]
    source.limit = dict.fromkeys(source.limit, 1.0)
    assert found() == []


def test_forest_isolates():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (2000, 4)), [[12, 12, 12, 12]]]).astype(np.float32)
    forest = spikes.Forest(x, 1)
    score = forest.score(x)
    assert score[-1] > np.quantile(score, 0.999) and 0 < score.min() and score.max() <= 1
    constant = spikes.Forest(np.zeros((30, 4), np.float32), 1)
    assert np.ptp(constant.score(np.zeros((5, 4), np.float32))) == 0
