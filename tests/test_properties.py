"""Properties over generated inputs."""

import datetime
import re

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.operators import badrows, profile, rolling
from keyloom.session import checkpointed, previous_row

FIELD = r'(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)'
LINE = re.compile(rf"{FIELD}(?:,{FIELD})*\Z", re.S)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='a1 ,"\t-', max_size=25))
def test_parser_accepts_the_regular_grammar(line):
    """The grammar of one line is regular: the parser and the pattern agree on broken quotes."""
    try:
        fields = badrows.RecordParser(line).record()
        broken = False
    except badrows.SyntaxFault as fault:
        broken = True
        assert fault.reason == "quoting" and 0 <= fault.at <= len(line)
    assert broken == (LINE.match(line) is None)
    if not broken:
        assert len(fields) == len(re.findall(rf",{FIELD}", "," + line))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.integers(1, 4)), min_size=1, max_size=60))
def test_pieces_of_curves_merge_exactly(cells):
    """Distances from pieces cut anywhere equal those from all values at once."""
    counts: dict = {}
    for load, value, n in cells:
        counts[load, float(value)] = counts.get((load, float(value)), 0) + n
    loads = sorted({k for k, _ in counts})
    n = {k: sum(c for (m, _), c in counts.items() if m == k) for k in loads}
    after = dict(zip(loads, loads[1:]))
    before = {b: a for a, b in after.items()}
    rows = sorted((v, k, c) for (k, v), c in counts.items())
    for cut in {v for v, _, _ in rows}:
        pieces = []
        for part in ([r for r in rows if r[0] < cut], [r for r in rows if r[0] >= cut]):
            if not part:
                continue
            c = {
                "num": np.array([v for v, _, _ in part]),
                "load": np.array([k for _, k, _ in part]),
                "cnt": np.array([x for _, _, x in part]),
                "next_id": np.array([after.get(k, -1) for _, k, _ in part]),
                "n": np.array([n[k] for _, k, _ in part]),
                "n_prev": np.array([n.get(before.get(k), 0) for _, k, _ in part]),
                "n_next": np.array([n.get(after.get(k), 0) for _, k, _ in part]),
            }
            pieces.append(profile._sweep_chunk(c, False))
        for k in loads:
            if k not in before:
                continue
            a, b = ([v for v, m, c in rows if m == x for _ in range(c)] for x in (k, before[k]))
            values = sorted({v for v, _, _ in rows})
            want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in values)
            p1 = p2 = gap = 0
            for piece in pieces:
                for i in np.flatnonzero((piece["kind"] == profile.PAIR) & (piece["load"] == k)):
                    offset = p1 * n[before[k]] - p2 * n[k]
                    gap = max(gap, abs(offset + piece["x"][i]), abs(offset + piece["y"][i]))
                    p1, p2 = p1 + piece["n1"][i], p2 + piece["n2"][i]
            assert abs(gap / (n[k] * n[before[k]]) - want) < 1e-12


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.data())
def test_banded_operator_sums_windows(tile, period, data):
    halo = period - 1 + data.draw(st.integers(0, 5))
    x = np.array(data.draw(st.lists(st.integers(0, 9), min_size=halo + tile, max_size=halo + tile)), float)
    got = x @ rolling.band(tile, halo, period)
    assert got.tolist() == [x[halo + j - period + 1 : halo + j + 1].sum() for j in range(tile)]


def test_previous_row_over_months(spark):
    rng = np.random.default_rng(2)
    data = [(int(i), f"g{rng.integers(3)}", None if rng.random() < 0.1 else datetime.datetime(2020, 1, 1) + datetime.timedelta(days=int(rng.integers(0, 400)))) for i in range(300)]
    df = spark.createDataFrame(data, "id long, g string, at timestamp_ntz")
    got = {r["id"]: r["prev_row"]["id"] if r["prev_row"] else None for r in previous_row(df, ["g"], "at", "id", ["id"]).collect()}
    want = {}
    for _, part in pd.DataFrame(data, columns=["id", "g", "at"]).groupby("g"):
        ids = part.sort_values(["at", "id"], na_position="first")["id"].tolist()
        want |= dict(zip(ids, [None, *ids[:-1]]))
    assert got == want


def test_checkpoint_keeps_partitions(spark):
    df = spark.range(100).repartition(7)
    assert checkpointed(df).rdd.getNumPartitions() == 7
