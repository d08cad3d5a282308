"""The driver's contract, and that nothing outside the subpackage needs it."""

import os
import re
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in range(1, 6):
        assert f"p{n}_found" in entry.queries()


def test_columns_of_found_queries(spark):
    d = "/root/testdata/sf0.001"
    want = {
        "p1_found": ["file_id", "column_name", "change_kind"],
        "p2_found": ["file_id", "column_name", "issue"],
        "p3_found": ["file_id", "line_no", "reason"],
        "p4_found": ["ticker", "day_iso"],
        "p5_found": ["row_id", "field_name"],
    }
    for name, columns in want.items():
        assert entry.queries()[name](spark, d).columns == columns


def test_llm_is_optional():
    """With the subpackage out of reach the rest imports and registers its queries."""
    code = "import sys; sys.modules['keyloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p6_ids' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for folder, _, files in os.walk(os.path.join(ROOT, "keyloom")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert not re.search(r"keyloom\.llm|from keyloom import llm", text.read())
