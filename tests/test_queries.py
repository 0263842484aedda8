"""Every query with DuckDB SQL gives the same rows as DuckDB on the smallest tables."""

import decimal
import glob
import math
import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from corpusdeck.oracle import ORACLE as CORPUS_SQL
from corpusdeck.oracle_plans import ORACLE as PLAN_SQL
from corpusdeck.oracle_specs import ORACLE as SPEC_SQL
from corpusdeck.queries import QUERIES

ORACLE = CORPUS_SQL | PLAN_SQL | SPEC_SQL
#: Queries whose rules other ones hold against SQL on lessons, which have more of what the rules look for.
COVERED = {
    "f6_opportunities", "g1_text_actions", "g2_summaries", "g3_speaker_notes", "g5_plan_confidence", "h3_flow_edges", "h4_flow_text", "h5_timeline", "h6_comparison_rows", "h10_graph_series", "h11_kpi_metrics", "h12_smartart",
    "h15_icon_items", "h17_image_prompts",
}
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(set(ORACLE) - COVERED))
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want, got = con.sql(ORACLE[name]), QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()) == Counter(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_package(tmp_path):
    """With the optional package and its tests deleted, the contract still imports."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and e.oracle_sql() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": "."}, check=True)


def test_nothing_else_imports_the_optional_package():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/corpusdeck/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "llm" not in open(path).read().split("import", 1)[-1].split("\n\n\n")[0], path
