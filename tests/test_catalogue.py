"""Every registered query with SQL against DuckDB, and the entry points with and without the training-data operators."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from cuboid.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(columns), sorted((tuple(clean(r[i]) for i in at) for r in data), key=str)


def test_all_have_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_is_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    duck.execute(catalogue.oracle_sql()[name])
    want = rows([d[0] for d in duck.description], duck.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert [tuple(map(str, r)) for r in got[1]] == [tuple(map(str, r)) for r in want[1]] or got == want


def test_ranges_reach_the_scan(spark):
    plan = catalogue.queries()["range_points_2d"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_extendedprice" in plan and "l_tax" not in plan.split("== Physical Plan ==")[1]


def test_grid_join_is_no_nested_loop(spark):
    plan = catalogue.queries()["box_join_inner"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan.split("== Physical Plan ==")[1] and "Cartesian" not in plan


def run(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError("hidden", name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
print(*e.queries()); print(*e.oracle_sql())
"""


def test_entry_without_training_data_operators():
    for hidden in (["cuboid.llm", "corpus_pipeline"], ["cuboid.llm"]):
        names = run(HIDE.format(hidden=hidden)).split()
        assert "range_points_2d" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_other_import_errors_are_not_hidden():
    done = subprocess.run([sys.executable, "-c", HIDE.format(hidden=["numpy"])], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0


def test_the_engine_imports_no_training_data_operators():
    for file in (ROOT / "cuboid").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "cuboid.llm" not in file.read_text()


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
