"""Registered queries against their SQL in DuckDB, and the contract of the entry module."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tideline import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"
CHECKED = ["dense_brand_pairs", "m2_prune", "m4_several_baskets", "s4_change_points", "s5_threshold_crossings", "a6_permutation_test", "a7_independent", "a11_series_attribution", "c1_benjamini_hochberg", "g3_p_dedup", "g4_effect_dedup", "b4_interrupted", "e1_interval_evaluation", "r1_basket_file", "r6_workbook", "r16_truth", "w4_json", "y7_injection", "x11_figure"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        name, path = file.removesuffix(".parquet"), f"{FOLDER}/{file}"
        connection.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(value):
    return round(float(value), 5) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())


def test_every_query_has_sql_or_a_reason():
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    # a fold that recursive SQL is too slow for, tested against the plain fold; experiments, tested by what is planted
    assert without == {"s6_cusum", "x3_conditions", "x4_null", "x5_lengths", "x9_semi_synthetic"}
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"pattern", "s", "e"}


def test_experiments_find_what_is_planted(spark):
    strong = {(r.condition, r.method): r for r in catalog.queries()["x3_conditions"](spark, FOLDER).collect()}
    assert strong["strong", "proposed"].recall == 1.0 and len(strong) == 4
    null = catalog.queries()["x4_null"](spark, FOLDER).first()
    assert null.seeds == 2 and null.fdr < 1
    assert {r.condition: r.recall for r in catalog.queries()["x5_lengths"](spark, FOLDER).collect()} == {"length 2": 1.0, "length 3": 1.0}
    assert catalog.queries()["x9_semi_synthetic"](spark, FOLDER).first().recall == 1.0


def test_the_rest_works_without_the_text_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tideline"), tmp_path / "tideline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run().stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]
    # where the operators are there, something else that is missing isn't hidden
    shutil.copytree(os.path.join(ROOT, "tideline", "llm"), tmp_path / "tideline" / "llm")
    shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    (tmp_path / "xxhash.py").write_text("raise ImportError('broken')")
    assert run().returncode != 0
