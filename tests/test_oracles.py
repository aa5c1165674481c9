"""Every query with check SQL must give the same rows; the others must run."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import compare, connect

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows(spark, sf, duck, key):
    difference = compare(QUERIES[key](spark, sf), duck, ORACLES[key])
    assert difference is None, difference


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, key):
    assert QUERIES[key](spark, sf).count() > 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 1500


def test_entry_without_the_text_operators(tmp_path):
    """The tree without both folders still gives all other queries, whether the pipeline's file stays or not."""
    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "tree"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"
    text = {k for k in QUERIES if k.startswith("op") or k == "pipeline"}
    for step in (lambda: None, (copy / "corpus_pipeline.py").unlink):
        step()
        for start in (code, "import bench"):
            said = subprocess.run([sys.executable, "-B", "-c", start], cwd=copy, capture_output=True, text=True, timeout=120)
            assert said.returncode == 0, said.stderr
            if start is code:
                assert said.stdout.split() == [str(len(set(QUERIES) - text)), "0"]
    said = subprocess.run([sys.executable, "-B", "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stdout[-2000:]
