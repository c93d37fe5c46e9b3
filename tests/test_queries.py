from __future__ import annotations

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__  # noqa: F401
from millrace.plans import registry

from .oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, name):
    same(spark, small, registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["source", "docs", "hit_docs", "survivors"]


def test_entry_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_the_training_operators(tmp_path):
    root = pathlib.Path(__file__).parent.parent
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(root / "millrace", copy / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
            shutil.copy(root / name, copy)
        code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries(); print(len(e.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
        assert out.returncode == 0 and int(out.stdout) == len(registry.QUERIES), out.stderr
