"""The library without the training-data subpackage: it imports, and registers its own queries."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from corpuslens.plans.query_set import ORACLE_SQL, QUERIES
from jobs import queries as job_queries

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e, sys; q, s = e.queries(), e.oracle_sql(); assert not any(m.startswith('corpuslens.llm') for m in sys.modules); print(len(q), len(s))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    for name in ("corpuslens", "jobs", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    got = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    assert got.stdout.split() == [str(len(QUERIES | job_queries.QUERIES)), str(len(ORACLE_SQL | job_queries.ORACLE_SQL))]


def test_nothing_else_imports_the_subpackage():
    own = [p for d in ("corpuslens", "jobs", "tests") for p in (ROOT / d).rglob("*.py") if "llm" not in p.relative_to(ROOT).parts and p.name != "test_separation.py"]
    assert own and not [p for p in own if "corpuslens.llm" in p.read_text() or "tests.llm" in p.read_text()]
