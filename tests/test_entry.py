"""The driver contract with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def registered(folder):
    done = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, capture_output=True, text=True, check=True)
    return [line.split() for line in done.stdout.splitlines()[-2:]]


@pytest.mark.parametrize("left", ["pipeline", "nothing", "broken"])
def test_without_the_corpus_subpackage(tmp_path, left):
    for name in ("siftmark", "workload"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name,
                        ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if left != "nothing":  # a pipeline without its operators
        (tmp_path / "corpus_pipeline.py").write_text("from siftmark.llm import lines")
    if left == "broken":  # operators without one of their packages
        (tmp_path / "siftmark" / "llm").mkdir()
        (tmp_path / "siftmark" / "llm" / "__init__.py").write_text("")
        (tmp_path / "siftmark" / "llm" / "queries.py").write_text("import a_package_that_is_not_there")
    queries, oracles = registered(tmp_path)
    assert "ecosystem_metrics" in queries and len(queries) > 100
    assert not [q for q in queries if q.startswith("op") or q == "pipeline"]
    assert set(oracles) <= set(queries)
