"""The entry module with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("left", ["neither", "folder", "pipeline", "all but one"])
def test_optional_parts(tmp_path, left):
    shutil.copytree(ROOT / "cellvec", tmp_path / "cellvec", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "folder":
        (tmp_path / "cellvec/llm/__pycache__").mkdir(parents=True)
    if left in ("pipeline", "folder"):
        (tmp_path / "corpus_pipeline.py").write_text("from cellvec.llm.line_dedup import dedup_lines\n\nORACLE_SQL = None\nrun = dedup_lines\n")
    if left == "all but one":
        (tmp_path / "cellvec/llm").mkdir()
        (tmp_path / "cellvec/llm/queries.py").write_text("from . import not_there\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cell_counts' in q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert (done.returncode == 0) == (left != "all but one"), done.stderr[-800:]  # a module that is there must import
